"""Quality classifier with supervised subword embeddings.

Features of a text are its words, its word bigrams and its byte n-grams
(``GRAMS``), hashed to ``1 << BITS`` buckets.  Each bucket has a learned vector; a text is the mean
of its features' vectors; a softmax over two classes follows.  Vectors and
output weights are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` bytes of each label in expectation).  At scoring time the
output layer is multiplied into the table: a bucket then holds one number,
the difference of the two classes' logits, and a text's logit is their mean.

Whole texts are scored; a text above the array run length is cut into runs
that are led by the bytes before them, so no n-gram is lost or counted twice
(a word or bigram across such a cut counts as its parts).

Defined results: null and empty texts have no feature and the score of the
output bias; repeated rows get equal scores; an empty table gives no rows;
without labelled rows of both kinds the score is 0.5; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import byte_runs, labelled_sample

BITS = 17
GRAMS = (2, 3, 4)
SIZE = 8
EPOCHS = 8
RATE = 0.2
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 6 << 20
LEAD = max(GRAMS) - 1
#: Multipliers of the hash (odd, so that powers can be undone).
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    steps = np.full(n, BASE, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h + np.uint64(kind)) * SPREAD) >> np.uint64(64 - BITS)).astype(np.int32)


def features(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of buckets of a run of led parts, each with the part that every feature belongs to."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), length)
    lead = np.zeros(len(raw), bool)
    begins = np.cumsum(length) - length
    for k in range(LEAD):
        lead[begins + k] = True
    code = raw.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # h[i]: the n bytes that end at i
        shifted = np.zeros(len(raw), np.uint64)
        shifted[n - 1 :] = code[: len(raw) - n + 1]
        h = h + shifted * powers(n)[-1]
        if n in GRAMS:
            yield bucket(h[~lead], n), owner[~lead]
    # words: prefix sums of byte * BASE ** position, shifted back to position zero
    space = (raw == 32) | ((raw >= 9) & (raw <= 13)) | lead
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start):
        p = powers(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(code * p[:-1])])
        # BASE ** -1 modulo 2 ** 64
        undo = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(raw), pow(int(BASE), -1, 1 << 64), np.uint64)]))
        word, of = (sums[end] - sums[start]) * undo[start], owner[start]
        yield bucket(word, 0), of
        # word bigrams hash to the difference of the words' hashes: any word said twice in a row is one feature
        same = of[1:] == of[:-1]
        yield bucket(word[1:] - word[:-1], 1)[same], of[1:][same]


def prepared(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the share of each among its features."""
    found = [b for _, parts in byte_runs([text], LEAD) for b, _ in features(parts)] if text else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    at, n = np.unique(np.concatenate(found), return_counts=True)
    return at, n / n.sum()


def fit(texts: list[bytes], label: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent: logit of each bucket (class 1 less class 0) and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE))
    weights, bias = np.zeros((2, SIZE)), np.zeros(2)
    sparse = [counted(t) for t in texts]
    done, steps = 0, EPOCHS * len(texts)
    # each class weighs the same in the loss
    each = {v: 0.5 * len(label) / max(1, label.count(v)) for v in (0, 1)}
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            at, share = sparse[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            logit = weights @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label[i]] -= 1
            p *= each[label[i]]
            back = p @ weights
            weights -= rate * np.outer(p, hidden)
            bias -= 0.01 * rate * p
            # scaled so that the text's mean moves by rate * back, however many features share it
            if len(at):
                vectors[at] -= rate * np.outer(share / (share @ share), back)
    return (vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Bucket logits and bias, learned from the keys with a 0/1 ``label``."""
    drawn, _ = labelled_sample(docs, labels, label, {0: rows, 1: rows}, size, key, text)
    if {r.label for r in drawn} != {0, 1}:
        return np.zeros(1 << BITS, np.float32), 0.0
    return fit([prepared(r.text) for r in drawn], [r.label for r in drawn])


def logits(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, parts in byte_runs(texts, LEAD):
        owners = np.array(owners)
        for at, part in features(parts):
            np.add.at(total, owners, np.bincount(part, table[at], len(parts)))
            np.add.at(n, owners, np.bincount(part, minlength=len(parts)))
    return total / np.maximum(n, 1) + bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], *keep: Column, text: str = "text") -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) for every row."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = logits([prepared(t) for t in b.column(b.num_columns - 1).to_pylist()], *state.value)
            columns = [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("score", "double"))
