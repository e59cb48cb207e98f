"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ``ORDER`` bytes holds the
counts of the byte that followed.  A byte's code length comes from the longest
context in the tree: a byte seen there has ``count / (total + distinct)``; the
others share the escape ``distinct / (total + distinct)`` by the next shorter
context's distribution without the seen bytes (escape method C with full
exclusion), down to the uniform distribution over 256 bytes.  The statistics
are frozen after training, so a code length is a function of the context and
the byte.  All languages' trees are laid over one union tree and every code
length is written out once: scoring a byte is two look-ups and one row of a
table with a number for each language.

A text is lower-cased, encoded as UTF-8 and preceded by ``ORDER`` spaces; the
language with the shortest whole-text code wins (ties: the first by name).
The score is the winner's share of the likelihoods.

Trained on a bounded sample (``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes
of text for each language in expectation); contexts seen fewer than
``LEAST_COUNT`` times in a language are not kept.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if nothing was learned; repeated rows get equal results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import byte_runs, labelled_sample

ORDER = 3
SAMPLE_ROWS = 500
SAMPLE_BYTES = 1 << 20
LEAST_COUNT = 4
#: Letters, and numbers such as one half that are neither digits nor letters.
MAYBE_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in MAYBE_LETTER.finditer(text))


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def windows(texts: list[bytes], n: int) -> np.ndarray:
    """Every run of ``n`` bytes that ends in a text (spaces lead it), as one integer each."""
    found = []
    for _, parts in byte_runs(texts, ORDER):
        for part in parts:
            b = np.frombuffer(part, np.uint8).astype(np.int64)
            value = np.zeros(len(b) - ORDER, np.int64)
            for k in range(n):
                at = ORDER - n + 1 + k
                value = value * 256 + b[at : at + len(value)]
            found.append(value)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def code_lengths(texts: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """(length, context as integer) -> nats for each next byte, for one language's tree."""
    lengths = {(-1, 0): np.full(256, 1 / 256)}
    for n in range(ORDER + 1):
        value, count = np.unique(windows(texts, n + 1), return_counts=True)
        context, first = np.unique(value >> 8, return_index=True)
        for c, a, b in zip(context.tolist(), first.tolist(), [*first[1:].tolist(), len(value)]):
            total = int(count[a:b].sum())
            if total < LEAST_COUNT:
                continue
            shorter = lengths[(n - 1, c & ((1 << 8 * (n - 1)) - 1) if n > 0 else 0)]
            seen, distinct = value[a:b] & 255, b - a
            rest = shorter.copy()
            rest[seen] = 0
            left = rest.sum()
            p = rest * (distinct / (total + distinct) / left) if left > 0 else rest
            p[seen] = count[a:b] / (total + distinct if left > 0 else total)
            lengths[(n, c)] = p
    return lengths


class Model:
    """The union tree as look-up arrays and the table of code lengths."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        trees = [code_lengths(samples[x]) for x in self.languages]
        nodes = sorted(set().union(*trees) - {(-1, 0)})
        used = sorted({c >> 8 * k & 255 for n, c in nodes for k in range(n)} | set(range(128)))
        for t in trees:
            used = sorted({*used, *np.flatnonzero(t.get((0, 0), np.zeros(256)) > t.get((0, 0), np.zeros(256)).min()).tolist()})
        # bytes of no tree are alike: they share one symbol
        self.symbol = np.full(256, len(used), np.int32)
        self.symbol[used] = np.arange(len(used))
        other = next((b for b in range(256) if b not in set(used)), 0)
        width = self.width = len(used) + 1
        columns = [*used, other]

        def row(node: tuple[int, int]) -> np.ndarray:
            out = np.empty((width, len(trees)), np.float32)
            for i, t in enumerate(trees):
                n, c = node
                while (n, c) not in t:
                    n, c = n - 1, c & ((1 << 8 * (n - 1)) - 1) if n > 0 else 0
                out[:, i] = -np.log(t[(n, c)][columns])
            return out

        number = {node: i for i, node in enumerate(nodes)}
        self.table = np.concatenate([row(x) for x in nodes]) if nodes else np.zeros((0, 0), np.float32)
        if not nodes:
            return

        def deepest(n: int, c: int) -> int:
            while (n, c) not in number:
                n, c = n - 1, c & ((1 << 8 * (n - 1)) - 1) if n > 0 else 0
            return number[(n, c)]

        pairs = sorted({c & 0xFFFF for n, c in nodes if n >= 2})
        slot = {c: i for i, c in enumerate(pairs)}
        # second-last and last byte -> slot; pairs of no node use a slot of their last byte
        self.second = np.empty((width, width), np.int32)
        self.second[:, :] = len(pairs) + np.arange(width)
        byte = dict(enumerate(columns))
        for c, i in slot.items():
            self.second[self.symbol[c >> 8], self.symbol[c & 255]] = i
        self.third = np.empty((len(pairs) + width, width), np.int32)
        for s in range(width):
            self.third[len(pairs) + s, :] = deepest(1, byte[s])
        for c, i in slot.items():
            self.third[i, :] = deepest(2, c)
        for n, c in nodes:
            if n == 3:
                self.third[slot[c & 0xFFFF], self.symbol[c >> 16]] = number[(n, c)]

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Nats of each whole text (rows) by each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        for owners, parts in byte_runs(texts, ORDER):
            s = self.symbol[np.frombuffer(b"".join(parts), np.uint8)]
            context = self.third[self.second[s[1:-2], s[2:-1]], s[:-3]]
            costs = self.table[context * self.width + s[3:]]
            # the windows that end in a part's lead belong to no text
            ends = np.cumsum([len(p) for p in parts])
            begins = np.concatenate([[0], ends[:-1]])
            for k in range(ORDER):
                at = begins[1:] + k - ORDER
                costs[at] = 0
            sums = np.add.reduceat(np.concatenate([costs, np.zeros((1, costs.shape[1]), costs.dtype)]), begins, axis=0, dtype=np.float64)
            empty = ends - begins <= ORDER
            sums[empty] = 0
            np.add.at(out, owners, sums)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        found = self.totals([prepared(t) for t in texts]) if self.languages else None
        for i, t in enumerate(texts):
            if found is None or t is None or not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(found[i].argmin())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(found[i, best] - found[i]).sum()))
        return names, scores


def train(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text",
          rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """The bounded sample of each language, from rows with a label."""
    drawn, _ = labelled_sample(docs, docs.select(key, label), label, rows, size, key, text)
    samples: dict[str, list[bytes]] = {}
    for r in drawn:
        samples.setdefault(r.label, []).append(prepared(r.text))
    return samples


@lru_cache(maxsize=2)
def built(samples: tuple) -> Model:
    """One model for all tasks of a Python worker (the sample is smaller than the table made of it)."""
    return Model({name: list(texts) for name, texts in samples})


def identify(docs: DataFrame, samples: dict[str, list[bytes]], *keep: Column, text: str = "text") -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` for every row."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    state = docs.sparkSession.sparkContext.broadcast(tuple((k, tuple(v)) for k, v in sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built(state.value)
        for b in batches:
            names, scores = model.predict(b.column(b.num_columns - 1).to_pylist())
            columns = [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("lang_pred", "string").add("score", "double"))
