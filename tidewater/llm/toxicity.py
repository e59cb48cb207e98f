"""Toxicity by compression distance between two zstandard dictionaries.

Training (on a bounded sample of labelled rows, see ``SAMPLE``): near copies
in the sample are collapsed; the ordinary dictionary is trained by
zstandard's own trainer on windows of ordinary texts; the toxic dictionary is
made of the words of toxic texts that occur there beyond chance, most
frequent last, followed by that same ordinary content.  The two differ only
in the toxic words, so two compressed lengths differ by what those explain.

Scoring: a window is one word, closed by a fixed piece of ordinary content,
the carrier, that pays for the block header (zstandard looks for no match in
a block's last bytes).  A window has two lengths, one with either dictionary,
both less the carrier's own.  For each pair of lengths the training sample
gives the log odds of toxic against ordinary texts that hold such a window; a
text counts by its highest window, through a monotone table of the share of
toxic training texts.  Of a few carriers the one that parts the sample best
is taken.  A window's lengths depend on its word alone, so workers remember
them.

Every window of every whole text is scored.  Defined results: null and empty
texts have no window and the lowest score; repeated rows get equal scores; an
empty table gives no rows; without labelled rows of both kinds every score is
zero, or one if all labels are 1; extra columns are kept by ``drop_toxic``
and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import labelled_sample

#: Bounds of the training sample: rows of each class, bytes of text of each class.
SAMPLE = {"toxic": 1500, "ordinary": 4000, "bytes": 24 << 20}
ORDINARY_BYTES = 16 << 10
CARRIER_BYTES = 32
CARRIERS = 10  # tried, from the end of the ordinary content
CARRIER_SAMPLE = (400, 1000)  # toxic and ordinary texts on which they are tried
WINDOW_WORDS = 12  # of the ordinary trainer's samples
REMEMBERED = 250_000
LONGEST = 15  # lengths above count as this


class Model:
    """The two dictionaries' contents, the carrier, the score of each pair of
    lengths (ordinary * 16 + toxic) and that of a text without windows."""

    def __init__(self, ordinary: bytes, toxic: bytes, carrier: bytes, scores: tuple[float, ...], lowest: float):
        import zstandard as zs

        self.state = (ordinary, toxic, carrier, scores, lowest)
        self.scores, self.lowest, self.carrier = scores, lowest, carrier
        self.known: dict[bytes, float] = {}
        # double-fast matching takes every match of 4 bytes and more
        how = zs.ZstdCompressionParameters(
            strategy=zs.STRATEGY_DFAST, min_match=4, search_log=3, window_log=15, hash_log=14, chain_log=14,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.compress = []
        for content in (ordinary, toxic):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compress.append(zs.ZstdCompressor(dict_data=d, compression_params=how).compress)
        self.base = [len(c(carrier)) for c in self.compress]

    def pair(self, word: bytes) -> int:
        """The window's two lengths, less the carrier's, in one number."""
        window = word + self.carrier
        a, b = (min(LONGEST, max(0, len(c(window)) - n + 1)) for c, n in zip(self.compress, self.base))
        return a * (LONGEST + 1) + b

    def score(self, text: str | None) -> float:
        """The highest score of any window of the whole text."""
        words = tokens(text)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            known.update((w, self.scores[self.pair(w)]) for w in new)
        return max(map(known.__getitem__, words), default=self.lowest)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def distinct_texts(texts: list[list[bytes]]) -> list[list[bytes]]:
    """The word lists without near copies of earlier ones (a fifth of the word triples seen before)."""
    seen: set[int] = set()
    kept = []
    for w in texts:
        triples = {hash((w[i], *w[i + 1 : i + 3])) for i in range(max(len(w) - 2, min(1, len(w))))}
        if triples and len(triples & seen) < 0.2 * len(triples):
            kept.append(w)
        seen |= triples
    return kept


def tail(n: int, k: int, p: float) -> float:
    """Chance of at least ``k`` of ``n`` draws at probability ``p``."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return sum(math.exp(log(i)) for i in range(k, n + 1))


def toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], odds: float = 8.0) -> list[bytes]:
    """Words ``odds`` times as common in toxic texts, beyond what chance gives any of all words; by ascending frequency."""
    a = Counter(w for t in toxic for w in set(t))
    b = Counter(w for t in ordinary for w in set(t))
    share = len(toxic) / (len(toxic) + len(ordinary))
    found = [
        (n, w) for w, n in a.items()
        if (n + 0.5) / (len(toxic) + 1) > odds * (b[w] + 0.5) / (len(ordinary) + 1) and tail(n + b[w], n, share) * len(a) < 0.5
    ]
    return [w for _, w in sorted(found)]


def ordinary_content(ordinary: list[list[bytes]], size: int) -> bytes:
    import zstandard as zs

    windows = [b" ".join(w[i : i + WINDOW_WORDS]) for w in ordinary for i in range(0, len(w), WINDOW_WORDS)]
    try:
        return zs.train_dictionary(size, windows).as_bytes()
    except zs.ZstdError:  # too little text for the trainer: the text itself
        return b" ".join(windows)[:size]


def log_odds(toxic: list[set[int]], ordinary: list[set[int]]) -> dict[int, float]:
    """For each pair of lengths: log odds of toxic to ordinary texts that hold such a window."""
    a, b = (Counter(p for t in texts for p in t) for texts in (toxic, ordinary))
    n, m = len(toxic), len(ordinary)
    prior = n / (n + m)
    return {
        p: math.log((a[p] + 0.5 * prior) / (n + 0.5)) - math.log((b[p] + 0.5 * (1 - prior)) / (m + 0.5)) for p in a.keys() | b.keys()
    }


def highest(odds: dict[int, float], texts: list[set[int]]) -> np.ndarray:
    floor = min(odds.values(), default=0.0)
    return np.array([max((odds[p] for p in t if p in odds), default=floor) for t in texts])


def monotone(value: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of truth as a rising step function of value (pool adjacent violators): steps and heights."""
    rate = float((truth * weight).sum() / weight.sum())
    blocks: list[list[float]] = []
    for v in np.unique(value):
        at = value == v
        blocks.append([float(v), (truth * weight)[at].sum() + 0.5 * rate, weight[at].sum() + 0.5])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
          sample: dict | None = None) -> Model:
    """Model of the texts of ``docs`` whose key has a 0/1 ``label`` in ``labels``, drawn within ``sample``."""
    bound = sample or SAMPLE
    drawn, shares = labelled_sample(docs, labels, label, {1: bound["toxic"], 0: bound["ordinary"]}, bound["bytes"], key, text)
    texts = {v: [r.text for r in drawn if r.label == v] for v in (1, 0)}
    cells = (LONGEST + 1) ** 2
    if not texts[0] or not texts[1]:
        flat = 1.0 if texts[1] else 0.0
        return Model(b"", b"", b"", (flat,) * cells, flat)
    # one object for each distinct word: the sample's words fill the driver's memory otherwise
    names: dict[bytes, bytes] = {}
    texts = {v: [[names.setdefault(w, w) for w in tokens(t)] for t in texts[v]] for v in (1, 0)}
    del drawn
    toxic, ordinary = distinct_texts(texts[1]), distinct_texts(texts[0])
    content = ordinary_content(ordinary, ORDINARY_BYTES)
    listed = b"".join(w + b" " for w in toxic_words(toxic, ordinary)) + content

    def fit(carrier: bytes, a: list[set[bytes]], b: list[set[bytes]]):
        m = Model(content, listed, carrier, (0.0,) * cells, 0.0)
        pairs = {w: m.pair(w) for w in set().union(*a, *b)}
        found = [[{pairs[w] for w in t} for t in texts] for texts in (a, b)]
        odds = log_odds(*found)
        return odds, highest(odds, found[0]), highest(odds, found[1])

    words = {v: [set(t) for t in texts[v]] for v in (1, 0)}
    del texts, toxic, ordinary
    few = words[1][: CARRIER_SAMPLE[0]], words[0][: CARRIER_SAMPLE[1]]
    tried = []
    for i in range(CARRIERS):
        at = max(0, len(content) - 48 - 37 * i)
        carrier = b" " + content[at : at + CARRIER_BYTES]
        _, yes, no = fit(carrier, *few)
        # toxic texts above the highest ordinary ones, then all in order
        tried.append(((yes > np.quantile(no, 0.999)).mean(), (yes[:, None] > no[None, :]).mean(), -i, carrier))
    carrier = max(tried)[-1]
    odds, yes, no = fit(carrier, words[1], words[0])
    # each class weighs as in the whole training table
    weight = np.repeat([1 / shares[1], 1 / shares[0]], [len(yes), len(no)])
    steps, heights = monotone(np.concatenate([yes, no]), np.repeat([1.0, 0.0], [len(yes), len(no)]), weight)
    floor = min(odds.values(), default=0.0)
    at = np.searchsorted(steps, [odds.get(p, floor) for p in range(cells)], "right") - 1
    scores = heights[np.maximum(at, 0)]
    return Model(content, listed, carrier, tuple(scores.tolist()), float(heights[0]))


@lru_cache(maxsize=2)
def opened(state: tuple) -> Model:
    """One model, with its remembered windows, for all tasks of a Python worker."""
    return Model(*state)


def score(docs: DataFrame, model: Model, *keep: Column, text: str = "text") -> DataFrame:
    """``keep`` columns plus ``score`` (double) for every row."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    state = docs.sparkSession.sparkContext.broadcast(model.state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(state.value)
        for b in batches:
            values = [m.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            columns = [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("score", "double"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, columns unchanged."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return score(docs, model, packed, text=text).filter(F.col("score") < threshold).select("row.*")
