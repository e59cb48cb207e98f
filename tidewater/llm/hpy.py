"""Language-model scoring with a hierarchical Pitman-Yor process.

Contexts are the previous word, its last byte, nothing.  Each context is a
Chinese restaurant whose dishes are words; a word's parent is the restaurant of
its last byte, all of those share the empty context, and that one's base is
uniform over the training words and one place for the unknown.  The probability of a word is

    (c - d t + (theta + d T) P_parent(w)) / (theta + C)

with c customers and t tables of the word, C and T of the restaurant.

Sampling.  Every word occurrence is a customer of the word before it; every
table there is a customer of the parent, and so on.  Given the restaurants'
totals T, words are independent, so the state is parted by word: a task holds
all dishes of its words at all three levels.  A sweep seats all
customers of every dish again, in blocks of whole tables (``Seating.reseat``),
so its work grows with the tables that the counts call for; tables opened or
closed add or take random customers at the parent.  Within a sweep the parent
probabilities are those at its start.  Each round of sweeps writes the seating
of all shards and their sums, and the next goes on from that seating with the
totals T of it.  All rounds but the last are burn-in; predictive probabilities
are averaged over the last round's sweeps.

Data flow.  Documents are packed into batches (bounded by text bytes) with
their own list of distinct (context, word) pairs; documents keep positions in
that list.  Pairs with their counts go to the shard of their word, packed by batch, in a
table with a bucket for each shard, so that no later step shuffles them again.
The words that are contexts are as many as the words, so their totals are never
in one place: each shard asks for those of its own contexts, the askers' numbers
are added by ranges of contexts, and every shard gets back the sums of what it
asked for (``totalled``).  Only the sums of the 257 contexts above them are
broadcast.  The shard answers each batch's pairs, and a batch sums its documents
from the answers.  All counts are over all training
rows; shards grow in number with the text, not in size.

Defined results: a null text is empty and has its end token; equal rows get
equal scores; without training rows every word is unknown; an empty table
gives no rows; a null key counts as empty text for the fold; extra columns are
ignored.  Words are told apart by a 64-bit hash, as contexts by their last byte and
32 bits of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bucketed, small_batches, written

DISCOUNT = (0.6, 0.7, 0.75)  # empty, last-byte and word contexts
STRENGTH = (1.0, 1.0, 1.0)
ROUNDS = 2
SWEEPS = 3
BATCH_BYTES = 6 << 20
SHARD_BYTES = 8 << 20
GROUP_BYTES = 8 << 20  # Parquet row groups of batches and shards, whose rows hold megabytes
CONTEXTS = (1, 1 << 8)  # and the words
CONTEXT_BITS = 40
SHARDS_A_RANGE = 8  # shards' worth of contexts whose totals are added in one group
GROUP_TABLES = 4  # tables expected of a dish that are seated again together
MOVES = 8  # of two tables in a group
LARGE_GROUP = 8  # customers of groups above are also drawn anew
RENEWALS = 4
END = b"\n"  # no word holds white space


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split() + [END]


def pack(values: np.ndarray) -> bytes:
    """An integer array as bytes; byte planes compress well where high bytes repeat."""
    import zstandard

    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def batches_of(docs: DataFrame, held_out: Column, keys: list[str], shards: int, size: int) -> DataFrame:
    """Two kinds of rows: ``slot`` < ``shards``: a batch's pairs for that shard; ``slot - shards`` = ``batch``: its documents."""
    rows = docs.select(*keys, held_out.alias("held_out"), F.col("text"))
    key_type = rows.select(*keys).schema

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        known: dict[bytes, int] = {}
        words: list[bytes] = []
        streams: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, known, words, streams, total, number
            hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            last = np.fromiter((w[-1] for w in words), np.uint64, len(words))
            end = known[END]
            known, words = {}, []
            context = hashed >> np.uint64(32) << np.uint64(8) | last
            length = np.array([len(s) for s in streams])
            flat = np.concatenate(streams)
            streams = []
            before = np.empty(len(flat), np.int64)
            before[1:] = flat[:-1]
            before[np.cumsum(length) - length] = end  # a text begins as after an end
            out = np.concatenate([b.column(len(keys)).to_numpy(zero_copy_only=False) for b in held]).astype(bool)
            # distinct pairs, sorted by shard, word and context
            order = np.argsort(hashed)
            rank = np.empty(len(hashed), np.int64)
            rank[order] = np.arange(len(hashed))
            pair, at = np.unique(rank[flat] << 32 | rank[before], return_inverse=True)
            word, ctx = hashed[order][pair >> 32], context[order][pair & 0xFFFFFFFF]
            count = np.bincount(at, np.repeat(~out, length), len(pair)).astype(np.uint32)
            shard = (word >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)  # ascends with the word
            edge = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            found = {"slot": [], "batch": [], "a": [], "b": [], "c": []}
            for s in np.flatnonzero(np.diff(edge)).tolist():
                i, j = edge[s], edge[s + 1]
                found["slot"].append(s)
                found["batch"].append(number)
                found["a"].append(pack(np.diff(word[i:j], prepend=np.uint64(0))))
                found["b"].append(pack(ctx[i:j]))
                found["c"].append(pack(count[i:j]))
            rows = {k: pa.array(v, t) for (k, v), t in zip(found.items(), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))}
            yield pa.RecordBatch.from_arrays([*rows.values(), pa.nulls(len(found["slot"]), docs_type[0])], names=names)
            listed = pa.Table.from_batches(held).select([*keys, "held_out"])
            listed = listed.append_column("n", pa.array(length, pa.int64())).combine_chunks().to_batches()[0].to_struct_array()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shards + number]), pa.array([number]), pa.array([pack(at.astype(np.uint32))], pa.binary()), pa.nulls(1, pa.binary()),
                    pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                ],
                names=names,
            )
            held, total, number = [], 0, number + 1

        names = ["slot", "batch", "a", "b", "c", "docs"]
        docs_type: list[pa.DataType] = []
        for b in source:
            if not b.num_rows:
                continue
            if not docs_type:
                fields = [*(b.schema.field(i) for i in range(len(keys) + 1)), pa.field("n", pa.int64())]
                docs_type = [pa.list_(pa.struct(fields))]
            begin = 0
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                w = tokens(text)
                new = [x for x in dict.fromkeys(w) if x not in known]
                for x in new:
                    known[x] = len(words)
                    words.append(x)
                streams.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                total += len(text or "") + 1
                if total >= size:
                    held.append(b.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield from flush()
            if begin < b.num_rows:
                held.append(b.slice(begin))
        if held:
            yield from flush()

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in key_type)
    return rows.mapInArrow(
        run, f"slot long, batch long, a binary, b binary, c binary, docs array<struct<{fields}, held_out: boolean, n: bigint>>"
    )


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight places up."""
    y = x + 8
    below = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - below


class Seating:
    """Tables of many dishes: ``size`` of each table and the ``dish`` it belongs to, ascending."""

    def __init__(self, customers: np.ndarray):
        """One table for all customers of a dish."""
        self.n = len(customers)
        self.dish = np.flatnonzero(customers > 0)
        self.size = customers[self.dish].astype(np.float64)

    @classmethod
    def of(cls, n: int, dish: np.ndarray, size: np.ndarray) -> Seating:
        out = cls.__new__(cls)
        out.n, out.dish, out.size = n, dish, size
        return out

    @classmethod
    def spread(cls, customers: np.ndarray, opening: np.ndarray, discount: float) -> Seating:
        """About the tables to be expected of each dish without end, of even sizes."""
        tables = np.minimum(np.rint(1 + opening / discount), customers).astype(np.int64)
        dish = np.repeat(np.arange(len(customers)), tables)
        size, more = np.divmod(customers.astype(np.int64), np.maximum(tables, 1))
        place = np.arange(len(dish)) - np.repeat(np.cumsum(tables) - tables, tables)
        return cls.of(len(customers), dish, (size[dish] + (place < more[dish])).astype(np.float64))

    def packed(self) -> dict[str, bytes]:
        return {"tables": pack(self.tables().astype("<u4")), "sizes": pack(self.size.astype("<u8"))}

    @classmethod
    def unpacked(cls, state: dict[str, bytes]) -> Seating:
        tables = unpack(state["tables"], "<u4")
        return cls.of(len(tables), np.repeat(np.arange(len(tables)), tables), unpack(state["sizes"], "<u8").astype(np.float64))

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=self.n)

    def customers(self) -> np.ndarray:
        return np.bincount(self.dish, self.size, self.n)

    def pick(self, rng, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each dish of ``which`` (a mask) one of its tables, in proportion to ``weight``: the smallest of exponential times."""
        at = np.flatnonzero(which[self.dish] & (weight > 0))
        time = rng.exponential(size=len(at)) / weight[at]
        order = np.lexsort((time, self.dish[at]))
        dish = self.dish[at][order]
        return at[order][np.concatenate([[True], dish[1:] != dish[:-1]]) if len(dish) else []]

    def leave(self, rng, which: np.ndarray) -> None:
        """A random customer of each dish of ``which`` gets up."""
        at = self.pick(rng, which, self.size)
        self.size[at] -= 1
        if (self.size[at] == 0).any():
            keep = self.size > 0
            self.dish, self.size = self.dish[keep], self.size[keep]

    def enter(self, rng, which: np.ndarray, opening: np.ndarray, discount: float) -> None:
        """A customer of each dish of ``which`` sits down; ``opening`` is the weight of a new table, by dish."""
        count, tables = self.customers(), self.tables()
        old = np.maximum(count - discount * tables, 0)
        fresh = which & ((rng.random(self.n) * (old + opening) < opening) | (tables == 0))
        at = self.pick(rng, which & ~fresh, self.size - discount)
        self.size[at] += 1
        dishes = np.flatnonzero(fresh)
        if len(dishes):
            place = np.searchsorted(self.dish, dishes, "right")
            self.dish, self.size = np.insert(self.dish, place, dishes), np.insert(self.size, place, 1.0)

    def merged(self, inside: np.ndarray, dish: np.ndarray, size: np.ndarray) -> None:
        """Other tables in place of those ``inside`` (a mask)."""
        dish, size = np.concatenate([self.dish[~inside], dish]), np.concatenate([self.size[~inside], size])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]

    def follow(self, rng, change: np.ndarray, opening: np.ndarray, discount: float) -> None:
        """``change`` customers of each dish come (or go, where negative), one after the other."""
        ids = np.flatnonzero(change)
        if not len(ids):
            return
        inside = (change != 0)[self.dish]
        part = Seating.of(len(ids), np.searchsorted(ids, self.dish[inside]), self.size[inside])
        change, opening = change[ids], opening[ids]
        while 2 * np.count_nonzero(change) > len(ids):  # then with the dishes that are left
            less, more = change < 0, change > 0
            part.leave(rng, less)
            part.enter(rng, more, opening, discount)
            change = change + less - more
        part.follow(rng, change, opening, discount)
        self.merged(inside, ids[part.dish], part.size)

    def reseat(self, rng, opening: np.ndarray, discount: float) -> None:
        """All customers of every dish are seated again, in blocks of whole tables.

        Given its customers and the weight ``opening`` of a new table, a dish's seating has the probability
        of its tables' product of ``opening * (1 - d)(2 - d)...(size - 1 - d)``.  Its tables fall into groups at random,
        more of them the more tables are to be expected; a group with an even part of ``opening`` is then
        independent of the others, and two kinds of moves keep its distribution: two random customers' tables are
        joined, or parted anew between the two; and all of a large group's tables are drawn anew.
        """
        d = discount
        count = self.customers()
        inside = (count > 1)[self.dish]
        dish, size = self.dish[inside], self.size[inside]
        if not len(dish):
            return
        groups = np.where(count > 1, np.ceil(np.minimum(count, 1 + opening / d) / GROUP_TABLES), 0).astype(np.int64)
        begin = np.cumsum(groups) - groups
        owner = np.repeat(np.arange(self.n), groups)
        weight = (opening / np.maximum(groups, 1))[owner]
        group = begin[dish] + (rng.random(len(dish)) * groups[dish]).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, size = group[order], size[order]
        number = np.bincount(group, size, len(owner)).astype(np.int64)
        first = np.cumsum(number) - number
        for move in range(MOVES):
            active = np.flatnonzero(number > move + 1)
            if not len(active):
                break
            n, ends = number[active], np.cumsum(size)
            u = (rng.random(len(n)) * n).astype(np.int64)
            v = (u + 1 + (rng.random(len(n)) * (n - 1)).astype(np.int64)) % n
            i, j = (np.searchsorted(ends, first[active] + x, "right") for x in (u, v))
            two = i != j
            m = size[i] + np.where(two, size[j], 0)
            odds = np.log(weight[active]) + log_gamma(m - 2 * d) - log_gamma(m - d) + math.lgamma(1 - d) - math.lgamma(2 - 2 * d)
            split = rng.random(len(n)) * (1 + np.exp(-odds)) < 1
            left = np.where(split, 1 + rng.binomial(m.astype(np.int64) - 2, rng.beta(1 - d, 1 - d, len(n))), m)
            size[i] = left
            size[j[two]] = (m - left)[two]
            new = split & ~two
            group, size = np.insert(group, i[new] + 1, group[i[new]]), np.insert(size, i[new] + 1, (m - left)[new])
            keep = size > 0
            group, size = group[keep], size[keep]
        large = number > LARGE_GROUP
        chosen = large[group]
        names = np.cumsum(large) - 1
        drawn = renewed(rng, names[group[chosen]], size[chosen], number[large], weight[large], d)
        group, size = np.concatenate([group[~chosen], np.flatnonzero(large)[drawn[0]]]), np.concatenate([size[~chosen], drawn[1]])
        self.merged(inside, owner[group], size)


def renewed(rng, group: np.ndarray, size: np.ndarray, number: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables of groups of ``number`` customers, drawn anew: sizes of all tables but one from the distribution that they
    have in a group without end, the rest at that one, taken or not by Metropolis and Hastings."""
    d = discount

    def log_p(n: np.ndarray) -> np.ndarray:
        return math.log(d) - math.lgamma(1 - d) + log_gamma(n - d) - log_gamma(n + 1)

    mean = np.minimum(weight / d, GROUP_TABLES)
    more = np.log(weight / d / mean)
    for _ in range(RENEWALS if len(number) else 0):
        tables = np.bincount(group, minlength=len(number))
        rest = size[np.cumsum(tables) - tables + (rng.random(len(number)) * tables).astype(np.int64)]
        others = rng.poisson(mean)
        owner = np.repeat(np.arange(len(number)), others)
        drawn = rng.geometric(np.maximum(rng.beta(d, 1 - d, len(owner)), 1e-15)).astype(np.float64)
        left = number - np.bincount(owner, drawn, len(number))
        gain = (others - tables + 1) * more + log_p(np.maximum(left, 1)) - log_p(rest) - np.log((others + 1) / tables)
        taken = (left >= 1) & (rng.exponential(size=len(number)) > -gain)
        ids = np.flatnonzero(taken)
        old, new = ~taken[group], taken[owner]
        group, size = np.concatenate([group[old], owner[new], ids]), np.concatenate([size[old], drawn[new], left[ids]])
        order = np.argsort(group, kind="stable")
        group, size = group[order], size[order]
    return group, size


class Named:
    """A number for each of some contexts (``names``, ascending), found by its context as in an array of all."""

    def __init__(self, names: np.ndarray, values: np.ndarray):
        self.names, self.values = names, values

    def __getitem__(self, context):
        return self.values[np.searchsorted(self.names, context)]


class Shard:
    """All dishes of some words at the three levels, for one round of sweeps."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, seats: list[Seating] | None = None):
        """Distinct (word, context) pairs, sorted by word and context, with their customers; ``seats`` as they were left.

        A context's low eight bits are its parent.
        """
        self.names, self.place = np.unique(context, return_inverse=True)
        self.context = [None, context & 255, context]
        one, self.up2 = np.unique(np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) << 8 | (context & 255).astype(np.int64), return_inverse=True)
        self.up1 = one >> 8
        self.context[1] = (one & 255).astype(np.int64)
        self.words = int(self.up1[-1]) + 1 if len(one) else 0
        self.context[0] = np.zeros(self.words, np.int64)
        self.count = np.bincount(self.up1[self.up2], count, self.words)
        self.parent = [None, self.up1, self.up2]
        self.fresh = not seats
        if seats:
            self.seats = seats
            return
        self.seats: list[Seating] = [None, None, Seating(count)]
        self.seats[1] = Seating(np.bincount(self.up2, self.seats[2].tables(), len(one)))
        self.seats[0] = Seating(np.bincount(self.up1, self.seats[1].tables(), self.words))

    def of_dishes(self, totals, level: int) -> np.ndarray:
        """The number of each dish's restaurant; of words as contexts, ``totals`` are those of ``names``."""
        return totals.values[self.place] if level == 2 else totals[self.context[level]]

    def probabilities(self, totals: list[tuple[np.ndarray, np.ndarray]], base: float) -> list[np.ndarray]:
        """P of every dish at each level, given each restaurant's customers and tables."""
        found, above = [], np.full(self.words, base)
        for level in range(3):
            c_all, t_all = (self.of_dishes(x, level) for x in totals[level])
            above = above if level == 0 else found[-1][self.parent[level]]
            s = self.seats[level]
            d, theta = DISCOUNT[level], STRENGTH[level]
            found.append((s.customers() - d * s.tables() + (theta + d * t_all) * above) / (theta + c_all))
        return found

    def sweep(self, rng, totals: list[tuple[np.ndarray, np.ndarray]], base: float) -> None:
        """All customers of all dishes are seated again; parents follow."""
        p = self.probabilities(totals, base)
        change = None
        for level in (2, 1, 0):
            s, d = self.seats[level], DISCOUNT[level]
            above = np.full(self.words, base) if level == 0 else p[level - 1][self.parent[level]]
            opening = (STRENGTH[level] + d * self.of_dishes(totals[level][1], level)) * above
            before = s.tables()
            if self.fresh:  # one table a dish is far from any seating of a large one
                sent = s.customers() if level == 2 else np.bincount(self.parent[level + 1], self.seats[level + 1].tables(), s.n)
                s = self.seats[level] = Seating.spread(sent, opening, d)
            elif change is not None:  # customers that the children's tables sent or took back
                s.follow(rng, change, opening, d)
            s.reseat(rng, opening, d)
            if level:
                n = len(self.up1) if level == 2 else self.words
                change = np.bincount(self.parent[level], s.tables() - before, n).astype(np.int64)
        self.fresh = False

    def sums(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Customers and tables of every restaurant, as far as this shard's words go."""
        found = [
            (np.bincount(self.context[i], s.customers(), n), np.bincount(self.context[i], s.tables(), n))
            for i, (s, n) in enumerate(zip(self.seats, CONTEXTS))
        ]
        s, n = self.seats[2], len(self.names)
        return [*found, (Named(self.names, np.bincount(self.place, s.customers(), n)), Named(self.names, np.bincount(self.place, s.tables(), n)))]


def opened(rows: list[tuple[bytes, bytes, bytes]], seats: list[Seating] | None = None) -> tuple[Shard, list[np.ndarray]]:
    """The shard of some batches' pairs, seated as ``seats`` if given, and for each batch the places of its pairs."""
    word = [np.cumsum(unpack(a, "<u8"), dtype=np.uint64) for a, _, _ in rows]
    context = [unpack(b, "<u8").astype(np.int64) for _, b, _ in rows]
    count = [unpack(c, "<u4").astype(np.float64) for _, _, c in rows]
    every = np.unique(np.concatenate(word))
    pair = np.concatenate([np.searchsorted(every, w) << CONTEXT_BITS | c for w, c in zip(word, context)])
    distinct, at = np.unique(pair, return_inverse=True)
    count = np.bincount(at, np.concatenate(count), len(distinct))
    shard = Shard(every[distinct >> CONTEXT_BITS], distinct & (1 << CONTEXT_BITS) - 1, count, seats)
    return shard, np.split(at, np.cumsum([len(w) for w in word])[:-1])


def totalled(asked: DataFrame) -> DataFrame:
    """``slot, part, c, t``: for each shard's contexts of a range (``slot, part, names, c, t``) the sums over all shards."""

    def added(table: pa.Table) -> pa.Table:
        names = [np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in table.column("names").to_pylist()]
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        edges = np.cumsum([len(x) for x in names])[:-1]
        columns = [table.column("slot"), table.column("part")]
        for k in ("c", "t"):
            own = np.concatenate([unpack(x, "<u8") for x in table.column(k).to_pylist()])
            sums = np.bincount(at, own, len(every)).astype("<u8")
            columns.append(pa.array([pack(x) for x in np.split(sums[at], edges)], pa.binary()))
        return pa.table(columns, names=["slot", "part", "c", "t"])

    return asked.groupBy("part").applyInArrow(added, "slot long, part int, c binary, t binary")


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, sweeps: int = SWEEPS,
          batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES, seed: int = 1) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text; rows not held out are learned from."""
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("out"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    shards = max(1, -(-size // shard_bytes))
    parts = max(1, shards // SHARDS_A_RANGE)
    with small_batches(spark):
        dealt = bucketed(batches_of(slim, F.col("out"), ["key"], shards, batch_bytes), "pairs", "slot", shards, GROUP_BYTES)
        listed = written(dealt.filter(F.col("slot") >= shards).select("slot", "docs"), "batches", GROUP_BYTES)
    pairs = dealt.filter(F.col("slot") < shards).select("slot", "batch", "a", "b", "c")

    sums_type = pa.struct([("level", pa.int32()), ("context", pa.int32()), ("c", pa.float64()), ("t", pa.float64())])
    seats_type = pa.struct([("tables", pa.binary()), ("sizes", pa.binary())])
    asks_type = pa.schema([
        ("slot", pa.int64()), ("part", pa.int32()), ("names", pa.binary()), ("c", pa.binary()), ("t", pa.binary()),
        ("sums", pa.list_(sums_type)), ("seats", pa.list_(seats_type)),
    ])
    seats_schema = "array<struct<tables: binary, sizes: binary>>"
    asks = f"slot long, part int, names binary, c binary, t binary, sums array<struct<level: int, context: int, c: double, t: double>>, seats {seats_schema}"

    def asking(slot: int, shard: Shard, seats: list[dict] | None) -> pa.Table:
        """A row of the shard's seating and its sums of the contexts above words, and a row for each range of its words as contexts."""
        rows = [{"level": -1, "context": 0, "c": float((shard.count > 0).sum()), "t": 0.0}]  # distinct training words
        totals = shard.sums()
        for level, (c, t) in enumerate(totals[:2]):
            at = np.flatnonzero(c)
            rows += [{"level": level, "context": k, "c": x, "t": y} for k, x, y in zip(at.tolist(), c[at].tolist(), t[at].tolist())]
        out = [{"slot": slot, "part": -1, "sums": rows, "seats": seats}]
        names, c, t = shard.names.astype("<u8"), totals[2][0].values.astype("<u8"), totals[2][1].values.astype("<u8")
        part = (shard.names >> 8) * parts >> 32
        edge = np.searchsorted(part, np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            i, j = edge[k], edge[k + 1]
            out.append({"slot": slot, "part": k, "names": pack(np.diff(names[i:j], prepend=np.uint64(0))), "c": pack(c[i:j]), "t": pack(t[i:j])})
        return pa.Table.from_pylist(out, schema=asks_type)

    def shard_of(rows: pa.Table, seats: list[Seating] | None = None) -> tuple[int, list[int], Shard, list[np.ndarray]]:
        rows = rows.sort_by("batch")
        shard, places = opened(list(zip(*(rows.column(x).to_pylist() for x in "abc"))), seats)
        return rows.column("slot")[0].as_py(), rows.column("batch").to_pylist(), shard, places

    def first(rows: pa.Table) -> pa.Table:
        slot, _, shard, _ = shard_of(rows)
        return asking(slot, shard, None)

    def above(asked: DataFrame) -> tuple[list, int]:
        """The sums of the contexts above words, one row each to the driver, and the number of training words."""
        totals = [(np.zeros(n), np.zeros(n)) for n in CONTEXTS]
        words = 0
        own = asked.filter("part < 0").select(F.explode("sums").alias("s")).select("s.*")
        for r in own.groupBy("level", "context").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect():
            if r.level < 0:
                words = int(r.c)
            else:
                totals[r.level][0][r.context], totals[r.level][1][r.context] = r.c, r.t
        return totals, words

    def over_shards(work, schema: str, asked: DataFrame, totals: list) -> DataFrame:
        """``work(slot, batches, shard, places, totals)`` of every shard, seated as ``asked`` left it, with the totals that it asked for."""
        state = spark.sparkContext.broadcast(totals)

        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            told = told.sort_by("part").to_pylist()
            left = [Seating.unpacked(x) for x in told[0]["seats"]] if told[0]["seats"] else None
            slot, batches, shard, places = shard_of(rows, left)
            sums = (Named(shard.names, np.concatenate([unpack(x[k], "<u8") for x in told[1:]]).astype(np.float64)) for k in ("c", "t"))
            return work(slot, batches, shard, places, [*state.value, tuple(sums)])

        replies = totalled(asked.filter("part >= 0").select("slot", "part", "names", "c", "t")).withColumn("seats", F.lit(None).cast(seats_schema))
        told = asked.filter("part < 0").select("slot", "part", "c", "t", "seats").union(replies)
        return pairs.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(run, schema)

    with small_batches(spark, 1):  # rows of a shard's pairs, met shard by shard
        asked = written(pairs.groupBy("slot").applyInArrow(first, asks), "asks", GROUP_BYTES)
    totals, words = above(asked)
    base = 1 / (words + 1)

    def refreshing(number: int):
        def refresh(slot: int, batches: list[int], shard: Shard, places: list[np.ndarray], totals: list) -> pa.Table:
            rng = np.random.default_rng([seed, number, slot])
            for _ in range(sweeps):
                shard.sweep(rng, totals, base)
            return asking(slot, shard, [s.packed() for s in shard.seats])

        return refresh

    # burn-in: each round goes on from the seating that the one before has written
    for number in range(rounds - 1):
        with small_batches(spark, 1):
            asked = written(over_shards(refreshing(number), asks, asked, totals), "seats", GROUP_BYTES)
        totals, _ = above(asked)

    def answer(slot: int, batches: list[int], shard: Shard, places: list[np.ndarray], totals: list) -> pa.Table:
        rng = np.random.default_rng([seed, rounds, slot])
        p = np.zeros(len(shard.up2))
        for _ in range(0 if rounds > 1 else sweeps):  # no round before this one: its burn-in
            shard.sweep(rng, totals, base)
        for _ in range(sweeps):
            shard.sweep(rng, totals, base)
            p += shard.probabilities(totals, base)[2]
        log_p = np.log10(p / sweeps).astype("<f4")
        count = shard.count[shard.up1[shard.up2]].astype("<u4")
        columns = [pa.array([shards + x for x in batches], pa.int64()), pa.array([slot] * len(batches), pa.int64())]
        columns += [pa.array([pack(x[at]) for at in places], pa.binary()) for x in (log_p, count)]
        return pa.table(columns, names=["slot", "shard", "p", "n"])

    answers = over_shards(answer, "slot long, shard long, p binary, n binary", asked, totals)
    train = F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + F.when(d["held_out"], 0).otherwise(d["n"]))
    tokens_all = listed.agg(F.sum(train).alias("n")).first().n or 0
    right = answers.withColumn("docs", F.lit(None).cast(listed.schema["docs"].dataType)).union(
        listed.select("slot", F.lit(-1).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("binary"), "docs"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """A batch's documents summed from the answers to its pairs."""
        right = right.sort_by("shard")
        listed = right.column("docs")[:1].combine_chunks().flatten()
        log_p = np.concatenate([unpack(x, "<f4") for x in right.column("p").to_pylist()[1:]]).astype(np.float64)
        count = np.concatenate([unpack(x, "<u4") for x in right.column("n").to_pylist()[1:]]).astype(np.float64)
        at = unpack(left.column("a")[0].as_py(), "<u4")
        n = listed.field("n").to_numpy(zero_copy_only=False)
        begin = np.cumsum(n) - n
        plain = np.log10((count + 0.1) / (tokens_all + 0.1 * (words + 1)))
        columns = [listed.field(0), listed.field(1), pa.array(n)]
        columns.append(pa.array(np.add.reduceat((count > 0)[at].astype(np.int64), begin)))
        columns.append(pa.array(np.full(len(n), int(tokens_all), np.int64)))
        columns += [pa.array(np.add.reduceat(x[at], begin)) for x in (plain, log_p)]
        return pa.table(columns, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = slim.schema["key"].dataType.simpleString()
    documents = dealt.filter(F.col("slot") >= shards).select("slot", "a")
    return documents.groupBy("slot").cogroup(right.groupBy("slot")).applyInArrow(
        finish, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
