"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Texts are range-partitioned by key, encoded, and each partition is written as
one triple of files in the shared folder:

* ``NAME.ids``  every id of the partition, little-endian, unsigned 16 bits if
  the vocabulary fits, else 32 bits;
* ``NAME.off``  n + 1 unsigned 64-bit offsets (in ids) into that file;
* ``NAME.key``  n signed 64-bit keys, ascending; null keys come first and are
  stored as 0, their number is in the manifest.

``manifest.json`` lists the files in key order with the base of each (the
prefix sum of the ids before it), so a reader maps any file on its own.  A
task writes under a name of its own attempt and only the names that Spark
returned from successful tasks enter the manifest: a lost executor or a
speculative copy leaves at most an unlisted file.

Byte-level BPE never merges across the cut before a single space that stands
between two non-space characters, so a text is cut there and each distinct
piece is encoded once per worker; ids are those of the whole text (tested).

Defined results: a null text counts as empty and has the end id alone; a very
long text is encoded whole, its pieces remembered like any; the ids are those of
the library's plain call, so a text that spells an added token has its id; rows
with equal keys stand next to each other; an empty table gives a manifest
without files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import small_batches

#: Marks a text's first piece, which has no space before it.
FIRST = "\uf8ff"
#: White space beside a space, where a space is no cut; texts with it, or with the mark, are cut by ``CUT``.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20)
BESIDE = f"[ {WHITE}] | [{WHITE}]|^ | $|{FIRST}"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of a generation; a Python worker remembers two (about 150 bytes a piece).
REMEMBERED = 250_000
DOCS_AT_ONCE = 4096
#: Bytes of the texts encoded together.
RUN_BYTES = 2 << 20


class Pieces:
    """Remembered pieces: a number for each, and the ids of all in one growing array."""

    def __init__(self, dtype: np.dtype, end_id: int):
        self.number: dict[str, int] = {}
        # number 0 is the end of a text
        self.ids, self.used = np.full(1 << 16, end_id, dtype), 1
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        first, last = len(self.number) + 1, len(self.number) + 1 + len(pieces)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.zeros(self.used + len(ids), self.ids.dtype))
        if last > len(self.begin):
            self.begin, self.length = (np.append(x[:first], np.zeros(last, np.int64)) for x in (self.begin, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[first:last], self.length[first:last] = self.used + np.cumsum(length) - length, length
        self.used += len(ids)
        self.number.update(zip(pieces, range(first, last)))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces, one after the other, and the end of each in them."""
        length = self.length[numbers]
        end = np.cumsum(length)
        at = np.repeat(self.begin[numbers] - (end - length), length)
        at += np.arange(len(at))
        return self.ids[at], end


class Encoder:
    """Encodes whole texts piece by piece with a ``tokenizers`` file, each followed by ``end_id``.

    Texts are cut and their distinct pieces found by Arrow; Python sees each
    distinct piece of a run of texts once.  A full generation of remembered
    pieces becomes the old one; what is met again is carried over from there.
    """

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end_id = end_id
        self.now, self.old = Pieces(self.dtype, end_id), Pieces(self.dtype, end_id)
        # texts that hold an added token, such as <|endoftext|>, are encoded whole
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = "|".join([BESIDE, *map(re.escape, self.whole)])
        # a byte-level vocabulary spells each byte as one character
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(token)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def learn(self, new: list[str]) -> None:
        """Encode pieces in one go, each after its space, and cut the ids apart by the bytes that they stand for."""
        firsts = [p for p in new if p[:1] == FIRST]
        ids = [self.plain(p[1:]) for p in firsts]
        length = [len(x) for x in ids]
        rest = [p for p in new if p[:1] != FIRST]
        if rest:
            text = " " + " ".join(rest)
            begin = np.flatnonzero(np.frombuffer(text.encode("utf-8"), np.uint8) == 32)
            if len(begin) > len(rest):  # pieces of a text cut by ``CUT`` hold spaces
                size = np.fromiter((len(p.encode("utf-8")) + 1 for p in rest), np.int64, len(rest))
                begin = np.cumsum(size) - size
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            at = np.cumsum(self.bytes_of[found]) - self.bytes_of[found]
            ids.append(found)
            length.extend(np.diff(np.append(np.searchsorted(at, begin), len(at))).tolist())
        self.now.add(firsts + rest, np.concatenate(ids), np.array(length, np.int64))

    def numbers_of(self, distinct: list[str]) -> np.ndarray:
        """The numbers of distinct pieces in the present generation."""
        if len(self.now.number) >= REMEMBERED:
            self.now, self.old = Pieces(self.dtype, self.end_id), self.now
        known = self.now.number
        found = list(map(known.get, distinct))
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            before = self.old.number
            again = [p for i in missing if (p := distinct[i]) in before]
            if again:
                numbers = np.fromiter(map(before.get, again), np.int64, len(again))
                self.now.add(again, self.old.gather(numbers)[0], self.old.length[numbers])
            new = [p for i in missing if (p := distinct[i]) not in before]
            if new:
                self.learn(new)
            for i in missing:
                found[i] = known[distinct[i]]
        return np.array(found, np.int64)

    def one(self, text: str) -> np.ndarray:
        """The ids of a text whose spaces are not all cuts, with the end id."""
        if FIRST in text or any(t in text for t in self.whole):
            return np.append(self.plain(text), np.array(self.end_id, self.dtype))
        first, *rest = CUT.split(text)
        ids = [self.plain(first)]
        distinct = list(dict.fromkeys(rest))
        if rest:
            numbers = dict(zip(distinct, self.numbers_of(distinct).tolist()))
            ids.append(self.now.gather(np.fromiter((numbers[p] for p in rest), np.int64, len(rest)))[0])
        return np.append(np.concatenate(ids), np.array(self.end_id, self.dtype))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a string array, end ids included, and how many each text has."""
        slow = pc.match_substring_regex(texts, self.slow)
        marked = pc.binary_join_element_wise(FIRST, pc.if_else(slow, "", texts), "")
        cut = pc.split_pattern(marked, " ")
        pieces = cut.flatten().dictionary_encode()
        numbers = self.numbers_of(pieces.dictionary.to_pylist())
        count = pc.list_value_length(cut).to_numpy().astype(np.int64)
        sequence = np.zeros(len(pieces) + len(texts), np.int64)
        sequence[np.arange(len(pieces)) + np.repeat(np.arange(len(texts)), count)] = numbers[pieces.indices.to_numpy()]
        ids, end = self.now.gather(sequence)
        length = np.diff(end[np.cumsum(count + 1) - 1], prepend=0)
        if not pc.any(slow).as_py():
            return ids, length
        parts, at, edge = [], 0, np.cumsum(length)
        for i in np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist():
            parts += [ids[at : edge[i] - length[i]], self.one(texts[i].as_py())]
            at, length[i] = edge[i], len(parts[-1])
        return np.concatenate([*parts, ids[at:]]), length


@lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, end_id)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, out: str, tokenizer_file: str, end_id: int = 0,
                      key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encode every text, write the files under ``out`` and return the manifest's entries.

    ``tokenizer_file`` is a file of the public tokenizers package (found on
    each executor) or a path that all executors see.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = tokenizer_file if "/" in tokenizer_file else public_tokenizers.path(tokenizer_file)
        encoder, sink = None, {}
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        offsets, nulls, at = [0], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(path, end_id)
                store, folder = filesystem(out)
                store.create_dir(folder, recursive=True)
                sink = {x: store.open_output_stream(f"{folder}/{name}.{x}") for x in ("ids", "off", "key")}
                sink["off"].write(np.zeros(1, "<u8").tobytes())
            width = encoder.dtype.itemsize
            keys = batch.column(0)
            nulls += keys.null_count
            sink["key"].write(keys.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            ends = []
            run = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // RUN_BYTES
            edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:]):
                ids, length = encoder.encode(batch.column(1).slice(a, b - a))
                sink["ids"].write(ids.tobytes())
                ends.append(at + np.cumsum(length))
                at = int(ends[-1][-1])
            sink["off"].write(np.concatenate(ends).astype("<u8").tobytes())
            offsets[0] += batch.num_rows
        for stream in sink.values():
            stream.close()
        if sink:
            row = [[part], [name], [width], [offsets[0]], [nulls], [at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "name", "width", "docs", "nulls", "ids"])

    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        # the salt lets equal keys spread over partitions
        .withColumn("salt", F.rand(7)).repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("key", "text")
    )
    with small_batches(spark):
        rows = ordered.mapInArrow(write, "part long, name string, width long, docs long, nulls long, ids long").collect()
    base, files = 0, []
    for r in sorted(rows, key=lambda r: r["part"]):  # one row a file
        files.append(r.asDict() | {"base": base})
        base += r["ids"]
    store, folder = filesystem(out)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "ids": base, "files": files}).encode())
    return files


def mapped(store, path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped if local, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``."""
    store, folder = filesystem(out)
    with store.open_input_file(f"{folder}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                store, folder = filesystem(out)
                ids = mapped(store, f"{folder}/{f['name']}.ids", f"<u{f['width']}")
                offsets = mapped(store, f"{folder}/{f['name']}.off", "<u8")
                keys = mapped(store, f"{folder}/{f['name']}.key", "<i8")
                for a in range(0, f["docs"], DOCS_AT_ONCE):
                    b = min(a + DOCS_AT_ONCE, f["docs"])
                    at = offsets[a : b + 1].astype(np.int64)
                    null = np.arange(a, b) < f["nulls"]
                    part = [ids[s:e].astype("<u4") for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                    columns = [
                        pa.array(np.array(keys[a:b], np.int64), mask=null), pa.array(at[:-1] + f["base"]),
                        pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in part], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in part], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    listed = spark.createDataFrame(
        [(f["name"], f["width"], f["docs"], f["nulls"], f["base"]) for f in files],
        "name string, width long, docs long, nulls long, base long",
    )
    return listed.repartition(max(1, len(files))).mapInArrow(read, schema)
