"""Chat formatting by quotation linking.

A message's lines are parsed into nested quote levels (the number of ``>``
before the text).  Lines of level zero are the message's own words; lines such
as "On Monday Ann wrote:" before a quote belong to the quote.  Quoted lines of
one level in a row are a passage.  Passages, their paragraphs, lines and
sentences and runs of 2, 4, 8, ... neighbouring sentences of a paragraph are
normalised (lower case, single spaces, so re-wrapped quotes still match) and
hashed, as are those of every message's own words; any run of sentences holds
one such run of more than half of them.  Less than a sentence of a longer line
links nothing.  A quoted unit is joined to the earliest message of the same
conversation that says it in its own words before the quoting one.  The parent
of a message is the original of its outermost linked quote; of several, of
the one with the most words, then the latest.

Reply order: a message without a parent opens a thread; a reply belongs to its
parent's thread, found by pointer jumping over the links (about log of the
longest reply chain in rounds).  Sorted by conversation, thread and turn,
every reply stands after its original.  No conversation is ever gathered: the
order is in the columns ``thread_turn`` and ``turn`` and may be produced by a
range-partitioned sort.

Defined results: a null or empty text gives an empty reply; a message of
quotes alone too; a null conversation or turn links to nothing and opens its
own thread; repeated rows come back repeated; equal (conversation, turn) with
different texts share their links' threads; a null role is formatted as
``unknown``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

MARK = re.compile(r"[ \t]*((?:>[ \t]?)*)(.*)", re.S)
ATTRIBUTION = re.compile(r"\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.I)
SENTENCE = re.compile(r"(?<=[.!?]) |(?<=[。！？]) ?")
RUN = "\n"  # no normalised text holds it
SEED = 42


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of every line; attributions take the level of the quote they introduce."""
    out = []
    for line in (text or "").splitlines():
        marks, body = MARK.match(line).groups()
        out.append((marks.count(">"), body.strip()))
    for i in range(len(out) - 2, -1, -1):
        after = next((level for level, body in out[i + 1 :][:2] if body or level > out[i][0]), 0)
        if after > out[i][0] and ATTRIBUTION.search(out[i][1]):
            out[i] = (after, "")
    return out


def plain(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def sentence_runs(paragraph: str) -> set[str]:
    """The sentences, and for runs of 2, 4, 8, ... neighbours ``RUN``, a digest and the number of words."""
    import xxhash

    sentences = [x for x in SENTENCE.split(paragraph) if x]
    found = set(sentences)
    digests = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in sentences]
    words = [x.count(" ") + 1 for x in sentences]
    size = 1
    while 2 * size <= len(sentences):
        digests = [xxhash.xxh3_128_digest(x + y) for x, y in zip(digests, digests[size:])]
        words = [x + y for x, y in zip(words, words[size:])]
        found.update(f"{RUN}{x.hex()}:{n}" for x, n in zip(digests, words))
        size *= 2
    return found


def word_count(unit: str) -> int:
    return int(unit.rpartition(":")[2]) if unit.startswith(RUN) else unit.count(" ") + 1


def units(lines: list[str]) -> set[str]:
    """The whole, the paragraphs, the lines and the runs of sentences of a passage, normalised."""
    found, paragraph = {plain(lines)}, []
    for line in [*lines, ""]:
        if line:
            paragraph.append(line)
            found.add(plain([line]))
        elif paragraph:
            found.add(plain(paragraph))
            found |= sentence_runs(plain(paragraph))
            paragraph = []
    return found - {""}


def parse(text: str | None) -> tuple[str, set[str], dict[str, int], int]:
    """Own words, own units, quoted units with their outermost level, and the number of quoted passages."""
    own, quoted, passages, at, run = [], {}, 0, 0, []

    def close():
        nonlocal passages
        if at and any(run):
            passages += 1
            for u in units(run):
                quoted[u] = min(at, quoted.get(u, at))

    for level, body in levels(text):
        if level != at:
            close()
            at, run = level, []
        if level:
            run.append(body)
        else:
            own.append(body)
    close()
    reply = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    return reply, units(reply.split("\n")), quoted, passages


def parsed(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: ``conv_id, turn, role, reply, quotes`` and the hashes ``own`` and ``quoted`` (with level and words)."""
    rows = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    unit = pa.struct([("h", pa.int64()), ("level", pa.int32()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def code(u: str) -> int:
            h = xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass"), SEED)
            return h - (1 << 64) if h >> 63 else h

        for b in batches:
            found = [parse(t) for t in b.column(3).to_pylist()]
            quoted = [[{"h": code(u), "level": n, "words": word_count(u)} for u, n in sorted(f[2].items())] for f in found]
            columns = [
                *(b.column(i) for i in range(3)), pa.array([f[0] for f in found], pa.string()), pa.array([f[3] for f in found], pa.int32()),
                pa.array([[code(u) for u in sorted(f[1])] for f in found], pa.list_(pa.int64())), pa.array(quoted, pa.list_(unit)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "reply", "quotes", "own", "quoted"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"conv_id {kind}, turn long, role string, reply string, quotes int, own array<long>, quoted array<struct<h: long, level: int, words: int>>"
    )


def parents(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn`` of the parsed messages that have a linked quote."""
    said = (
        messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("own").alias("h"))
        .groupBy("conv_id", "h").agg(F.min("turn").alias("first_turn"))
    )
    asked = messages.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.h", "q.level", "q.words")
    linked = asked.distinct().join(said, ["conv_id", "h"]).filter("first_turn < turn")
    best = F.struct(-F.col("level"), F.col("words"), F.col("first_turn"))
    return linked.groupBy("conv_id", "turn").agg(F.max(best).alias("best")).select("conv_id", "turn", F.col("best.first_turn").alias("parent_turn"))


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, thread_turn``: the first message of the chain of parents."""
    at = links.withColumn("thread_turn", F.col("parent_turn")).checkpoint()
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("above"))
        moved = at.join(up, ["conv_id", "thread_turn"], "left").select(
            "conv_id", "turn", "parent_turn", F.coalesce("above", "thread_turn").alias("thread_turn"), F.col("above").isNotNull().alias("moved")
        ).checkpoint()
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def reply_ordered(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message, sorted into reply order: ``conv_id, thread_turn, turn, role, parent_turn, quotes, reply, formatted``."""
    found = written(parsed(messages, conversation, turn, role, text), "messages")
    placed = threads(parents(found))
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    return (
        found.join(placed, ["conv_id", "turn"], "left")
        .select(
            "conv_id", F.coalesce("thread_turn", "turn").alias("thread_turn"), "turn", "role", "parent_turn", "quotes", "reply",
            F.concat(head, F.col("reply")).alias("formatted"),
        )
        .withColumn("tie", F.rand(11))  # equal rows spread over partitions
        .orderBy("conv_id", "thread_turn", "turn", "tie").drop("tie")
    )
