"""Case-insensitive containment join (JN-4) without a nested loop.

Semantics: a text ``t`` matches a pattern ``p`` when
``lower(t) LIKE '%' || lower(p) || '%'`` -- ``_`` and ``%`` inside ``p``
keep their LIKE meaning, a backslash is an ordinary character.

Plan: every literal (wildcard-free) window of ``p`` must occur verbatim in
``t``.  So each pattern gets one *block*: its rarest literal n-gram
(n = 3, or 2 / 1 for patterns with shorter literal runs); texts are
exploded into their n-grams; candidates come from an equi-join on the gram
and are verified with LIKE.  Exact (no candidate cap), and the work is
proportional to the true candidate set, not to |texts| x |patterns|.

How many texts hold a gram is counted beforehand, in ``SLOTS`` slots of a hash
(a slot counts at least as many as each of its grams): one array of fixed size,
a scalar subquery of the same plan, that both sides look up.  It picks the
rarest gram without a join, and a gram of more than ``SPLIT_ABOVE`` texts is
split: its texts are dealt over so many salts, its patterns go to all of them.

Patterns made only of wildcards (or empty) match every text at least as
long as their ``_`` count.  Where only the first target is wanted they need no
pairs: the least target per ``_`` count (or text length), a running minimum over
the lengths (one row a length), and an equi-join on the length.  Where all
pairs are wanted, each such pattern lists the lengths from its ``_`` count up to
the longest text of the other side and meets the texts on their exact length.

Both directions of a symmetric containment test ("a in b or b in a") run
in one pass: every string is a text and a pattern at once, tagged with its
side, and a text only meets patterns of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir

_WILD = "[_%]"
MAX_GRAM = 3
SLOTS = 1 << 14
SPLIT_ABOVE = 4096


def _grams(text_col: Column, k: int) -> Column:
    """Distinct k-grams of a string column as array<struct<k, gram>>."""
    n = F.length(text_col) - F.lit(k - 1)
    seq = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    arr = F.array_distinct(F.transform(seq, lambda i: F.substr(text_col, i, F.lit(k))))
    arr = F.when(F.length(text_col) >= F.lit(k), arr).otherwise(F.array().cast("array<string>"))
    return F.transform(arr, lambda g: F.struct(F.lit(k).alias("k"), g.alias("gram")))


def _text_keys(lt: Column) -> Column:
    """All (k, gram) keys a text offers: its distinct 1..3-grams."""
    return F.concat(*[_grams(lt, k) for k in range(1, MAX_GRAM + 1)])


def _pattern_keys(lp: Column) -> Column:
    """Candidate blocks of a pattern: its literal (wildcard-free) grams."""
    return F.concat(*[F.filter(_grams(lp, k), lambda s: ~s["gram"].rlike(_WILD)) for k in range(1, MAX_GRAM + 1)])


def _wild_only(lp: Column) -> Column:
    return ~lp.rlike("[^_%]")


def _like_contains(lt: Column, lp: Column) -> Column:
    # Backslash is literal in the reference LIKE; Spark treats it as escape.
    escaped = F.regexp_replace(lp, F.lit("\\\\"), F.lit("\\\\\\\\"))
    return F.like(lt, F.concat(F.lit("%"), escaped, F.lit("%")))


def _lowered(strings: DataFrame) -> DataFrame:
    return strings.where(F.col("value").isNotNull()).select("value", "side", F.lower("value").alias("lv"))


def _slot(side: Column, gram: Column) -> Column:
    return (F.pmod(F.xxhash64(side, gram), F.lit(SLOTS)) + 1).cast("int")


def _slot_counts(text_keys: DataFrame) -> DataFrame:
    """One row, one array: how many text grams fall into each slot."""
    spark = text_keys.sparkSession
    counts = text_keys.groupBy(_slot(F.col("tside"), F.col("gram")).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    dense = spark.range(1, SLOTS + 1).join(counts, F.col("id") == F.col("slot"), "left")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n"))))
    return dense.agg(F.transform(pairs, lambda x: x["n"]).alias("counts"))


def _literal_hits(s: DataFrame, split_above: int) -> DataFrame:
    """(text, tside, pattern) for patterns with a literal gram."""
    text_keys = s.select(
        F.col("value").alias("text"), F.col("side").alias("tside"), F.col("lv").alias("lt"),
        F.explode(_text_keys(F.col("lv"))).alias("key"),
    ).select("text", "tside", "lt", F.col("key.gram").alias("gram"))
    counts = _slot_counts(text_keys.select("tside", "gram")).scalar()
    freq = F.element_at(counts, _slot(F.col("tside"), F.col("gram")))
    salts = F.ceil(F.col("freq") / F.lit(split_above)).cast("int")

    pat_keys = s.select(
        F.col("value").alias("pattern"), (F.lit(1) - F.col("side")).alias("tside"), F.col("lv").alias("lp"),
        F.explode(_pattern_keys(F.col("lv"))).alias("key"),
    ).select("pattern", "tside", "lp", F.col("key.k").alias("k"), F.col("key.gram").alias("gram")).withColumn("freq", freq)
    # Longest literal n first, then rarest; a gram no text holds finds none.
    order = F.struct((-F.col("k")).alias("nk"), "freq", "gram")
    block = pat_keys.groupBy("pattern", "tside", "lp").agg(F.min_by(F.struct("gram", "freq"), order).alias("b")).select(
        "pattern", "tside", "lp", F.col("b.gram").alias("gram"), F.col("b.freq").alias("freq")).where("freq > 0")
    block = block.select("pattern", "tside", "lp", "gram", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = text_keys.withColumn("freq", freq).select("text", "tside", "lt", "gram", F.pmod(F.xxhash64("text"), salts).cast("int").alias("salt"))
    cand = block.join(dealt, ["tside", "gram", "salt"])
    return cand.where(_like_contains(F.col("lt"), F.col("lp"))).select("text", "tside", "pattern")


def _wild(s: DataFrame) -> DataFrame:
    """Patterns without a literal, with the length ``need`` that they ask of a text."""
    return s.where(_wild_only(F.col("lv"))).select(
        F.col("value").alias("pattern"), (F.lit(1) - F.col("side")).alias("tside"), F.col("lv").alias("lp"),
        F.length(F.regexp_replace("lv", "[^_]", "")).alias("need"),
    )


def tagged_containment(strings: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Containment pairs between the two sides of a tagged string set.

    ``strings(value, side)`` with ``side`` in {0, 1}.  Returns distinct
    ``(text, text_side, pattern)`` where the pattern (from the other side)
    is contained in the text.
    """
    s = _lowered(strings)
    hit = _literal_hits(s, split_above).unionByName(_wild_candidates(s, _wild(s)).select("text", "tside", "pattern"))
    return hit.select("text", F.col("tside").alias("text_side"), "pattern").distinct()


def _least_over_lengths(known: DataFrame, asked: DataFrame, longest_first: bool) -> DataFrame:
    """(len, best) for the lengths ``asked(len)``: the least ``known(len, best)`` of lengths up to it, or from it on.

    The running minimum meets one row a distinct length, whatever the number of strings.
    """
    rows = known.groupBy("len").agg(F.min("best").alias("best")).unionByName(
        asked.select("len").distinct().withColumn("best", F.lit(None).cast("string")))
    rows = rows.groupBy("len").agg(F.min("best").alias("best"))
    order = Window.orderBy(F.desc("len") if longest_first else F.asc("len"))
    return rows.withColumn("best", F.min("best").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("best").isNotNull())


def least_contained(strings: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(name, best): for each string of side 0 the least string of side 1 that contains it or is contained in it."""
    s = _lowered(strings)
    hits = _literal_hits(s, split_above)
    literal = hits.select(
        F.when(F.col("tside") == 0, F.col("text")).otherwise(F.col("pattern")).alias("name"),
        F.when(F.col("tside") == 0, F.col("pattern")).otherwise(F.col("text")).alias("best"))
    names = s.where("side = 0").select(F.col("value").alias("name"), F.length("lv").alias("len"))
    targets = s.where("side = 1").select(F.col("value").alias("best"), F.length("lv").alias("len"))
    wild = _wild(s)
    # targets without a literal: the least one that asks no more than the name's length
    wild_targets = wild.where("tside = 0").select(F.col("need").alias("len"), F.col("pattern").alias("best"))
    by_target = names.join(_least_over_lengths(wild_targets, names, False), "len").select("name", "best")
    # names without a literal: the least target that is long enough
    wild_names = wild.where("tside = 1").select(F.col("need").alias("len"), F.col("pattern").alias("name"))
    by_name = wild_names.join(_least_over_lengths(targets, wild_names, True), "len").select("name", "best")
    return literal.unionByName(by_target).unionByName(by_name).groupBy("name").agg(F.min("best").alias("best"))


def _wild_candidates(s: DataFrame, wild: DataFrame) -> DataFrame:
    """(text, tside, lt, pattern, lp) for wildcard-only patterns: texts of the
    other side whose length is at least the pattern's ``_`` count."""
    text_len = s.select(
        F.col("value").alias("text"), F.col("side").alias("tside"), F.col("lv").alias("lt"),
        F.length("lv").alias("len"),
    )
    longest = text_len.groupBy("tside").agg(F.max("len").alias("max_len"))
    wild_lengths = wild.join(longest, "tside", "inner").where(F.col("need") <= F.col("max_len")).select(
        "pattern", "tside", "lp", F.explode(F.sequence(F.col("need"), F.col("max_len"))).alias("len")
    )
    return wild_lengths.join(text_len, ["tside", "len"], "inner").select("text", "tside", "lt", "pattern", "lp")


def containment_pairs(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """All distinct ``(text, pattern)`` where the text contains the pattern."""
    tagged = texts.select(F.col(text_col).alias("value"), F.lit(0).alias("side")).unionByName(
        patterns.select(F.col(pattern_col).alias("value"), F.lit(1).alias("side"))
    ).distinct()
    pairs = tagged_containment(tagged)
    return pairs.where(F.col("text_side") == 0).select("text", "pattern")


def first_containment_match(
    groups: DataFrame,
    keys: list[str],
    name_cols: list[str],
    targets: DataFrame,
    target_col: str,
    target_order: list[str],
) -> DataFrame:
    """For each ``keys`` group: the first target (by ``target_col`` then
    ``target_order``) whose name contains, or is contained in, any of the
    group's ``name_cols`` values.

    Returns ``keys`` + every column of ``targets`` for matched groups only.
    ``groups`` should be a small, already distinct frame; facts are never
    paired with targets.
    """
    names = None
    for c in name_cols:
        n = groups.select(*keys, F.col(c).alias("name"))
        names = n if names is None else names.unionByName(n)

    tagged = (
        names.select(F.col("name").alias("value"), F.lit(0).alias("side"))
        .unionByName(targets.select(F.col(target_col).alias("value"), F.lit(1).alias("side")))
        .distinct()
    )
    # the distinct names of both sides, met by every branch of the join: cut once into the shared folder
    checkpoint_dir(groups.sparkSession)
    best = names.join(least_contained(tagged.checkpoint()), "name").groupBy(*keys).agg(F.min("best").alias(target_col))

    other = [c for c in targets.columns if c != target_col]
    first_target = (
        targets.where(F.col(target_col).isNotNull())
        .groupBy(target_col)
        .agg(F.min_by(F.struct(*other), F.struct(*target_order)).alias("_t"))
        .select(target_col, *[F.col(f"_t.{c}").alias(c) for c in other])
    )
    return best.join(first_target, target_col, "inner")
