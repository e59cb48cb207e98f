import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.operators.fuzzy import _literal_hits, _lowered, _slot_counts, first_containment_match, least_contained, tagged_containment


def contains(text, pattern):
    """lower(text) LIKE '%' || lower(pattern) || '%', a backslash being an ordinary character."""
    parts = [".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower()]
    return re.search("".join(parts), text.lower(), re.S) is not None


def least(names, targets):
    out = {}
    for n in names:
        found = [t for t in targets if contains(n, t) or contains(t, n)]
        if found:
            out[n] = min(found)
    return out


def strings(spark, names, targets):
    return spark.createDataFrame([(n, 0) for n in names] + [(t, 1) for t in targets], "value string, side int")


def words(rng, count, alphabet="abAB _%\\", longest=6):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(count)})


@pytest.mark.parametrize("seed, split_above", [(1, 4096), (2, 3), (3, 1)])
def test_least_match_equals_brute_force(spark, seed, split_above):
    """Wildcards on both sides, empty strings, patterns without literals, grams split over many salts."""
    rng = random.Random(seed)
    names, targets = words(rng, 60), words(rng, 40, "abcB_%", 5)
    s = strings(spark, names, targets).unionByName(spark.createDataFrame([(None, 0), (None, 1)], "value string, side int"))
    assert {r.name: r.best for r in least_contained(s, split_above).collect()} == least(names, targets)
    pairs = {(r.text, r.text_side, r.pattern) for r in tagged_containment(s, split_above).collect()}
    assert pairs == {(n, 0, t) for n in names for t in targets if contains(n, t)} | {(t, 1, n) for n in names for t in targets if contains(t, n)}


@pytest.mark.parametrize("targets", [["", "Broadway"], ["__", "%", "Queens Blvd"], ["Main St"], ["nothing here"], []])
def test_targets_without_literals(spark, targets):
    names = ["", "x", "Broadway / W 42 St", "main st", "%", "___", "Q"]
    got = {r.name: r.best for r in least_contained(strings(spark, names, targets)).collect()}
    assert got == least(names, targets)


def test_a_gram_in_many_names_is_split(spark):
    """40 % of the names hold one gram, one street is empty: no key of the join holds more than a share of the names."""
    names = [f"Broadway / St {i}" if i % 5 < 2 else f"q{i} w{i * 7919 % 10007}" for i in range(2000)]
    targets = ["Broadway", "", "St 77", "zzz"]
    s = strings(spark, names, targets)
    assert {r.name: r.best for r in least_contained(s, split_above=100).collect()} == least(names, targets)
    plan = _literal_hits(_lowered(s), 100)
    joined = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in joined and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    counts = _slot_counts(spark.createDataFrame([(0, "bro")] * 800 + [(0, "zzz")], "tside int, gram string")).first().counts
    assert len(counts) == 1 << 14 and sorted(counts)[-2:] == [1, 800]


def test_first_match_takes_the_first_row_of_the_least_target(spark):
    groups = spark.createDataFrame([(1, "Broadway / 1", "Main St"), (2, "nowhere", None), (3, "Main", "Elm")], "id int, a string, b string")
    lanes = spark.createDataFrame([("Main St", 2, "x"), ("Main St", 1, "y"), ("Broadway", 9, "z"), (None, 0, "n")], "street string, seg int, kind string")
    got = first_containment_match(groups, ["id"], ["a", "b"], lanes, "street", ["seg"]).select("id", "street", "seg", "kind")
    assert sorted(map(tuple, got.collect())) == [(1, "Broadway", 9, "z"), (3, "Main St", 1, "y")]
    none = first_containment_match(groups, ["id"], ["a", "b"], lanes.where(F.lit(False)), "street", ["seg"])
    assert none.count() == 0
