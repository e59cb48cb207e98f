import random

from pyspark.sql import functions as F

from tidewater.llm import simhash
from tests.conftest import SF_SMALL
from tests.llm import helpers


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " ".join(rng.choice(["Alpha", "beta", "ümlaut", "x", " y"]) for _ in range(n))
        assert simhash.fingerprint(t) == helpers.simhash(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t ") == 0


def expected(rows):
    fp = [helpers.simhash(t) for _, t in rows]
    root = helpers.groups(len(rows), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 3)
    out = []
    for (d, _), f, r in zip(rows, fp, root):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None]
        out.append((d, f"{f:016x}", min(ids, default=None)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]), key=key)


def test_chains_and_dense_groups(spark):
    """Chains of links, a ball of close fingerprints and random ones, with chunks far smaller than the buckets."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {0, 1, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(50)}
    x = rng.getrandbits(64)
    for _ in range(25):  # a chain: each step flips three bits
        for _ in range(3):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    for _ in range(120):
        fps.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    root = helpers.groups(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    want = {}
    for s, r in zip(signed, root):
        want.setdefault(r, set()).add(s)
    for chunk, blocks in ((4096, 5), (8, 5), (16, 6)):
        label = {r.node: r.label for r in simhash.components(simhash.links(nodes, 3, blocks, chunk)).collect()}
        got = {}
        for s in signed:
            got.setdefault(label.get(s, s), set()).add(s)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edge_rows(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs().collect()]
    got = [tuple(r) for r in simhash.near_duplicates(edge_docs()).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    empty = edge_docs().filter(F.lit(False))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_drop_keeps_one_of_each_group(spark, edge_docs):
    docs = edge_docs("component")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    # 1, 2, 2 are one group; 3, 4, 5 and the null row have fingerprint zero
    assert ids == [1, 3, 7, 8, 9, None]


def test_drop_keeps_clashing_columns_and_breaks_ties(spark):
    rows = [(1, "a b c d", 5, "p"), (1, "a b c d", 6, "q"), (2, "quite another text here", 7, "r"), (None, None, 8, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __num long, row_key string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert len(got) == 3 and set(got) <= set(rows)
    again = simhash.drop_near_duplicates(docs.repartition(4)).collect()
    assert sorted(map(tuple, again), key=repr) == got


def test_links_inside_a_component_are_met_once(spark):
    """Only links between labels go on to the next round, and the components are those of all links."""
    rng = random.Random(9)
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1064)] + [(2000, 2000)]
    pairs += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    nodes = sorted({x for p in pairs for x in p})
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert labels == {x: top(x) for x in nodes}
    star = spark.createDataFrame([(i, 0) for i in range(300)] + [(400, 0)], "node long, label long")
    halves = spark.createDataFrame([(i, i % 2) for i in range(300)], "node long, label long")
    assert simhash.between(edges, star).isEmpty()
    assert [tuple(r) for r in simhash.between(edges.filter("b < 300"), halves).collect()] == [(0, 1)]


def test_few_links_take_a_task_a_core(spark):
    """Whatever the number of shuffle partitions, a step over few links has a task for each core."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rng = random.Random(3)
    edges = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)]
    rows = spark.createDataFrame(edges, "a long, b long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        labels = simhash.components(rows)
        assert labels.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.label for r in labels.collect()} == least
