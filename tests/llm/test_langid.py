import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid
from tests.conftest import SF_SMALL

SAMPLES = {
    "aa": [b"the cat sat on the mat " * 6, b"that is the hat of the cat"],
    "bb": ["der hund läuft über die straße ".encode() * 6, b"und der hund ist alt"],
}


def brute(texts, text):
    """PPM code length of one text, byte by byte, straight from the definition."""
    led = [b"   " + t for t in texts]
    counts = {}
    for t in led:
        for i in range(3, len(t)):
            for n in range(4):
                counts.setdefault(t[i - n : i], {}).setdefault(t[i], 0)
                counts[t[i - n : i]][t[i]] += 1
    kept = {c: x for c, x in counts.items() if sum(x.values()) >= langid.LEAST_COUNT}

    def dist(context):
        if context not in kept:
            return dist(context[1:]) if context else [1 / 256] * 256
        seen = kept[context]
        total, distinct = sum(seen.values()), len(seen)
        short = dist(context[1:]) if context else [1 / 256] * 256
        left = sum(p for b, p in enumerate(short) if b not in seen)
        return [seen[b] / (total + distinct) if b in seen else short[b] * distinct / (total + distinct) / left for b in range(256)]

    t = b"   " + text
    return sum(-math.log(dist(t[i - 3 : i])[t[i]]) for i in range(3, len(t)))


def test_code_lengths_match_brute_force():
    model = langid.Model(SAMPLES)
    texts = [b"", b"t", b"the cat", "straße über zzz".encode(), b"\x01\xff\xfe??", b"HUND und cat \n"]
    got = model.totals(texts)
    for i, t in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute(SAMPLES[name], t), rel=1e-5, abs=1e-5)


def test_long_texts_are_cut_without_loss(monkeypatch):
    from tidewater.llm import common

    model = langid.Model(SAMPLES)
    t = b"the cat sat on the hund " * 50
    whole = model.totals([t, b"x", t])
    monkeypatch.setattr(langid, "byte_runs", lambda texts, lead: common.byte_runs(texts, lead, 37))
    assert np.allclose(model.totals([t, b"x", t]), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    samples = langid.train(docs.filter("doc_id % 2 = 0"))
    got = langid.identify(docs, samples, F.col("doc_id"), F.col("lang")).filter("doc_id % 2 = 1").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("lang_pred")
    samples = langid.train(docs)
    assert set(samples) == {"en", "la", "de"}
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, samples, F.col("doc_id")).collect()}
    assert {(d, p) for d, p, _ in got if d in (3, 4, 5)} == {(3, "und"), (4, "und"), (5, "und")}
    assert (7, "la") in {(d, p) for d, p, _ in got} and all(p in samples or p == "und" for _, p, _ in got)
    assert langid.identify(docs.filter(F.lit(False)), samples).count() == 0
    nothing = langid.identify(docs, langid.train(docs.filter(F.lit(False))), F.col("doc_id")).collect()
    assert len(nothing) == 11 and {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_one_long_text_pushes_out_no_label(spark):
    """Three rows of a rare language, one of them far above the bound; and many short rows beside a long one."""
    from tidewater.llm.common import labelled_sample

    long = "langer satz mit vielen worten " * 40_000
    for first in range(0, 300, 10):
        rows = [(first, "kurzer satz", "de"), (first + 1, long, "de"), (first + 2, "noch ein satz", "de")]
        rows += [(first + 1000 + i, f"short text number {i}", "en") for i in range(40)] + [(first + 2000, "long " * 100_000, "en")]
        if first == 0:
            docs = rows
        else:
            docs = docs + [(k, t, f"{v}{first}") for k, t, v in rows[:3]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    drawn, shares = labelled_sample(frame, frame.select("doc_id", "lang"), "lang", 500, 20_000)
    sizes = {}
    for r in drawn:
        sizes.setdefault(r.label, []).append(len(r.text.encode()))
    assert {v: len(x) for v, x in sizes.items()} == {**{f"de{i}": 3 for i in range(10, 300, 10)}, "de": 3, "en": 41}
    assert all(s == 1 for s in shares.values()) and all(max(x) <= 1250 and sum(x) <= 20_000 for x in sizes.values())
    few, shares = labelled_sample(frame, frame.select("doc_id", "lang"), "lang", 500, 200)
    kept = [r for r in few if r.label == "en"]
    assert 1 <= len(kept) < 41 and sum(len(r.text) for r in kept) <= 200 and shares["en"] == len(kept) / 41
    assert len({r.label for r in few}) == len(sizes)


def test_texts_without_a_letter():
    for t in ("", "½", "² Ⅷ ¼ 12 _", "!? 漢"[:2], "٣ 3"):
        assert not langid.has_letter(t)
    for t in ("½ a", "漢", "é", "²²²ß"):
        assert langid.has_letter(t)
    model = langid.Model({"en": [b"the cat sat on the mat " * 9]})
    assert model.predict(["½", "the cat"])[0] == ["und", "en"]
