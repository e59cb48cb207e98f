import json

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import tokenbin
from tidewater.llm.common import shared_folder
from tests.conftest import SF_SMALL
from tests.llm import helpers

FILE = "byte_bpe_50k.json"


def plain():
    t = Tokenizer.from_file(public_tokenizers.path(FILE))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


def test_pieces_give_the_ids_of_the_whole_text():
    encode, whole = tokenbin.Encoder(public_tokenizers.path(FILE)), plain()
    for s in ["", " ", "a", " a", "a ", "a b", "a  b", "a   b c", "a \n b", "a\n b", "a \nb", "\n\n a", "it's 's x 'll y", "x\t y", "x \ty",
              "12 34 5", "!! ?? a!", "<|endoftext|> a <|endoftext|>", "ñ ü 漢字 かな 🙂 🙂", "a\u00a0 b \u00a0c d", "a \x1c b", "a 's b",
              "x \u3000 y", "🙂 é 🙂a \u200b b", "\u2003 wide \u2009thin", "no\u2028 break", "a \uf8ffmark b", "\uf8ff", "plain words in a row", "foo.\nBar, baz!!\nqux| x",
              "a foo. b,c d.\n e\n\nf g\n1 h.5 i\u0301 don't. x's, Ünï.\nÜnï \u01c5x. ª. ²."]:
        for texts in ([s], [s, "ab " + s, s + " z " + s]):
            ids, length = encode.encode(pa.array(texts))
            for t, got in zip(texts, np.split(ids, np.cumsum(length)[:-1])):
                assert got.tolist() == whole(t), repr(t)


def test_added_tokens_inside_texts():
    encode, whole = tokenbin.Encoder(public_tokenizers.path(FILE)), plain()
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b c  d", "no token here", "<|endoftext"]
    ids, length = encode.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in whole(t)] and length.tolist() == [len(whole(t)) for t in texts]
    assert whole("hello <|endoftext|> x") == [31373, 220, 50256, 2124, 0]


def test_generations_of_pieces(monkeypatch):
    """Far more distinct pieces than are remembered, some met again and again."""
    monkeypatch.setattr(tokenbin, "REMEMBERED", 50)
    encode, whole = tokenbin.Encoder(public_tokenizers.path(FILE)), plain()
    for i in range(40):
        texts = [" ".join(f"w{(i * j) % 97} often x{i + j}" for j in range(30)), f"a  b w{i} often", "", f"one  {i} " + "often " * 70]
        ids, length = encode.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in whole(t)] and length.tolist() == [len(whole(t)) for t in texts]
        assert len(encode.now.number) < 50 + 200


def expected(rows):
    encode, start, out = plain(), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = encode(t)
        out.append((d, start, len(ids), helpers.crc_ids(ids)))
        start += len(ids)
    return out


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    out = shared_folder(spark, "tokens")
    tokenbin.write_token_files(docs, out, FILE)
    got = tokenbin.read_token_files(spark, out, with_ids=True).orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert [tuple(r)[:4] for r in got] == expected(rows)
    encode, texts = plain(), dict(rows)
    assert all(r.ids == encode(texts[r.doc_id]) for r in got)


def test_file_layout(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    out = shared_folder(spark, "tokens")
    tokenbin.write_token_files(docs.repartition(7), out, FILE)
    store, folder = tokenbin.filesystem(out)
    manifest = json.loads(store.open_input_file(f"{folder}/manifest.json").read())
    last, base = -1, 0
    for f in manifest["files"]:
        ids = np.memmap(f"{folder}/{f['name']}.ids", "<u2", "r")
        off = np.memmap(f"{folder}/{f['name']}.off", "<u8", "r")
        keys = np.memmap(f"{folder}/{f['name']}.key", "<i8", "r")
        assert f["base"] == base and len(ids) == off[-1] == f["ids"] and len(keys) == f["docs"] == len(off) - 1
        assert keys[0] > last and (np.diff(keys) > 0).all() and all(ids[e - 1] == 0 for e in off[1:].tolist())
        last, base = keys[-1], base + len(ids)
    assert base == manifest["ids"]


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("start")
    out = shared_folder(spark, "tokens")
    tokenbin.write_token_files(docs, out, FILE)
    got = [tuple(r) for r in tokenbin.read_token_files(spark, out).collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    encode = plain()
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((d is not None, d or 0, len(encode(t)), helpers.crc_ids(encode(t))) for d, t in rows)
    # keys ascend along the files and starts are the prefix sums
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert [(r[0] is not None, r[0] or 0) for r in got] == sorted((r[0] is not None, r[0] or 0) for r in got)

    out = shared_folder(spark, "tokens")
    assert tokenbin.write_token_files(docs.filter(F.lit(False)), out, FILE) == []
    assert tokenbin.read_token_files(spark, out).count() == 0
