"""Vectorised SentencePiece merges against the library itself."""

import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from pyspark.sql import functions as F  # noqa: E402

from wayfare.llm import pieces, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", "hello world", " \n\t", "▁x ▁▁ y", "x▁ y", "é", "é", "�\x00ab", "日本語テキスト",
       "<s> </s> <0x41>", "a" * 1000, " " * 333 + "x" + " " * 50, "0123456789" * 20, "👍🏽 ok", "a\r\nb", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def check(spark, library, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    out = pieces.encode_pieces(df, "text", queries.piece_model(), decoded="decoded")
    ids, decoded = out.columns[-2:]
    assert out.columns[:-2] == df.columns
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["i"]] or "")
        assert r["text"] == texts[r["i"]]
        assert list(r[ids]) == want, texts[r["i"]]
        assert r[decoded] == library.decode(want)
    return ids, decoded


def test_odd_texts(spark, library):
    assert check(spark, library, ODD) == ("ids", "decoded")


def test_random_texts(spark, library):
    rng = random.Random(7)
    pool = ["the", "in", " ", "  ", "▁", "\n", "é", "ß", "ing", "tion", "日", "本", "А", "б", "1", "9", *"abcerstn", "th", ".", "👍"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(32, 126), rng.randint(0xE000, 0x10FFFF)]))
                      for _ in range(100)) for _ in range(200)]
    check(spark, library, texts)


def test_very_long_words(spark, library):
    rng = random.Random(8)
    check(spark, library, ["".join(rng.choice("abcdefghij") for _ in range(60000)), " " * 20000 + "x" * 20000, "ab" * 40000])


def test_clashing_names_and_empty_table(spark, library):
    assert check(spark, library, ["a b", None], IDS=None, decoded=2) == ("_ids", "_decoded")
    check(spark, library, [])


def test_merges_one_by_one_equal_rounds():
    with open(queries.piece_model(), "rb") as f:
        v = pieces.vocabulary(f.read())
    import numpy as np

    rng = random.Random(9)
    for _ in range(200):
        word = v.symbol[[ord(c) for c in "".join(rng.choice("ther in") for _ in range(rng.randint(1, 30)))]]
        flat, first = pieces.merge_words(v, word, np.array([0, len(word)]))
        assert flat.tolist() == pieces._one_by_one(v, word.tolist())


def test_decoding_any_ids(spark, library):
    rng = random.Random(10)
    rows = [[rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999)])
             for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*rows, None])], "text long, ids array<int>")
    out = pieces.decode_pieces(df, "ids", queries.piece_model())
    assert out.columns == ["text", "ids", "_text"]
    for r in out.collect():
        assert r["_text"] == library.decode(rows[r["text"]] if r["ids"] is not None else [])
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode_pieces(spark.createDataFrame([([40000],)], "ids array<int>"), "ids", queries.piece_model()).collect()


def test_unfit_model(spark, tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        pieces.encode_pieces(spark.range(1).select(F.lit("a").alias("t")), "t", str(path))


def test_query_digests(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_piece_ids"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
