"""Quality cascade and Wu-Manber decontamination against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.llm import decontam as D
from wayfare.llm import quality as Q
from wayfare.llm.textops import chunks


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": dup, "n_repeat_words": len(hit), "n_lines": len(lines),
            "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w)}


def texts(n=120, seed=2):
    rnd = random.Random(seed)
    vocab = ["a", "é%", "b|", "\U0001F600", "42", "word", "##", "x"]
    out = [None, "", " ", "\n", "\n\n", "a\n", "\na\na", "a b c a b c", "one\r\none\r\none"]
    for _ in range(n):
        out.append("".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.randrange(90))))
    return out


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_measures(limit):
    rows = texts()
    at = 0
    for c in chunks(pa.array(rows, pa.string()), limit=limit):
        m = Q.Measures(c)
        for k in brute(""):
            assert m.get(k).tolist() == [brute(t)[k] for t in rows[at:at + c.n]], k
        at += c.n


def test_cascade_verdict_does_not_depend_on_order():
    c = next(iter(chunks(pa.array(texts(), pa.string()))))
    names, rnd = list(Q.RULES), random.Random(1)
    want = ~np.any([Q.rule(k).rejects(Q.Measures(c)) for k in names], axis=0)
    for _ in range(6):
        rnd.shuffle(names)
        kept, by = Q.cascade(Q.Measures(c), names)
        assert kept.tolist() == want.tolist() and ((by < 0) == kept).all()


def test_rules_and_filter_keep_rows(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts() + [" ".join(f"plain{i}" for i in range(80))] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    order = Q.rule_order(df, "text")
    assert sorted(order) == sorted(Q.RULES)
    out = Q.apply_rules(df, "text", order, measures=True)
    assert out.columns[:3] == df.columns and "_kept" in out.columns
    for r in out.collect():
        b = brute(r["text"])
        assert [r[k] for k in ("n_words", *Q.BASE)] == [b[k] for k in ("n_words", *Q.BASE)]
        assert r["_kept"] == (r["rejected_by"] is None)
    kept = Q.quality_filter(df, "text")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {len(rows) - 1, len(rows) - 2}
    assert Q.quality_filter(df.limit(0), "text").count() == 0
    assert Q.rule_order(df.limit(0), "text") == list(Q.RULES)


def words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[a:a + k]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(g) for g in wins}:
            for a in range(len(w) - k + 1):
                own = wins.get(tuple(w[a:a + k]))
                if own is not None:
                    hit |= set(range(a, a + k))
                    ids |= own
        out[d] = (len(w), len(hit), sorted(str(i) for i in ids if i is not None))
    return out


@pytest.mark.parametrize("shard_bytes", [16 << 20, 64])
def test_decontamination(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(D, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(D, "SEGMENT", 7)
    rnd = random.Random(4)
    vocab = ["aa", "B1", "cé", "d", "É"]
    text = lambda n: rnd.choice([" ", "--", "_ ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(10, 22)]
    items += [(3, None), (None, "unlisted words here"), (10, items[0][1]), (77, "zz yy"), (78, "ZZ, yy"), (5, text(30))]
    docs = [(i, text(rnd.randrange(40))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "say Unlisted words HERE."), (103, "zz-yy zz yy"), (104, "x" + items[-1][1]), (105, "pre " + items[-1][1].upper().replace("É", "É"))]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.find_contamination(df, "text", bench, "item_id", "text", keep=["doc_id"])
    got = {r["doc_id"]: (r["n_words"], r["_n_hit"], r["items"]) for r in out.collect()}
    assert got == brute_hits(docs, items)
    clean = D.drop_contaminated(df, "text", bench, "item_id", "text")
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, v in got.items() if v[1] == 0}
    assert D.find_contamination(df, "text", bench.limit(0), "item_id", "text").agg(F.sum("_n_hit")).first()[0] == 0
    assert D.find_contamination(df.limit(0), "text", bench, "item_id", "text").count() == 0


def test_shift_table_skips():
    m = D.build([("1", "a b c d e f g h i j")])[0]
    c = next(iter(chunks(pa.array(["x " * 500 + "a b c d e f g h i j"]), D.NON_ALNUM, lower=True)))
    assert m.shift.max() == 9 and (m.shift < 9).sum() == 9
    assert m.candidates(c.word_hash(), c.first).tolist() == [509]


def test_benchmark_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_BYTES", 3)
    bench = spark.createDataFrame([(1, "long text")], "item_id long, text string")
    with pytest.raises(ValueError):
        D.benchmark_shards(bench, "item_id", "text")
