"""Periodic runs against a brute force over all periods, and the query's digests."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from wayfare.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            primitive = not any(all(words[x] == words[x + d] for x in range(i, i + size - d)) for d in range(1, q))
            if size >= max(least, 2 * q) and primitive:
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def random_texts(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 8))]
            words += unit * rng.randint(1, 5) + unit[:rng.randint(0, len(unit))]
        yield rng.choice([" ", "\n", "  \t"]).join(words)


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(1500):
        words = [rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))]
        for least in (2, 5, 12):
            assert periodic.runs_of(words, least) == brute(words, least), words


def test_long_run():
    unit = [str(i) for i in range(700)]
    words = ["start", *unit * 40, "end"]
    assert periodic.runs_of(words) == [(1, 28000, 700)]
    assert periodic.runs_of(["w"] * 50000) == [(0, 50000, 1)]
    assert periodic.runs_of([str(i) for i in range(20000)]) == []


def check(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    out = periodic.find_runs(df, "text")
    new = out.columns[-3:]
    rows = out.collect()
    assert out.columns[:-3] == df.columns and len(rows) == len(texts)
    for r in rows:
        words = split(texts[r["i"]])
        want = brute(words) if len(words) < 2000 else periodic.runs_of(words)
        assert r["text"] == texts[r["i"]]
        assert r[new[0]] == len(words)
        assert [tuple(x) for x in r[new[1]]] == want
        assert r[new[2]] == collapsed(words, want)
    return new


def test_operator_against_brute_force(spark):
    texts = [None, "", "   \n", "one", *random_texts(150, 3), "a b c " * 3000, "é ü " * 10, "é ü " * 10]
    assert check(spark, texts) == ["n_words", "runs", "collapsed"]


def test_clashing_names_and_empty_table(spark):
    assert check(spark, ["a " * 20, None], runs=1, N_WORDS=None) == ["_n_words", "_runs", "collapsed"]
    assert check(spark, []) == ["n_words", "runs", "collapsed"]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_digests(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = planted(doc_id, split(text))
        runs = brute(words) if len(words) < 1500 else periodic.runs_of(words)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else None
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert r["runs_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_periods_of_odd_rows(spark):
    df = spark.createDataFrame([(i, t) for i in range(60) for t in (None, "")] + [(None, "x y")], "doc_id long, text string")
    rows = queries.with_periods(df, "doc_id", "text").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, df.collect()))
    for t in ("a", " a  b\tc\nd e f g h ", "w " * 40):
        rows = spark.createDataFrame([(i, t) for i in range(200)], "doc_id long, text string")
        for r in queries.with_periods(rows, "doc_id", "text").collect():
            assert split(r["text"]) == planted(r["doc_id"], split(t))
