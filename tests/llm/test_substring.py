"""Substring dedup against brute force, and the suffix automaton itself."""

import hashlib
import random
import re

from wayfare.llm import substring as S


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - width + 1):
                g = tuple(w[k:k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k:k + width])] < i:
                    gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["é" + str(k) for k in range(6)] + list("abc")
    passages = [[rnd.choice(vocab) for _ in range(rnd.choice([12, 13, 14, 30, 60]))] for _ in range(8)]
    out = []
    for _ in range(50):
        w = []
        for _ in range(rnd.randrange(5)):
            w += [rnd.choice(vocab) for _ in range(rnd.randrange(20))]
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w += p if rnd.random() < 0.6 else p[a:]
        out.append(" \n"[rnd.randrange(2)].join(w))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(5)
    return sorted((tuple(r) for r in S.remove_repeats(df, "doc_id", "text").collect()), key=str)


def test_matches_brute_force(spark, monkeypatch):
    # many small batches, buckets and shards, so that every exchange is used
    monkeypatch.setattr(S, "BATCH_BYTES", 1500)
    monkeypatch.setattr(S, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(S, "SHARD_BYTES", 1000)
    monkeypatch.setattr(S, "BATCHES_PER_COPY", 2)
    texts = corpus(1) + [None, "", " \n", "a " * 40, "a " * 12, "a " * 13]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)] + [(None, texts[0]), (-50, texts[0]), (-50, texts[0])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 500


def test_one_batch_and_empty_table(spark):
    rows = list(enumerate(corpus(2)[:20]))
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_kept_texts(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (2, "x " + t + " y")], "id long, text string")
    got = {r["id"]: r["kept"] for r in S.remove_repeats(df, "id", "text", texts=True).collect()}
    assert got == {1: t, 2: "x y"}


def test_automaton_against_brute_force():
    rnd = random.Random(9)
    for _ in range(300):
        refs = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 25))] for _ in range(rnd.randrange(1, 5))]
        sa = S.SuffixAutomaton()
        for r in refs:
            sa.add(r)
        q = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randrange(30))]
        least = rnd.randrange(1, 6)
        grams = {tuple(r[i:i + least]) for r in refs for i in range(len(r) - least + 1)}
        want = {j for i in range(len(q) - least + 1) if tuple(q[i:i + least]) in grams for j in range(i, i + least)}
        spans = sa.spans(q, least)
        assert {j for a, b in spans for j in range(a, b)} == want
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) or all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert len(sa.next) <= 2 * sum(map(len, refs)) + 1
