"""Decontamination in pieces and several passes gives what one pass gives."""

import random

import pytest

from wayfare.llm import decontam as D


def brute(texts, bench, width=10):
    words = lambda t: "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " "
                              for c in (t or "").translate({i: i + 32 for i in range(65, 91)})).split(" ")
    tok = lambda t: [w for w in words(t) if w]
    out = []
    for t in texts:
        w, hit, items = tok(t), set(), set()
        for ident, b in bench:
            b = tok(b)
            k = min(width, len(b))
            wins = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i:i + k]) in wins:
                    hit.update(range(i, i + k))
                    if ident is not None:
                        items.add(ident)
        out.append((len(w), len(hit), sorted(items)))
    return out


def case():
    rnd = random.Random(11)
    some = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice("abC\u00e9") for _ in range(n))
    bench = [(f"i{j}", some(rnd.choice([0, 1, 4, 9, 10, 11, 30, 200]))) for j in range(25)]
    bench += [bench[6], (None, some(40)), ("n", None), ("", some(12)), ("i3", some(15))]
    # a window that a third of the items and documents share
    hot = "one two three four five six seven eight nine ten eleven"
    bench += [(f"h{j}", hot) for j in range(15)]
    texts = [some(rnd.randrange(400)) for _ in range(40)] + [hot + " " + some(20) for _ in range(20)] + [None, "", "!!"]
    texts += [f"{some(7)} {b}" for _, b in bench if b]
    return texts, bench


@pytest.mark.parametrize("size, piece", [(8 << 20, 10_000), (8 << 20, 7), (900, 20)])
def test_shards_and_pieces_match_brute_force(spark, monkeypatch, size, piece):
    monkeypatch.setattr(D, "SHARD_BYTES", size)
    monkeypatch.setattr(D, "PIECE", piece)
    texts, bench = case()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, items string, rid int")
    items = spark.createDataFrame(bench, "item_id string, text string")
    got = D.find_contamination(df, "text", items, "item_id", "text")
    assert got.columns == ["doc_id", "text", "items", "rid", "n_words", "n_hit", "_items"]
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["_items"]) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts, bench)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r)[2:] for r in D.find_contamination(docs, "text", none, "item_id", "text").collect()] == [(2, 0, [])]
    assert D.find_contamination(docs.limit(0), "text", none, "item_id", "text").count() == 0
