"""N-gram Jaccard join against brute force; completeness of the signatures."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wayfare.llm import jaccard as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3)))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t)), None if i is None else find(i)) for i, t in rows), key=str)


def near_groups(seed, groups=14, size=9):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 12, 30, 60, 150, 400]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
    rnd.shuffle(out)
    return out


def test_components_match_brute_force(spark):
    texts = near_groups(1) + [None, "", " \n", "One two", "one  TWO", "one two three", "É a b c", "é a b c"]
    texts += [texts[0]] * 5
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in J.jaccard_components(df, "doc_id", "text").collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df, "doc_id", "text").collect() == []


def test_keep_one(spark):
    texts = near_groups(2, groups=4, size=4)
    rows = list(enumerate(texts)) + [(None, "no id")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = J.keep_one(df, "doc_id", "text")
    assert got.columns == df.columns
    want = {c for _, _, c in brute(rows)} - {None}
    assert {r["doc_id"] for r in got.collect()} == want | {None}
    assert got.count() == len(want) + 1


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_linked_sets_share_an_entry(share):
    """Pigeonhole: whatever the allocation, linked sets meet in some entry."""
    rnd = np.random.default_rng(7)
    schemes = J.Schemes([(5, 10), (300, 10)], 85)
    schemes.layout = []
    for i in range(len(schemes.borders) - 1):
        h = J.band_distance(schemes.borders, i, 85)
        x = int(share * ((h + 1) // 2))
        schemes.layout.append((x, h + 1 - 2 * x))
    for _ in range(200):
        n = int(rnd.integers(1, 280))
        a = rnd.integers(0, 2 ** 63, n).astype(np.uint64)
        most = (15 * 2 * n) // 185
        drop, add = int(rnd.integers(0, most + 1)), int(rnd.integers(0, most + 1))
        b = np.concatenate((a[min(drop, n - 1):], rnd.integers(0, 2 ** 63, add).astype(np.uint64)))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 85 * (len(a) + len(b) - inter):
            continue
        val = np.concatenate((np.sort(a), np.sort(b)))
        key, row = schemes.entries(np.array([0, len(a), len(a) + len(b)]), val)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_allocation_covers_the_distance():
    for h in range(60):
        for sets in (10, 1e4, 1e9):
            x, y = J.allocate(h, 6.2 * (h + 1), sets)
            assert 2 * x + y == h + 1 and x >= 0 and y >= 0
    assert J.allocate(20, 120, 1e9)[0] > 0          # crowded bands buy selectivity with neighbourhoods


def test_sketch_distance_never_exceeds_difference():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        a = rnd.integers(0, 2 ** 63, int(rnd.integers(1, 900))).astype(np.uint64)
        b = np.concatenate((a[int(rnd.integers(0, len(a))):], rnd.integers(0, 2 ** 63, int(rnd.integers(0, 200))).astype(np.uint64)))
        s = J.sketches(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)))
        u = np.concatenate((s & 15, s >> 4), axis=1)
        d = (u[0] - u[1]) & 15
        far = len(np.setxor1d(a, b))
        assert np.minimum(d, 16 - d).sum() <= far
        f = J.fine_sketches(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)))
        assert J.fine_distance(*f) == J.fine_distance(*f[::-1]) <= far


def test_chunks_do_not_change_sets():
    col = pa.array(near_groups(4, 3, 3), pa.string())
    whole = [(n, v.tolist()) for _, size, off, val in J.shingle_sets(col, 4) for n, v in zip(size, np.split(val, off[1:-1]))]
    assert [n for n, _ in whole] == [len(shingles(t.as_py())) for t in col]
