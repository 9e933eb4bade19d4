"""Mixing and sharding: laws, targets, reruns, odd inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.llm import mixing as M
from wayfare.llm import queries
from wayfare.llm import sharding as S


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 9))
def test_permutation_is_a_bijection(n, seed):
    rows = np.arange(n)
    p = S.permute(rows, n, seed)
    assert sorted(p.tolist()) == rows.tolist()
    assert S.permute(p, n, seed, back=True).tolist() == rows.tolist()


def test_permutation_scatters_and_depends_on_seed():
    p = S.permute(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02
    assert (S.permute(np.arange(1000), 1000, 1) != S.permute(np.arange(1000), 1000, 2)).mean() > 0.9


def check_law(rows, shards, n):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_slots_and_odd_rows(spark):
    rows = [(i if i % 7 else None, "t" * (i % 3) if i % 5 else None, "x") for i in range(200)] + [(9, "same", "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = S.shard_rows(df, 6)
    assert out.columns == ["doc_id", "text", "shard", "row_number", "_shard", "slot"]
    got = out.withColumnRenamed("shard", "own").withColumnRenamed("_shard", "shard").collect()
    check_law(got, 6, 250)
    assert sorted(r["row_number"] for r in got) == list(range(250))
    again = S.shard_rows(df.repartition(7), 6).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, again), key=str) == sorted((tuple(r) for r in out.collect()), key=str)
    assert S.shard_rows(df.limit(0), 6).count() == 0
    check_law(S.shard_rows(df.select("doc_id").limit(1), 3).collect(), 3, 1)
    with pytest.raises(ValueError):
        S.shard_rows(df, 0)
    # a row's place can be computed from its number alone
    p = S.permute(np.array([r["row_number"] for r in got]), 250)
    assert [(int(x) % 6, int(x) // 6) for x in p] == [(r["shard"], r["slot"]) for r in got]


def test_shard_query_on_given_documents(spark):
    got = queries.QUERIES["op5_shard_rows"](spark, "/root/testdata/sf0.001").collect()
    check_law(got, 24, 200)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 500, "c": 20, "é": 40, "Z": 3, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {"a": 0}, {"x": 100, "y": 100, "z": 100, "zz": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "s string, n long")
    got = {r["s"]: r["target"] for r in M.source_targets(df, "s", "n").collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_flight_keeps_totals_and_leaves_two():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 400))
        pi, size = rng.random(n), rng.integers(0, 50, n).astype(float)
        out = M.flight(pi, size, rng)
        assert ((out > M.EPS) & (out < 1 - M.EPS)).sum() <= 2
        assert abs(out.sum() - pi.sum()) < 1e-5 and abs(out @ size - pi @ size) < 1e-3
        done = M.landing(out, size)
        assert set(done.tolist()) <= {0.0, 1.0}
        assert abs(done @ size - pi @ size) <= 2 * size.max() + 1e-6


def test_flight_keeps_expectations():
    pi, size = np.array([0.2, 0.7, 0.5, 0.9, 0.4]), np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    mean = np.mean([M.flight(pi, size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - pi).max() < 0.03


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "FAN_IN", 4)
    rows = [(i, f"s{i % 5}" if i % 11 else None, (i * 37) % 90) for i in range(900)] + [(5000, "s1", 33)] * 30
    df = spark.createDataFrame(rows, "doc_id long, source string, target long")
    out = M.mix_sources(df, "source", "target")
    assert out.columns == ["doc_id", "source", "target", "source_size", "_target", "times"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, taken = brute_targets(sizes), {}
    for _, s, n, total, target, times in got:
        assert total == sizes[s] and abs(target - want[s]) < 1e-6 and 0 <= times <= 3
        taken[s] = taken.get(s, 0) + n * times
    assert all(abs(taken[s] - want[s]) <= 180 for s in want)
    again = [tuple(r) for r in M.mix_sources(df.repartition(3), "source", "target").collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    mixed = M.take_mix(df, "source", "target")
    assert mixed.columns == df.columns and mixed.agg(F.sum("target")).first()[0] == sum(taken.values())
    assert M.mix_sources(df.limit(0), "source", "target").count() == 0


def test_mix_query_on_given_documents(spark):
    got = queries.QUERIES["op4_mix_sources"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in got:
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["taken"]
        t[1] = max(t[1], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(t[0] - target) <= 2 * t[1] for (_, target), t in by.items())
