"""Branch purities of the url tree against a direct Python restatement, and what the tree decides."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from wayfare.llm import queries
from wayfare.llm import urlfilter as U


def brute(counts):
    """{(host, template): (purity, rejected)} of (host, template, n, labelled, bad) rows."""
    nodes, cells = defaultdict(lambda: [0, 0, 0]), defaultdict(int)
    for host, template, n, lab, bad in counts:
        parts = template[1:].split("/")
        for k in range(1, len(parts) + 1):
            parent = "/" + "/".join(parts[:k - 1]) if k > 1 else ""
            key = (host, parent, "/" + "/".join(parts[:k]))
            for i, x in enumerate((n, lab, bad)):
                nodes[key][i] += x
            cells[key + (parts[k] if k < len(parts) else "/",)] += n
    families = defaultdict(list)
    for key in nodes:
        lead = max((o, c[3]) for c, o in cells.items() if c[:3] == key)[1]
        families[key[:2] + (lead,)].append(key)
    branch = {}
    for family in families.values():
        pool = defaultdict(int)
        for key, o in cells.items():
            if key[:3] in family:
                pool[key[3]] += o
        total, free = sum(pool.values()), len(pool) - 1
        fl, fb = sum(nodes[k][1] for k in family), sum(nodes[k][2] for k in family)
        merged = []
        for key in family:
            n, lab, bad = nodes[key]
            chi = sum((cells.get((*key, s), 0) - n * pool[s] / total) ** 2 / (n * pool[s] / total) for s in pool)
            alike = chi <= free + U.Z * math.sqrt(2 * free) + 1e-6
            if lab >= U.MIN_LABELS:
                p = fb / fl
                alike &= lab * (bad / lab - p) ** 2 <= p * (1 - p) * (1 + U.Z * math.sqrt(2)) + 1e-9
            if alike:
                merged.append(key)
            branch[key[0], key[2]] = (lab, bad)
        for key in merged:
            branch[key[0], key[2]] = tuple(sum(nodes[k][i] for k in merged) for i in (1, 2))
    every = (sum(c[4] for c in counts) + 1) / (sum(c[3] for c in counts) + 2)
    out = {}
    for host, template, *_ in counts:
        own = [c for c in counts if c[0] == host]
        purity = (sum(c[4] for c in own) + U.SMOOTHING * every) / (sum(c[3] for c in own) + U.SMOOTHING)
        most, parts = 0, template[1:].split("/")
        for k in range(1, len(parts) + 1):
            node = "/" + "/".join(parts[:k])
            lab, bad = branch[host, node]
            smooth, most = (bad + U.SMOOTHING * purity) / (lab + U.SMOOTHING), max(most, lab)
            own = nodes[host, "/" + "/".join(parts[:k - 1]) if k > 1 else "", node][1]
            purity = smooth if own >= U.MIN_LABELS else min(smooth, purity)
        out[host, template] = (purity, most >= U.MIN_LABELS and purity >= U.PURITY)
    return out


def counted(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))
    _, said = U.rule_of(F.col("host"), F.col("path"), queries.URL_RULES)
    placed = U.templates(pages.withColumn("_label", (said == "block").cast("int")))
    return placed.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"),
                                                  F.coalesce(F.sum("_label"), F.lit(0)).alias("bad"))


def check(counts):
    want = brute([tuple(r) for r in counts.select("host", "template", "n", "labelled", "bad").collect()])
    got = {(r["host"], r["template"]): (r["purity"], r["rejected"]) for r in U.branch_verdicts(counts).collect()}
    assert got.keys() == want.keys()
    for k, (purity, rejected) in want.items():
        assert abs(got[k][0] - purity) < 1e-9 and got[k][1] == rejected, k
    return got


def test_given_pages_match_brute_force_and_the_tree_decides(spark):
    got = check(counted(spark, "/root/testdata/sf0.01"))
    assert {rejected for _, rejected in got.values()} == {True, False}
    out = queries.QUERIES["op9_url_filter"](spark, "/root/testdata/sf0.1").where("rule is null")
    by = {r["verdict"]: r["count"] for r in out.groupBy("verdict").count().collect()}
    assert by["block"] > 0 and by["allow"] > 0


def test_odd_trees_match_brute_force(spark):
    rows = [("h", "/", 3, 0, 0), ("h", "/a/x", 40, 40, 40), ("h", "/b/x", 30, 0, 0), ("h", "/c/y/z", 30, 0, 0),
            ("h", "/d", 9, 9, 0), ("h", "/a/x/<num>", 5, 0, 0), ("g", "/a", 7, 0, 0), ("g", "/*", 100, 3, 3),
            ("", "/", 12, 0, 0), ("k", "/" + "/".join("abcdefgh"), 6, 6, 6)]
    check(spark.createDataFrame(rows, "host string, template string, n long, labelled long, bad long"))


def test_unlabelled_siblings_follow_alike_ones_only(spark):
    rows = [(f"http://s.org/{lang}/{i}", True if lang == "de" else None) for lang in ("de", "en") for i in range(30)]
    rows += [(f"http://s.org/about/{w}/team/{i}", None) for w in ("us", "them") for i in range(15)]
    rows += [(f"http://t.org/{i}", None) for i in range(30)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {}
    for r in U.judge_urls(df, "url", [], bad="bad").collect():
        got.setdefault("/".join(r["url"].split("/")[2:4]) if "s.org" in r["url"] else "t.org", set()).add(r["verdict"])
    assert got == {"s.org/de": {"block"}, "s.org/en": {"block"}, "s.org/about": {"allow"}, "t.org": {"allow"}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "host string, template string, n long, labelled long, bad long")
    assert U.branch_verdicts(empty).collect() == []
