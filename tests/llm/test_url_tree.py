"""The url tree keeps labelled sections of any share and depth."""

from pyspark.sql import functions as F

from wayfare.llm import urlfilter as U


def test_small_bad_sections_and_deep_paths(spark):
    deep = "/".join("abcdefghij")
    rows = [(f"http://big.org/sec{chr(97 + i // 26)}{chr(97 + i % 26)}/{j}", i == 7) for i in range(60) for j in range(12)]
    rows += [(f"http://big.org/{deep}/{'spam' if j % 2 else 'news'}/{j}", j % 2 == 1) for j in range(80)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    out = U.judge_urls(df, "url", [], bad="bad").select("bad", "verdict", "template").collect()
    assert {r["verdict"] for r in out if r["bad"]} == {"block"}
    assert {r["verdict"] for r in out if not r["bad"]} == {"allow"}
    assert f"/{deep}/spam/<num>" in {r["template"] for r in out}


def test_unlabelled_rare_children_are_wildcards(spark):
    rows = [(i, f"http://x.org/u/name{'abcdefghij'[i % 10]}{'x' * (i // 10)}y/post") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = U.judge_urls(df, "url", [])
    assert [r["template"] for r in out.select("template").distinct().collect()] == ["/u/*/post"]
    assert out.where(F.col("verdict") == "block").count() == 0
