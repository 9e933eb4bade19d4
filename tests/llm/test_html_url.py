"""HTML extraction and url filters on small fixtures."""

import math
import re

from pyspark.sql import functions as F

from wayfare.llm import htmltext as H
from wayfare.llm import joins, queries
from wayfare.llm import urlfilter as U


def test_page_parser():
    page = H.Page("""<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><nav><ul><li>menu</li></ul></nav><!-- x --><div class="ad box">buy</div><header>site</header>
<article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp; line<br>goes   on<p>a &lt; b &#233;&eacute;
<ul><li>one<li>two</ul><form><input>field</form><table><tr><td>x<td>y</table></article>
<div id="comments"><p>nice</p></div><footer>&copy; 2020</footer></body>""")
    assert page.text() == "Title & more\nFirst line goes on\na < b éé\none\ntwo\nx\ny"
    assert H.Page("").text() == "" and H.Page("plain  text").text() == "plain text"
    assert H.Page("<p>one<p>two<aside>no</aside> three").text() == "one\ntwo\nthree"
    assert H.Page("a < b <notatag <b>c</b> <a href='x>y'>d</a>").text().startswith("a < b")
    assert H.Page("<p>cut off &am").text() == "cut off &am"
    assert H.Page("<div>" * 3000 + "deep").text() == "deep"
    assert H.Page('<p class="' * 2000 + "x").text() is not None


def test_raw_elements_do_not_take_the_article():
    assert H.Page("<article><p>one</p><svg/><p>two</p></article>").text() == "one\ntwo"
    assert H.Page('<article><p>one</p><svg class="i" /><p>two</p></article>').text() == "one\ntwo"
    assert H.Page("<article><p>one</p><svg><text>no</text></svg><p>two</p></article>").text() == "one\ntwo"
    assert H.Page("<article><p>one</p><noscript><p>two</p></article>").text() == "one\ntwo"
    assert H.Page("<article><p>one</p><iframe src='x'><p>two</p></article>").text() == "one\ntwo"
    assert H.Page("<article><p>a <math><mi>x</mi>=1</math> b</p></article>").text() == "a x=1 b"
    assert H.Page("<article><p>one</p><script>var a = 1;").text() == "one"


def test_threshold_grows_with_the_pages(spark):
    rows = [r for n in range(3, 12) for r in pages(f"h{n}.com", n)]
    df = spark.createDataFrame([(u, h) for u, h in rows], "url string, html string")
    got = {}
    for r in H.extract_text(df, "url", "html").collect():
        got.setdefault(r["url"].split("/")[2], []).append(r["text"].startswith("subscribe now"))
    assert all(got["h3.com"]) and not any(x for n in range(4, 12) for x in got[f"h{n}.com"])


def pages(host, n, extra=""):
    return [(f"http://{host}/p{i}", f"<html><body><div class='x'><p>subscribe now</p></div>"
             f"<div class='body'><p>unique story number {i} of {host}</p><p>and its end {i}</p></div>{extra}</body></html>")
            for i in range(n)]


def test_style_tree_removes_repeated_branches(spark, monkeypatch):
    rows = pages("a.com", 20) + pages("b.com", 3) + [(None, None), ("no scheme", "<p>x</p>"), ("http://a.com/e", "")]
    df = spark.createDataFrame([(i, u, h, "t") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")
    out = H.extract_text(df, "url", "html")
    got = {r["page_id"]: r["_text"] for r in out.collect()}
    for i in range(20):
        assert got[i] == f"unique story number {i} of a.com\nand its end {i}"
    assert got[20] == "subscribe now\nunique story number 0 of b.com\nand its end 0"       # too few pages to tell
    assert (got[23], got[24], got[25]) == ("", "x", "")
    tree = {(r["host"], r["path"]): r for r in H.style_tree(df.select(U.host_of(F.col("url")).alias("host"), "html")).collect()}
    low, high = tree["a.com", "/html/body/div.x/p"], tree["a.com", "/html/body/div.body/p"]
    assert low["pages"] == 20 and abs(low["importance"]) < 1e-9
    assert abs(high["importance"] - (1 - H.PRESENTATION)) < 1e-9                            # content 1, presentation 0
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["_text"] for r in H.extract_text(df, "url", "html").collect()} == got


def test_importance_is_the_entropy_formula(spark):
    html = ["<body><p>same</p></body>"] * 6 + ["<body><p>own</p><ul></ul></body>"] * 2
    df = spark.createDataFrame([("h", x) for x in html], "host string, html string")
    got = {r["path"]: r["importance"] for r in H.style_tree(df).collect()}
    content = 1 - (math.log(6, 8) + math.log(2, 8)) / 2
    shape = -sum(p * math.log(p, 8) for p in (6 / 8, 2 / 8))
    assert abs(got["/body"] - (0.1 * shape + 0.9 * content)) < 1e-9
    assert abs(got["/body/p"] - 0.9 * content) < 1e-9


RULES = queries.URL_RULES


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://EXAMPLE.NET/en/x", "https://a.example.net/en/", "http://example.net/enx",
            "http://x.net", "http://x.net/", "http://notexample.com/de/1", "http://www.example.com/de/1?x=/y#z",
            "http://example.com#/de/", "https://org/fr/1", "https://a.org/fr?x", "http://É.NET/a", "ftp://u@h.org:80/fr/x://y",
            "http://net/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in U.judge_urls(df, "url", RULES).collect():
        host, path, rule = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), urls[r["page_id"]]
        assert r["verdict"] == (rule[1] if rule else "allow")


def test_template_tree_rejects_bad_branches(spark):
    rows = []
    for i in range(40):
        rows.append((f"http://shop.org/spam/{i}", True if i < 30 else None))
        rows.append((f"http://shop.org/news/{i}.html", False if i < 30 else None))
        rows.append((f"http://shop.org/pills/{i}", True if i < 8 else None))
        rows.append((f"http://shop.org/misc/{i}", None))
        rows.append((f"http://other.org/user/name{chr(97 + i % 26)}{'x' * i}/profile", None))
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {}
    for r in U.judge_urls(df, "url", [], bad="bad").collect():
        got.setdefault(r["template"], set()).add(r["verdict"])
    assert got["/spam/<num>"] == {"block"} and got["/pills/<num>"] == {"block"}
    assert got["/news/<num>.html"] == {"allow"} and got["/misc/<num>"] == {"allow"}
    assert got["/user/*/profile"] == {"allow"}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_text(df, "url", "html").count() == 0
    assert U.judge_urls(df, "url", RULES).count() == 0
