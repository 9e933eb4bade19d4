"""The registered queries of the training-data operators: thin bindings of
the operators to the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (audit, decontam, htmltext, jaccard, linededup, mixing, periodic, pieces, pii, quality, sharding,
               substring, urlfilter)

WORDS = r"[^\x20\x09-\x0D]+"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Number of words of a text column (NULL: 0), without Python."""
    # one blank per run of non-words; a text's words are its blanks + 1 after trimming
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "w")
    return F.length(F.regexp_replace(flat, r"[\x20\x09-\x0D]++", "")).cast("long")


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the sources' target weights 1, 2, 3, ... (cube method)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs, "source", "size")
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"),
                        "target", (F.col("times") * F.col("size")).alias("taken"))


@query
def op5_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by a Feistel permutation of global row numbers; law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = sharding.shard_rows(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


SQL["op6_quality_rules"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, t, w, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(string_split(t, chr(10))) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\\x{80}-\\x{10FFFF}]'))) AS n_letter
  FROM d
), l AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1
), p AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p), (SELECT unnest([0, 1, 2]) AS j)
  WHERE c > 1 GROUP BY 1
), m AS (
  SELECT f.doc_id, n_words, word_chars, n_symbols, n_lines, n_letter,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM f LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_letter < 60 * n_words
            OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
"""


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and the verdict of the rule cascade for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.apply_rules(docs, "text", quality.rule_order(docs, "text"), measures=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", *quality.BASE, failed.alias("base_failed"),
                      (~failed & F.col("kept")).alias("kept"))


SQL["op7_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), m AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win USING (k, g)
), hit AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1
), it AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in every document (Wu-Manber)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark")
    out = decontam.find_contamination(docs, "text", bench, "item_id", "text", keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or path-template verdict for every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, "url", URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity")


SQL["op10_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN firsts USING (g) WHERE f < doc_id
), lost AS (SELECT doc_id, count(*)::BIGINT AS n_removed, list(j) AS js FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(js, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents covered by 13-word windows that an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, "doc_id", "text")


SQL["op3_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                    FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(s, t) AS (
  SELECT a, b FROM links UNION SELECT s, b FROM reach JOIN links ON t = a
), least AS (SELECT s, min(t) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON s = d.doc_id
"""


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard 0.85 of 4-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs, "doc_id", "text")


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without the low-importance branches of its site's style tree."""
    pages = table(spark, sf_dir, "pages")
    out = htmltext.extract_text(pages, "url", "html", keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base kinds and identifiers found by bootstrapped contexts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_pii(docs, "doc_id", "text")
    base = F.filter("spans", lambda s: s["kind_no"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])],
                      F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat a line (fuzzily) seen earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.duplicate_lines(docs, "doc_id", "text")
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                      F.array_join("removed", ",").alias("removed_lines"))


AUDITED = {
    "A": lambda t: F.size(audit.words_of(t)) < 200,
    "B": lambda t: 100 * F.size(F.array_distinct(audit.words_of(t))) < 50 * F.size(audit.words_of(t)),
    "C": lambda t: 100 * F.length(F.regexp_replace(t, "[^A-Z]++", "")) > 3 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
}

SQL["op11_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN labels USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f GROUP BY 1, 2
), i AS (SELECT unnest(range(5)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, step, o[step] AS f,
         coalesce(list_sum(list_transform(o[1:step - 1], lambda x: (2 ** x)::INT)), 0)::INT AS before
  FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, f, sum(n * ((fails & (before | (1 << f))) = 0)::INT)::BIGINT AS kept,
         sum(n * ((fails & before) = 0 AND (fails >> f) & 1 = 1)::INT)::BIGINT AS removed,
         sum(n * ((fails & before) <> 0 AND (fails >> f) & 1 = 1)::INT)::BIGINT AS redundant,
         sum(n * (fails = (1 << f))::INT)::BIGINT AS unique_fails,
         sum(good * ((fails & before) = 0 AND (fails >> f) & 1 = 1)::INT)::BIGINT AS good_lost,
         sum(toxic * ((fails & before) = 0 AND (fails >> f) & 1 = 1)::INT)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors, removals, redundancies and label losses of five filters in all orders, per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents, failing = audit.failing_ids(docs, "doc_id", "text", "lang", AUDITED, copy="E")
    return audit.audit(documents, failing, table(spark, sf_dir, "labels"))


def with_periods(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``docs`` with the contract's periodic tails: h is the CRC of the id; where
    10 divides it, the words from a on repeat the p words from a."""
    words = audit.words_of(F.col(text))
    h = F.crc32(F.col(ident).cast("string").cast("binary"))
    rows = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_w").cast("long"), F.expr("_h div 10")
    rows = rows.withColumn("_a", F.when(n > 0, F.pmod(g, n)))
    rows = rows.withColumn("_p", F.when(n > 0, 1 + F.expr("(size(_w) - _a) div (3 + _h div 10 % 8)")))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("_a") - 1),
                       lambda i: F.element_at("_w", (F.col("_a") + i % F.col("_p") + 1).cast("int")))
    told = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return rows.withColumn(text, F.when(F.col("_a").isNotNull(), told).otherwise(F.col(text))).drop("_h", "_w", "_a", "_p")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, of which every tenth is given a periodic tail."""
    docs = with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    out = periodic.find_runs(docs, "text", keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.when(F.size("runs") > 0, best)
    out = out.withColumn("_best", best)
    start, length, period = (F.col(f"_best.{c}") for c in ("start", "length", "period"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
                      period.alias("period"), F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document and the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_pieces(docs, "text", piece_model(), decoded="decoded", keep=["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
