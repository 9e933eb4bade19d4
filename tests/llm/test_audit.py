"""Filter audit against a row-by-row brute force over all orders."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from wayfare.llm import audit

CONDITIONS = {
    "a": lambda t: F.size(audit.words_of(t)) < 3,
    "b": lambda t: t.contains("x"),
    "c": lambda t: F.length(t) > 20,
}


def fails(rows):
    """The set of failed filters of each (id, text, part)."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        f = set()
        if len([w for w in t.replace("\n", " ").split(" ") if w]) < 3:
            f.add("a")
        if "x" in t:
            f.add("b")
        if len(t) > 20:
            f.add("c")
        if any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows):
            f.add("d")
        out.append(f)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    failed, out = fails(rows), []
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        shapley, lines = Counter(), []
        for order in permutations("abcd"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(gone)
                lines.append((name, (part, "".join(order), step, len(left), len(gone),
                                     sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        out += [(*line, shapley[name]) for name, line in lines]
    return Counter(out)


def run(spark, rows, labels, extra=False):
    docs = spark.createDataFrame(rows, "id long, body string, lang string")
    if extra:                                  # names that the operator uses itself
        for c in ("n", "k1", "digest", "part", "prefix", "good", "fails_a", "first"):
            docs = docs.withColumn(c, F.lit("other"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    documents, failing = audit.failing_ids(docs, "id", "body", "lang", CONDITIONS, copy="d")
    out = audit.audit(documents, failing, known)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    return Counter(tuple(r) for r in out.collect())


ROWS = [(1, "one two three", "en"), (2, "one two three", "en"), (3, "x", "en"), (4, None, None), (5, "", "de"),
        (6, "x", None), (7, "a b c d e f g h i j k l m n x", "en"), (None, "one two three", "en"),
        (None, "only here and nowhere", "de"), (8, "word " * 5000, "de"), (9, "word " * 5000, "en"),
        (3, "x", "en"), (3, "x", "en"), (10, "fine words here", ""), (11, "a\nb\nc", "fr")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (6, 1, None), (9, None, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)]


def test_matches_brute_force(spark):
    assert run(spark, ROWS, LABELS) == brute(ROWS, LABELS)


def test_clashing_names(spark):
    assert run(spark, ROWS, LABELS, extra=True) == brute(ROWS, LABELS)


def test_hot_group_of_copies(spark):
    rows = [(i, "the same text x", "en") for i in range(600)] + [(i, f"own text {i} here", "de") for i in range(600, 900)]
    assert run(spark, rows, []) == brute(rows, [])


def test_empty_tables(spark):
    assert run(spark, [], LABELS) == Counter()
    assert run(spark, ROWS[:3], []) == brute(ROWS[:3], [])


def test_failing_relations_hold_the_ids(spark):
    docs = spark.createDataFrame(ROWS, "id long, body string, lang string")
    documents, failing = audit.failing_ids(docs, "id", "body", "lang", CONDITIONS, copy="d")
    want = fails(ROWS)
    for name, relation in failing.items():
        ids = documents.join(relation, ["k1", "k2"], "left_semi").agg(F.sum("n")).first()[0]
        assert ids == sum(name in f for f in want), name


def test_number_of_filters_is_bounded(spark):
    with pytest.raises(ValueError):
        audit.audit(None, {str(i): None for i in range(audit.MAX_FILTERS + 1)}, None)
