"""Filter interaction audit: what each of several filters removes in every order.

A filter is a condition under which a document fails.  For each, the ids of the
failing documents are stored as a table of their own (a *failing-id relation*);
everything else is joins of these relations:

* documents that fail no filter leave by a left-semi join with the union of the
  relations (they survive every prefix) and are only counted;
* the others are paired with prefixes (sets of filters, as bit masks), one filter
  after the other: a document's prefix is continued with the filter, and a
  left-anti join with the filter's relation leaves the survivors of the
  continued prefix.  No order need be run: documents that survive a prefix are
  the same in whatever order its filters stand;
* left-semi joins with each relation give what a filter would remove alone.

What survives a prefix, with its labels, is counted by part.  Removals of filter
f after prefix S are the survivors of S less those of S with f; its redundant
failures are those that it would remove alone less its removals; its unique
failures are the removals after all others.  The last step, from at most 2^k
prefixes a part to k! orders, is arithmetic on one row a part.

All joins are on the document key, so each relation is shuffled once; the keys
of a very large table are two hashes, 16 bytes a document, whatever the texts'
length.  Equal rows are one key with a count.  Equal texts meet by digest with
partial aggregation, and the members of a large group are dealt over
``joins.SALTS`` tasks.

NULL texts count as empty, NULL parts as the empty string; a NULL id is greater
than all others (so a copy with a NULL id fails as a copy, and none fails because
of it) and has no labels; a label row with NULL id or NULL labels adds nothing;
several label rows of one id count if any of them is set; an empty table gives
no rows.  The input's other columns and their names do not matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import salted_join
from .names import col
from .store import written

MAX_FILTERS = 7
COUNTS = ("n", "good", "toxic")


def words_of(text: Column) -> Column:
    """The words of a text column (maximal runs without blanks), NULL as none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def describe(docs: DataFrame, ident: str, text: str, part: str, conditions: dict) -> DataFrame:
    """One written row per distinct (id, part, text): key ``k1``, ``k2``, ``id``,
    ``part``, ``digest`` of the text, ``n`` equal rows and a flag per condition
    (a function of the text column)."""
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(ident).alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(t, 256)).alias("digest"),
                       *[F.coalesce(c(t), F.lit(False)).alias(f"fails_{f}") for f, c in conditions.items()])
    flags = [f"fails_{f}" for f in conditions]
    rows = rows.groupBy("id", "part", "digest", *flags).agg(F.count(F.lit(1)).alias("n"))
    return written(rows.select(F.xxhash64("id", "part", "digest").alias("k1"), F.xxhash64("digest", "part", "id").alias("k2"),
                               "*"), "described")


def copies(described: DataFrame) -> DataFrame:
    """Keys of the documents whose text a smaller id has."""
    ids = described.select("k1", "k2", "id", "digest", "n")
    first = (ids.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
             .where(F.col("c") > 1).drop("c"))
    many = salted_join(ids, first, ["digest"], "k1").where(F.col("first").isNotNull())
    return many.where(F.col("id").isNull() | (F.col("id") > F.col("first"))).select("k1", "k2")


def failing_ids(docs: DataFrame, ident: str, text: str, part: str, conditions: dict,
                copy: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The documents (see ``describe``) and one written table of failing keys per
    filter, in the order of ``conditions``, then ``copy``: the name of the filter
    that documents fail whose text a smaller id has."""
    described = describe(docs, ident, text, part, conditions)
    tables = {f: written(described.where(f"fails_{f}").select("k1", "k2"), f"failing-{i}")
              for i, f in enumerate(conditions)}
    if copy is not None:
        tables[copy] = written(copies(described), f"failing-{len(tables)}")
    return described.select("k1", "k2", "id", "part", "n"), tables


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    labelled = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in COUNTS[1:]]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *labelled)


def prefix_survivors(documents: DataFrame, failing: list[DataFrame]) -> DataFrame:
    """Per part and prefix (bit mask of filters): ``n``, ``good`` and ``toxic``
    of the documents that fail some filter, but none of the prefix."""
    dirty = failing[0]
    for f in failing[1:]:
        dirty = dirty.unionByName(f)
    rows = documents.join(dirty.distinct(), ["k1", "k2"], "left_semi").withColumn("prefix", F.lit(0))
    for i, f in enumerate(failing):
        rows = rows.withColumn("prefix", F.explode(F.array(F.col("prefix"), F.col("prefix") + (1 << i))))
        gone = f.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"))
        # only the continued prefixes meet the filter
        rows = rows.join(gone, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))
                         & (F.col("prefix").bitwiseAND(1 << i) != 0), "left_anti")
    return _sums(rows, "part", "prefix")


def audit(documents: DataFrame, failing: dict[str, DataFrame], labels: DataFrame, label_id: str = "doc_id",
          good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step (see the module):
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``; ``filter_order`` is the filters' names in turn, and
    ``shapley`` the step's filter's removals summed over all orders."""
    names = list(failing)
    k = len(names)
    if not 1 <= k <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters: all their orders are listed")
    known = (labels.where(col(label_id).isNotNull())
             .groupBy(col(label_id).alias("id"))
             .agg(F.max(F.coalesce(col(good) == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(col(toxic) == 1, F.lit(False))).alias("toxic")))
    rows = documents.join(known, "id", "left").select(
        "k1", "k2", "part", "n", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in COUNTS[1:]])
    rows = written(rows, "audited")
    tables = list(failing.values())
    alone = [_sums(rows.join(f, ["k1", "k2"], "left_semi"), "part").withColumn("prefix", F.lit(-1 - i))
             for i, f in enumerate(tables)]
    counted = prefix_survivors(rows, tables).unionByName(_sums(rows, "part").withColumn("prefix", F.lit(-1 - k)))
    for a in alone:
        counted = counted.unionByName(a)
    # one row a part; at most 2^k + k + 1 entries
    figures = F.map_from_entries(F.collect_list(F.struct("prefix", F.struct(*COUNTS))))
    parts = counted.groupBy("part").agg(figures.alias("figures"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    at = lambda key: F.coalesce(F.try_element_at("figures", key), zero)
    # survivors less those that fail nothing, and the dirty documents that a prefix has removed
    parts = parts.withColumn("left", F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), at))
    parts = parts.withColumn("alone", F.array(*[at(F.lit(-1 - i)) for i in range(k)])).withColumn("all", at(F.lit(-1 - k)))
    steps, full = [], (1 << k) - 1
    times: dict[tuple[int, int], int] = {}     # orders in which a filter follows a prefix
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order):
            steps.append((before, i, step + 1, "".join(names[j] for j in order)))
            times[before, i] = times.get((before, i), 0) + 1
            before |= 1 << i
    # the plan as one literal: an array of k! k structs is slow to build and compile
    plan = F.split(F.lit(";".join(f"{b},{i},{s},{o}" for b, i, s, o in steps)), ";")
    left = lambda mask, c: F.element_at("left", mask + 1).getField(c)
    removed = lambda before, i, c: left(F.lit(before), c) - left(F.lit(before | 1 << i), c)
    shapley = F.array(*[sum((removed(b, j, "n") * c for (b, j), c in times.items() if j == i), F.lit(0)) for i in range(k)])
    unique = F.array(*[removed(full & ~(1 << i), i, "n") for i in range(k)])
    parts = written(parts.select("part", "left", "alone", "all", shapley.alias("shapley"), unique.alias("unique")), "parts")
    fields = F.split("s", ",", 4)
    out = parts.select("*", F.explode(plan).alias("s")).select(
        "*", *[fields[j].cast("int").alias(c) for j, c in enumerate(("before", "filter", "step"))],
        fields[3].alias("filter_order"))
    after = F.col("before").bitwiseOR(F.expr("shiftleft(1, filter)"))
    own = lambda array: F.element_at(array, F.col("filter") + 1)
    lost = {c: left(F.col("before"), c) - left(after, c) for c in COUNTS}
    return out.select(
        "part", "filter_order", "step",
        (F.col("all").getField("n") - left(F.lit(0), "n") + left(after, "n")).alias("kept"), lost["n"].alias("removed"),
        (own("alone").getField("n") - lost["n"]).alias("redundant"), own("unique").alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), own("shapley").alias("shapley"))
