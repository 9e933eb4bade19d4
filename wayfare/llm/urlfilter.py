"""URL filters: rules first, then a path-template tree per host.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end (A-Z lower-cased), its path what follows up to ``?``, ``#`` or the end; a
NULL url or one without ``://`` has both empty.

*Rules* name a host (with all subdomains) and a path prefix; the longest
fitting rule decides.

*Template tree.*  Segments that look variable (numbers, long hex strings,
dates, with or without a file ending) become typed wildcards.  Of the others,
level by level, a child of a node stays literal where it has ``MIN_LABELS``
labels or at least ``LITERAL_SHARE`` of the node's urls, else it is ``*``; paths
have any depth.  All nodes of the tree are judged, inner ones too.  A node's structure
is the distribution of its urls over the segments below it.  Siblings with the
same most frequent segment (the last one among equals) are a family.  Members, labelled
or not, whose structure fits the family's (chi-square) and whose rate of bad labels
does (those with ``MIN_LABELS`` labels) are merged into one branch, which has
the labels of all of them.  A branch's purity is its share of bad labels,
smoothed towards its parent's, and so on up to the host's and all hosts'; a
node with less than ``MIN_LABELS`` labels of its own has at most its parent's, so what is
not labelled goes only with siblings that agree as a whole.  A template is rejected if its purity
reaches ``PURITY`` and it or a branch above it, below the host itself, has
``MIN_LABELS`` labels or more.  Equal urls are judged alike, so ties need no
order; an empty table gives an empty result.

Everything is DataFrame operations on aggregates by (host, template); pages
and nodes meet their tables in salted joins, so a hot host is not one task.  A
level costs one written table; nodes of so few urls that every child has the
share are finished at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import salted_join
from .names import col, free_name
from .store import written

LITERAL_SHARE = 0.05
MIN_LABELS = 5
PURITY = 0.8
SMOOTHING = 2.0
Z = 1.96
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """Host of a url column (empty: none)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UP, _LOW), F.lit(""))


def path_of(url):
    """Path of a url column (empty: none)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str, str]]):
    """(rule, verdict) columns of the longest fitting (host, path prefix, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def typed_segment(s):
    """A segment with its variable forms replaced by typed wildcards."""
    ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    kind = (F.when(stem.rlike(r"^[0-9]+$"), "<num>")
            .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
            .when(stem.rlike(r"^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]"), "<hex>")
            .when(stem.rlike(r"[0-9]{3,}$"), "<id>"))
    return F.coalesce(F.concat(kind, ending), s)


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, _label, ...) plus ``template``: the path's node in
    its host's tree."""
    segs = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), typed_segment)
    typed = urls.withColumn("_segs", segs)
    level = typed.groupBy("host", "_segs").agg(F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"))
    level = written(level.withColumn("node", F.lit("")).withColumn("open", F.size("_segs") > 0), "level")
    done, depth = [], 0
    while True:
        done.append(level.where(~F.col("open")).select("host", "_segs", "node"))
        rows = level.where("open").withColumn("seg", F.col("_segs")[depth])
        if rows.isEmpty():
            break
        children = rows.groupBy("host", "node", "seg").agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"))
        total = children.groupBy("host", "node").agg(F.sum("_n").alias("_total")).where(F.col("_total") * LITERAL_SHARE > 1)
        children = salted_join(children, total, ["host", "node"], "seg")
        literal = (F.col("seg").startswith("<") | (F.col("_l") >= MIN_LABELS)
                   | (F.col("_n") >= F.col("_total") * LITERAL_SHARE))
        children = children.select("host", "node", "seg", F.col("_total").isNull().alias("_few"), literal.alias("_literal"))
        rest = F.array_join(F.slice("_segs", depth + 1, F.size("_segs")), "/")
        step = F.when(F.col("_few"), rest).when(F.col("_literal"), F.col("seg")).otherwise("*")
        level = written(salted_join(rows, children, ["host", "node", "seg"], "_segs").select(
            "host", "_segs", "n", "labelled", F.concat("node", F.lit("/"), step).alias("node"),
            (~F.col("_few") & (F.size("_segs") > depth + 1)).alias("open")), "level")
        depth += 1
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    template = F.when(F.col("node") == "", "/").otherwise(F.col("node"))
    nodes = nodes.select("host", "_segs", template.alias("template"))
    return salted_join(typed, nodes, ["host", "_segs"], "path").drop("_segs")


def _steps(template):
    """Nodes from the host's child to the template: (depth, parent, node, next),
    next the segment below (``/``: none)."""
    parts = F.split(F.expr("substring(template, 2)"), "/")
    upto = lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(
        k.alias("depth"), F.when(k > 1, upto(k - 1)).otherwise("").alias("parent"), upto(k).alias("node"),
        F.coalesce(F.get(parts, k), F.lit("/")).alias("next")))


def branches(counts: DataFrame) -> DataFrame:
    """``counts`` (host, template, n, labelled, bad) -> (host, parent, node, merged,
    own, labelled, bad): every node, with its own labels' number and its branch's."""
    cells = (counts.select("*", F.explode(_steps(F.col("template"))).alias("s"))
             .groupBy("host", "s.parent", "s.node", "s.next")
             .agg(F.sum("n").alias("_o"), F.sum("labelled").alias("_l"), F.sum("bad").alias("_b")))
    lead = cells.groupBy("host", "parent", "node").agg(F.max(F.struct("_o", "next"))["next"].alias("lead"))
    cells = salted_join(cells, lead, ["host", "parent", "node"], "next")
    pool = cells.groupBy("host", "parent", "lead", "next").agg(F.sum("_o").alias("_pool"))
    family = cells.groupBy("host", "parent", "lead").agg(
        F.sum("_o").alias("_all"), F.count_distinct("next").alias("_k"), F.sum("_l").alias("_fl"), F.sum("_b").alias("_fb"))
    cells = salted_join(cells, pool, ["host", "parent", "lead", "next"], "node")
    nodes = cells.groupBy("host", "parent", "lead", "node").agg(
        F.sum(F.col("_o") * F.col("_o") / F.col("_pool")).alias("_sq"), F.sum("_o").alias("_n"),
        F.sum("_l").alias("_l"), F.sum("_b").alias("_b"))
    nodes = salted_join(nodes, family, ["host", "parent", "lead"], "node")
    free = F.col("_k") - 1
    shape = F.col("_sq") * F.col("_all") / F.col("_n") - F.col("_n") <= free + Z * F.sqrt(2.0 * free) + 1e-6
    p = F.try_divide("_fb", "_fl")
    off = F.col("_l") * F.pow(F.try_divide("_b", "_l") - p, 2)
    rate = (F.col("_l") < MIN_LABELS) | (off <= p * (1 - p) * (1 + Z * F.sqrt(F.lit(2.0))) + 1e-9)
    nodes = written(nodes.select("host", "parent", "lead", "node", "_l", "_b", (shape & rate).alias("merged")), "nodes")
    group = nodes.where("merged").groupBy("host", "parent", "lead").agg(F.sum("_l").alias("_gl"), F.sum("_b").alias("_gb"))
    nodes = salted_join(nodes, group, ["host", "parent", "lead"], "node")
    return nodes.select("host", "parent", "node", "merged", F.col("_l").alias("own"), F.when(F.col("merged"), F.col("_gl")).otherwise(F.col("_l")).alias("labelled"),
                        F.when(F.col("merged"), F.col("_gb")).otherwise(F.col("_b")).alias("bad"))


def branch_verdicts(counts: DataFrame) -> DataFrame:
    """``counts`` (host, template, n, labelled, bad) -> (host, template, purity,
    rejected)."""
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("_hl"), F.sum("bad").alias("_hb"))
    every = counts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("_p"))
    prior = (F.col("_hb") + SMOOTHING * every.scalar()) / (F.col("_hl") + SMOOTHING)
    hosts = hosts.select("host", prior.alias("_prior"))
    chain = counts.select("host", "template", F.explode(_steps(F.col("template"))).alias("s")).select(
        "host", "template", "s.depth", "s.node")
    nodes = branches(counts).select("host", "node", "own", "labelled", "bad")
    chain = salted_join(chain, nodes, ["host", "node"], "template").groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("depth", "own", "labelled", "bad"))).alias("_chain"), F.max("labelled").alias("_most"))

    def below(up, s):
        smooth = (s["bad"] + SMOOTHING * up) / (s["labelled"] + SMOOTHING)
        return F.when(s["own"] >= MIN_LABELS, smooth).otherwise(F.least(smooth, up))

    out = salted_join(chain, hosts, ["host"], "template").withColumn("purity", F.aggregate("_chain", F.col("_prior"), below))
    return out.select("host", "template", "purity",
                      ((F.col("_most") >= MIN_LABELS) & (F.col("purity") >= PURITY)).alias("rejected"))


def judge_urls(df: DataFrame, url: str, rules: list[tuple[str, str, str]], bad: str | None = None) -> DataFrame:
    """``df`` plus host, path, rule (NULL: none), template, purity and verdict.

    The tree's labels are the boolean column ``bad`` (NULL: no label) if one is
    named, else the rules' own verdicts (block: bad).  Clashing names get
    underscores in front."""
    own = df.columns
    names = {c: free_name(df, c) for c in ("host", "path", "rule", "template", "purity", "verdict")}
    packed = df.select(F.struct(*[col(c) for c in own]).alias("_row"), host_of(col(url)).alias("host"),
                       path_of(col(url)).alias("path"),
                       (col(bad) if bad else F.lit(None).cast("boolean")).alias("_bad"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    packed = packed.withColumn("rule", rule).withColumn("_said", said)
    label = F.col("_bad") if bad else F.col("_said") == "block"
    placed = templates(packed.withColumn("_label", label.cast("int")))
    counts = written(placed.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"),
        F.coalesce(F.sum("_label"), F.lit(0)).alias("bad")), "templates")
    verdicts = branch_verdicts(counts)
    out = salted_join(placed, verdicts, ["host", "template"], "path")
    verdict = F.coalesce(F.col("_said"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in own], F.col("host").alias(names["host"]),
                      F.col("path").alias(names["path"]), F.col("rule").alias(names["rule"]),
                      F.col("template").alias(names["template"]), F.col("purity").alias(names["purity"]),
                      verdict.alias(names["verdict"]))
