"""HTML extraction with a site style tree.

The pages of one host are merged into a style tree whose nodes are element
paths (tag and class names from the body down).  A page adds to each of its
nodes a *presentation* feature, the sequence of its child elements, and to each
text-bearing node *content* features, its blocks' texts.  Importance of a node
that m pages have:

* presentation: the entropy, to base m, of its child sequences over the pages;
* content: 1 less the mean entropy of the features below it, where a feature on
  c pages has entropy log_m c: what all pages repeat is worth 0, what one page
  alone has is worth 1;
* both combined with weight ``PRESENTATION`` on the former.

Branches whose importance is below a threshold are removed from each page of the
host.  The threshold grows with the pages that share the branch, from 0 for ``FEW_PAGES`` (which may be copies) to
``LOW`` for ``MIN_PAGES`` and more, so that few pages need clearer evidence.  So are
elements whose names
say that they are no article text (fixed lists below).  Where a page has
``article`` or ``main`` elements, only their text counts.  If the tree would
leave a page without text, the names alone decide for it.

Counting is grouped with partial aggregation, so a host with a third of all
pages is no single task; a page meets its host's list of removed branches in a
broadcast join if the lists' measured size allows it, else in a salted join.

NULL html gives an empty text; a NULL url belongs to the host without name.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import lookup
from .names import col, free_name
from .store import written
from .urlfilter import host_of

PRESENTATION = 0.1
FEW_PAGES = 3
MIN_PAGES = 8
LOW = 0.2

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg object noframes xmp".split())
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul select option optgroup button label legend caption head""".split())
NOISE = frozenset("nav footer aside form menu dialog head select button fieldset".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "p": ("p",)}
# fixed values: class, id and role words of parts that are no article text
NOISE_WORDS = frozenset("""ad ads advert advertisement adverts sponsor sponsored promo banner menu nav navbar
navigation breadcrumb breadcrumbs sidebar side-bar aside footer header masthead topbar comment comments
comment-list respond disqus cookie cookies consent gdpr notice notices notification popup modal newsletter
subscribe signup login search share sharing social related recommended pagination pager toolbar widget""".split())

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)"""
    r"""((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[\s_]+")
_DIGITS = re.compile(r"\d+")


def _words(attrs: str) -> list[str]:
    return [w for m in _NAMES.finditer(attrs) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]


class Page:
    """Blocks of one page: ``blocks`` has (path, text, noise, in article), in
    page order; ``children`` has each path's child sequence."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.children: dict[str, list[str]] = {}
        self.has_article = False
        # (tag, path, noise, inside an article)
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        buf: list[str] = []
        at, n = 0, len(html)

        def flush():
            if buf:
                text = " ".join(_html.unescape("".join(buf)).split())
                buf.clear()
                if text:
                    _, path, noise, inside = stack[-1]
                    self.blocks.append((path, text, noise, inside))

        def close_to(i: int):
            flush()
            del stack[i:]

        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                buf.append(html[at:])
                break
            if m.start() > at:
                buf.append(html[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCK or any(s[0] == tag for s in stack):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            close_to(i)
                            break
                    else:
                        flush()
                continue
            if tag in RAW:
                if tag == "svg" and m[3].rstrip().endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
                # without an end tag a script or style takes the rest of the page, any other only its own tag
                at = end.end() if end else n if tag in ("script", "style") else at
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    buf.append(" ") if tag == "br" else flush()
                continue
            words = _words(m[3]) if "=" in m[3] else []
            noisy = any(w in NOISE_WORDS for w in words)
            if tag not in BLOCK and not noisy:
                continue
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close_to(i)
                        break
                    if stack[i][0] in ("td", "th", "li", "div", "article", "section", "blockquote", "body", "main"):
                        break
            if tag in SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SAME[tag]:
                        close_to(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "div", "article", "section", "body"):
                        break
            flush()
            up = stack[-1]
            label = ".".join([tag, *sorted({_DIGITS.sub("0", w).replace("/", "-") for w in words})])
            path = f"{up[1]}/{label}"
            noise = up[2] or noisy and tag not in ("html", "body", "article", "main") or tag in NOISE \
                or tag == "header" and not up[3]
            inside = up[3] or tag in ("article", "main")
            self.has_article |= tag in ("article", "main") and not up[2]
            self.children.setdefault(up[1], []).append(label)
            self.children.setdefault(path, [])
            stack.append((tag, path, noise, inside))
        flush()

    def text(self, low: set[str] = frozenset()) -> str:
        """Article text without the branches ``low``."""
        out = [(p, t) for p, t, noise, inside in self.blocks if not noise and (inside or not self.has_article)]
        if low:
            left = [(p, t) for p, t in out if not any(p == x or p.startswith(x + "/") for x in low)]
            out = left or out
        return "\n".join(t for _, t in out)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _features(batches):
    for batch in batches:
        host, path, kind, feature = [], [], [], []
        for h, doc in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(doc.as_py() or "")
            seen = {(p, 0, _hash(t)) for p, t, noise, _ in page.blocks if not noise}
            noisy = {p for p, _, noise, _ in page.blocks if noise}
            seen |= {(p, 1, _hash(" ".join(c))) for p, c in page.children.items() if p and p not in noisy}
            for p, k, f in seen:
                host.append(h)
                path.append(p)
                kind.append(k)
                feature.append(f)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()),
                                          pa.array(kind, pa.int32()), pa.array(feature, pa.int64())],
                                         ["host", "path", "kind", "feature"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node, from (host, html)."""
    seen = pages.select("host", "html").mapInArrow(_features, "host string, path string, kind int, feature long")
    counted = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c")
    node = counted.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 1, c)).alias("m"),
        F.sum(F.when(F.col("kind") == 1, c * F.log(c))).alias("clogc"),
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.log(c))), F.lit(0.0)).alias("logs"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("features"))
    log_m = F.log(F.col("m"))
    node = node.where(F.col("m").isNotNull()).select(
        "host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("clogc") / (F.col("m") * log_m)).otherwise(1.0).alias("shape"),
        F.when(F.col("m") > 1, F.col("logs") / log_m).otherwise(0.0).alias("entropy"), "features")
    node = written(node, "nodes")
    # a node's content is its own and that of the nodes below
    steps = F.split(F.expr("substring(path, 2)"), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    below = (node.select("host", F.explode(ups).alias("path"), "entropy", "features")
             .groupBy("host", "path").agg(F.sum("entropy").alias("e"), F.sum("features").alias("f")))
    content = F.when(F.col("f") > 0, 1 - F.col("e") / F.col("f")).otherwise(1.0)
    return node.select("host", "path", "m", "shape").join(below, ["host", "path"]).select(
        "host", "path", F.col("m").alias("pages"),
        (PRESENTATION * F.col("shape") + (1 - PRESENTATION) * content).alias("importance"))


def extract_text(df: DataFrame, url: str, html: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) plus ``text``; a clashing
    name gets underscores in front."""
    kept = list(df.columns if keep is None else keep)
    name = free_name(df, text)
    pages = df.select(F.struct(*[col(c) for c in kept]).alias("_row"), host_of(col(url)).alias("host"),
                      F.coalesce(col(html), F.lit("")).alias("html"))
    sure = F.least((F.col("pages") - FEW_PAGES) / (MIN_PAGES - FEW_PAGES), F.lit(1.0))
    low = (style_tree(pages).where(F.col("importance") < LOW * sure)
           .groupBy("host").agg(F.collect_set("path").alias("low")))
    low = written(low, "low")
    size = F.octet_length("host") + F.octet_length(F.array_join("low", ",")) + 16
    told = lookup(pages, low, ["host"], "html", size).select(
        *[F.col("_row").getField(c).alias(c) for c in kept], F.col("html").alias(free_name(df, "_html")),
        F.col("low").alias(free_name(df, "_low")))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.StringType())])

    def run(batches):
        k = len(kept)
        for batch in batches:
            out = [Page(h.as_py()).text(set(x.as_py() or ())) for h, x in zip(batch.column(k), batch.column(k + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], [*kept, name])

    return told.mapInArrow(run, schema)
