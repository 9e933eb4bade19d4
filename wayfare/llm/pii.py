"""Personal data: base patterns and bootstrapped contextual extraction.

*Base.*  Emails, IP addresses, card numbers and phone numbers are leftmost
non-overlapping matches of fixed patterns, kind by kind; matches that fail
their check (parts over 255, number of digits, Luhn) are dropped.

*Bootstrapping.*  Seeds are the base spans and assigned secrets (a token of
``SECRET_LENGTH`` characters or more, with letters and digits, in quotes after
``=`` or ``:``).  An identifier-like token (letters, digits, ``_`` and ``-``,
``MIN_LENGTH`` characters or more with ``MIN_DIGITS`` digits) that no base span
overlaps is an instance.  An entity induces several lexical patterns: the word
before it, the two words before, the word after and, for tokens, their shape
(digits as 0, letters as a or A).  Words are lower case with digits as 0.

The graph of patterns and values is scored to a fixed point.  A pattern's
confidence is the score of the values in its occurrences, summed, over the number of
all its occurrences in the corpus, entity or not (one more unknown is added); it
is 0 until ``MIN_SEEDS`` distinct values of the pattern score ``CONFIDENCE``, so
discovered values count as seeds from then on.  A seed's score is 1, another value's
the noisy-or of its patterns' confidences from ``WEAK`` on.  Scores never fall;
rounds end when none rises by ``STEP``.  Tokens whose value scores
``CONFIDENCE`` are added as spans of kind ``id`` where one of the patterns there
does as well.

Only DataFrame functions are used.  Positions count code points, ends are
exclusive.  A NULL text is empty; rows that share an id, also a NULL one, are
separate rows; equal scores need no order, because all that reach a threshold
pass.  An empty table gives an empty result.  Texts have any length: only a
match's own words travel on.  Only ``ident`` and ``text`` are read, so other
columns' names do not matter.  A pattern that a third of all instances follow is
aggregated before it is shuffled and joined as one small row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import lookup
from .names import col
from .store import written

STEP = 0.001
MIN_SEEDS = 5
MIN_LENGTH = 6
MIN_DIGITS = 3
CONFIDENCE = 0.7
WEAK = 0.3
SECRET_LENGTH = 20
GRAM_BYTES = 16           # of a pattern in a broadcast

# The fixed patterns.  Look-behinds and possessive quantifiers only keep the
# search linear: a match cannot start inside a run that an earlier start would
# have matched whole, except where the previous match ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
KINDS = ("email", "ip", "card", "phone", "id")
_PATTERNS = (EMAIL, IP, CARD, PHONE, TOKEN)
_OCTET = r"0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _luhn(digits):
    """Luhn check of a string of digits."""
    def step(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind, value):
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
            .when(kind == 2, F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False))
            .when(kind == 3, (n >= 10) & (n <= 15))
            .otherwise((F.length(value) >= MIN_LENGTH) & (n >= MIN_DIGITS)))


def _plain(words):
    """Words of a pattern: lower case, single blanks, digits as 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(words), r"\s+", " "), "[0-9]+", "0")


def _before(piece):
    """The one or two words that a piece ends with (empty: none)."""
    return _plain(F.regexp_extract(F.substring(piece, -80, 80), r"((?:[^\s]+\s+)?[^\s]+)\s*$", 1))


def _after(piece):
    """The word that a piece begins with, after what is attached to the entity."""
    return _plain(F.regexp_extract(F.substring(piece, 1, 80), r"^[^\s]*\s+([^\s]+)", 1))


def _patterns(kind, before, after, value):
    """Patterns of an entity: array of (p, gram), gram the words whose
    occurrences count (NULL: shapes, which only tokens have)."""
    last = F.substring_index(before, " ", -1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    one = lambda when, name, words, gram=True: F.when(when, F.struct(
        F.xxhash64(F.lit(name), words).alias("p"), (F.xxhash64(words) if gram else F.lit(None).cast("long")).alias("gram")))
    return F.array_compact(F.array(
        one(F.length(last) > 0, "before", last), one(F.contains(before, F.lit(" ")), "two", before),
        one(F.length(after) > 0, "after", after), one(kind == 4, "shape", shape, False)))


def matches(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per pattern match (rid, id, kind, start, end, value, valid, seed,
    patterns); a document without any has one row with kind NULL."""
    t = F.col("_t")
    docs = df.select(F.monotonically_increasing_id().alias("rid"), col(ident).alias("id"),
                     F.coalesce(col(text), F.lit("")).alias("_t"))
    digit = t.rlike("[0-9]")
    may = (t.contains("@"), digit & t.contains("."), digit, digit & t.contains("+"), digit)
    found = [F.when(m, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
             for m, p in zip(may, _PATTERNS)]
    # a text is its pieces between matches and the matches in turn: lengths give positions
    lists = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("values"),
                                        F.when(F.size(f) > 0, F.split(t, p, -1)).alias("pieces"))
                               for k, (f, p) in enumerate(zip(found, _PATTERNS))]), lambda s: F.size(s["values"]) > 0)
    per = docs.select("rid", "id", F.explode_outer(lists).alias("s"))
    per = per.select("rid", "id", "s.kind", F.col("s.values").alias("value"), F.transform("s.pieces", F.length).alias("gap"),
                     F.transform("s.pieces", _before).alias("before"),
                     F.transform("s.pieces", lambda x: x.rlike(r"""[=:]\s*["']$""")).alias("assigned"),
                     F.transform(F.slice("s.pieces", 2, F.greatest(F.size("s.pieces") - 1, F.lit(0))), _after).alias("after"))
    part = per.select("rid", "id", "kind", F.posexplode_outer(
        F.arrays_zip("value", "gap", "before", "assigned", "after")).alias("pos", "m")).select("rid", "id", "kind", "pos", "m.*")
    part = part.where(F.col("pos").isNull() | F.col("value").isNotNull() | F.col("gap").isNotNull())
    upto = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(upto)
    placed = part.withColumn("end", end).where(F.col("kind").isNull() | F.col("value").isNotNull())
    secret = (F.col("assigned") & (F.length("value") >= SECRET_LENGTH) & F.col("value").rlike("[A-Za-z]"))
    return placed.select("rid", "id", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value",
                         _valid(F.col("kind"), F.col("value")).alias("valid"), ((F.col("kind") < 4) | secret).alias("seed"),
                         _patterns(F.col("kind"), F.col("before"), F.col("after"), F.col("value")).alias("patterns"))


def occurrences(df: DataFrame, text: str, grams: DataFrame) -> DataFrame:
    """(gram, occ): how often the words of ``grams`` occur in all texts."""
    words = F.split(_plain(F.coalesce(col(text), F.lit(""))), " ")
    words = df.select(words.alias("w")).select(F.explode(F.concat(
        F.transform("w", lambda x: F.xxhash64(x)),
        F.zip_with("w", F.slice("w", 2, F.size("w")), lambda x, y: F.when(y.isNotNull(), F.xxhash64(F.concat_ws(" ", x, y)))))
    ).alias("gram"))
    wanted = written(grams.select("gram", F.lit(True).alias("_wanted")), "grams")
    met = lookup(words.where(F.col("gram").isNotNull()), wanted, ["gram"], F.monotonically_increasing_id(), F.lit(GRAM_BYTES))
    return met.where("_wanted").groupBy("gram").agg(F.count(F.lit(1)).alias("occ"))


def score_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p, confidence) and (value, score) at the fixed point of a graph of
    distinct (p, value, w, seed, n) edges; w counts the edge's occurrences, n
    all occurrences of the pattern."""
    score = written(edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score")), "scores")
    while True:
        conf = edges.join(score, "value").groupBy("p").agg(
            F.sum(F.col("w") * F.col("score")).alias("mass"), F.max("n").alias("n"),
            F.count(F.when(F.col("score") >= CONFIDENCE, 1)).alias("known"))
        conf = written(conf.where(F.col("known") >= MIN_SEEDS).select(
            "p", (F.col("mass") / (F.col("n") + 1)).alias("confidence")), "patterns")
        told = edges.where(~F.col("seed")).join(conf.where(F.col("confidence") >= WEAK), "p").groupBy("value").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("told"))
        new = written(score.join(told, "value", "left").select(
            "value", F.greatest("score", F.coalesce("told", F.lit(0.0))).alias("score"), F.col("score").alias("old")), "scores")
        rise = new.agg(F.max(F.col("score") - F.col("old"))).first()[0] or 0.0
        score = new.drop("old")
        if rise < STEP:
            return conf, score


def find_pii(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Per row of ``df``: (id, spans) with spans an array of (start, kind_no,
    end, kind) in order: base kinds 0-3 and discovered identifiers (4)."""
    found = written(matches(df, ident, text), "matches")
    valid = found.where(F.col("valid"))
    # an identifier-like token counts where no base span overlaps it
    base = F.col("kind") < 4
    order = Window.partitionBy("rid").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    usable = written(valid.withColumn("_free", free).where(base | F.col("_free")).drop("_free", "valid"), "spans")
    value = F.xxhash64("value").alias("value")
    pairs = (usable.select(value, "seed", F.explode("patterns").alias("m")).groupBy("m.p", "m.gram", "value")
             .agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("w")))
    # a value that was a seed once is one everywhere
    seeds = usable.where("seed").select(value).distinct().withColumn("_is", F.lit(True))
    pairs = written(pairs.join(seeds, "value", "left").withColumn("seed", F.coalesce("_is", F.lit(False))).drop("_is"), "edges")
    # only patterns with enough values can become confident
    live = written(pairs.groupBy("p", "gram").agg(F.count(F.lit(1)).alias("values"), F.sum("w").alias("all"))
                   .where(F.col("values") >= MIN_SEEDS), "live")
    counted = live.join(occurrences(df, text, live.select("gram").where(F.col("gram").isNotNull()).distinct()), "gram", "left")
    counted = counted.select("p", F.greatest("all", F.coalesce("occ", F.lit(0))).alias("n"))
    conf, score = score_graph(written(pairs.drop("gram").join(counted, "p"), "graph"))
    sure = conf.where(F.col("confidence") >= CONFIDENCE).select("p")
    named = score.where(F.col("score") >= CONFIDENCE).select("value")
    seen = usable.select("rid", "id", "kind", "start", "end", value, "patterns")
    new = (seen.where(~base).join(named, "value", "left_semi").withColumn("p", F.explode("patterns.p"))
           .join(sure, "p", "left_semi").dropDuplicates(["rid", "start", "end"]))
    cols = ("rid", "id", "kind", "start", "end")
    none = found.where(F.col("kind").isNull() | ~F.col("valid") | ~base).select(
        "rid", "id", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("end")).distinct()
    every = seen.where(base).select(*cols).unionByName(new.select(*cols)).unionByName(none.select(*cols))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", F.col("kind").alias("kind_no"), "end", name.alias("kind")))
    out = every.groupBy("rid", "id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select(F.col("id").alias(ident), "spans")


def span_text(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
