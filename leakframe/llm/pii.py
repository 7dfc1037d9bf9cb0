"""Personal data: fixed patterns, and identifiers found through the contexts they stand in. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakframe.llm.matching import hits, joined, placed
from leakframe.llm.scratch import stored

# The patterns of the base spans, in order. Each takes a run of
# characters whole and starts at the run's start (or where the last match
# ended), which finds the same matches without trying every later start.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "(?<![0-9])[0-9]++(?:[\\x20-][0-9]++)*+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]

# Candidates for discovery: tokens with digits in them, at least this long.
CANDIDATE = "(?<![A-Za-z0-9_./@+-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9][A-Za-z0-9-]{4,}+(?![A-Za-z0-9_@/-])"
LEAST_SUPPORT = 3  # different known values a pattern must have been seen with
LEAST_PATTERN = 0.7  # confidence from which a pattern discovers
LEAST_VALUE = 0.7  # confidence from which a value counts as known


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its own digits added; the sum divides by ten."""
    ones = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    each = F.transform(ones, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") >= 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """The checks that drop failing base matches."""
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = F.forall(F.split(value, "\\."), lambda p: part(p) & (F.when(part(p), F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int")).otherwise(999) <= 255))
    digits = _digits(value)
    length = F.length(digits)
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(length.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", length.between(8, 15))
        .otherwise(True)
    )


def _pattern(before: Column) -> Column:
    """Two words, lower-cased, digits as one sign, one space between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(before), "\\s+", " "), "[0-9]+", "#")


def scan(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None,
    least_support: int = LEAST_SUPPORT, least_pattern: float = LEAST_PATTERN, least_value: float = LEAST_VALUE,
) -> DataFrame:
    """Spans of all texts: columns ``keep``, ``n_email`` ... ``n_phone``, ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (start, kind, end, value), by kind in
    the order of ``BASE``, then start; ``spans`` adds kind ``context``:
    identifiers that no base pattern matches, found by patterns of the two words
    before them, learnt from the whole table in as many rounds as make values known. Every row comes back, repeated ones too; null and empty texts
    and an empty table have empty arrays or no rows. Of clashing column names
    the results win.
    """
    made = {"_row", "base", "spans", "context", *BASE, *(f"n_{k}" for k in BASE)}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in made]
    t = F.col("_t")
    digit = t.rlike("[0-9]")
    table = stored(
        docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(
            *keep,
            F.monotonically_increasing_id().alias("_row"),
            hits(t, EMAIL, t.contains("@"), True).alias("email"),
            hits(t, IP, digit & t.rlike("[0-9]\\.[0-9]++\\.[0-9]"), True).alias("ip"),
            hits(t, CARD, digit & t.rlike("[0-9](?:[\\x20-]?[0-9]){15}"), True).alias("card"),
            hits(t, PHONE, t.contains("+"), True).alias("phone"),
            hits(t, CANDIDATE, digit, True).alias("context"),
        )
    )
    parts = stored(
        placed(table, "_row", [*BASE, "context"], True)
        .where(_holds(F.col("kind"), F.col("value")))
        .select("_row", "kind", "start", "end", "value", _pattern(F.col("before")).alias("pattern"))
    )
    base = parts.where(F.col("kind") != "context")
    unseen = _outside(parts)
    found = base.select("_row", "kind", "start", "end", "value").unionByName(
        _discover(base, unseen, least_support, least_pattern, least_value)
    )
    order = F.array_position(F.array(*[F.lit(k) for k in [*BASE, "context"]]), F.col("kind"))
    span = F.struct(order.alias("order"), F.col("start"), F.col("end"), F.col("kind"), F.col("value"))
    spans_of = found.groupBy("_row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    none = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string,value:string>>")
    spans = F.coalesce("spans", none)
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    return table.select(*keep, "_row").join(spans_of, "_row", "left").select(
        *keep,
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.transform(F.filter(spans, lambda s: s["kind"].isin(BASE)), plain).alias("base"),
        F.transform(spans, plain).alias("spans"),
    )


def _outside(parts: DataFrame) -> DataFrame:
    """Candidates that overlap no base span of their text."""
    by_start = Window.partitionBy("_row").orderBy("start")
    based = F.col("kind") != "context"
    before = F.max(F.when(based, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    # From the other end, so that the frame grows with the rows: one to the last row would be worked out anew for each.
    backwards = Window.partitionBy("_row").orderBy(F.desc("start"))
    after = F.min(F.when(based, F.col("start"))).over(backwards.rangeBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return parts.withColumn("_free", free & ~based).where("_free").drop("_free")


def _discover(base: DataFrame, unseen: DataFrame, least_support: int, least_pattern: float, least_value: float) -> DataFrame:
    """Candidate rows that high-confidence patterns accept.

    The graph has an edge for each different (pattern, value); counts of
    copies don't add belief. A round scores patterns by the known values they
    stand before, and unknown values by the patterns they stand behind. Belief
    only grows; the last round is the one that makes no further value known.
    """
    edges = stored(
        base.where(F.col("pattern").isNotNull()).select("pattern", "value", F.lit(1.0).alias("seed"))
        .unionByName(unseen.where(F.col("pattern").isNotNull()).select("pattern", "value", F.lit(0.0).alias("seed")))
        .groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    )
    belief = edges.withColumn("belief", F.col("seed"))
    known, before = -1, -2
    while known > before:
        patterns = stored(
            belief.groupBy("pattern")
            .agg(F.sum("belief").alias("mass"), F.count("*").alias("values"), F.count_if(F.col("belief") >= least_value).alias("support"))
            .where((F.col("support") >= least_support) & (F.col("mass") >= least_pattern * F.col("values")))
            .select("pattern", (F.col("mass") / F.col("values")).alias("trust"))
        )
        scored = edges.join(patterns, "pattern", "left")
        values = scored.groupBy("value").agg(
            F.max("seed").alias("known"),
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("trust", F.lit(0.0)), F.lit(1e-9)))))).alias("found"),
        )
        belief = stored(edges.join(values, "value").select("pattern", "value", "seed", F.greatest("known", "found").alias("belief")))
        known, before = belief.where(F.col("belief") >= least_value).count(), known
    trusted = belief.where((F.col("seed") == 0) & (F.col("belief") >= least_value)).select("value").distinct()
    accepted = unseen.join(trusted, "value", "left_semi").join(patterns.select("pattern"), "pattern", "left_semi")
    return accepted.select("_row", "kind", "start", "end", "value")


def digests(found: DataFrame, key: str) -> DataFrame:
    """``scan`` results as counts, a digest of the base spans, and all spans in one string."""
    return found.select(
        key, *[f"n_{k}" for k in BASE],
        F.sha2(F.encode(joined(F.col("base")), "utf-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
