"""Where regular expressions match, with DataFrame functions only.

Spark's functions give the matched strings but not their places. Cutting the
text at the matches gives what lies between, and running sums of both lengths
are the places, in code points. Running sums are a window over the few rows
that matches make, so cost stays linear in the text however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once: in a lambda a plain expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


HIT = "array<struct<gap:int,value:string,before:string>>"


#: The last two words with the white space before them.
TWO_WORDS = "\\s(\\S++\\s++\\S++)\\s*+$"
EARLIER = 16  # hits before a hit through which its words are followed


def _tail(gap: Column) -> Column:
    """The end of ``gap`` from the white space before its last two words on, all of it if there are fewer."""
    last = lambda part: F.nullif(F.regexp_extract(part, TWO_WORDS, 0), F.lit(""))
    return F.coalesce(last(F.substring(gap, -200, 200)), last(gap), gap)


def hits(text: Column, pattern: str, gate: Column | None = None, before: bool = False) -> Column:
    """Leftmost non-overlapping matches as (code points since the previous match, matched text, the last words of what lies between if ``before``).

    ``gate`` is a cheaper test that every text with a match passes.
    """
    tail = _tail if before else (lambda gap: F.lit(""))
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"), F.when(value.isNotNull(), tail(gap)).alias("before")),
    )
    found = F.filter(pairs, lambda hit: hit["value"].isNotNull())
    return F.when(text.rlike(pattern) if gate is None else gate, found).otherwise(F.array().cast(HIT)).cast(HIT)


def placed(table: DataFrame, row: str, kinds: list[str], before: bool = False) -> DataFrame:
    """One row (``row``, kind, start, end, value, before) for each hit in the ``hits`` columns named by ``kinds``.

    ``before`` are the last two words before the hit, of whatever length, earlier
    hits included; null where the text begins sooner, or where the words reach
    back over more than ``EARLIER`` hits.
    """
    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda hit, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), hit["gap"].alias("gap"), hit["value"].alias("value"), hit["before"].alias("before")))

    each = F.concat(*[labelled(kind) for kind in kinds])
    rows = table.where(F.greatest(*[F.size(k) for k in kinds], F.lit(0)) > 0).select(row, F.explode(each).alias("_hit")).select(row, "_hit.*")
    up_to = Window.partitionBy(row, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.length("value")).over(up_to)
    if before:
        earlier = Window.partitionBy(row, "kind").orderBy("i").rowsBetween(-EARLIER, -1)
        text = F.concat(F.array_join(F.collect_list(F.concat("before", "value")).over(earlier), ""), F.col("before"))
        # Up to there the text is whole if all earlier hits are in it; then it is as if white space preceded it.
        text = F.when(F.col("i") <= EARLIER, F.concat(F.lit(" "), text)).otherwise(text)
        rows = rows.withColumn("before", F.nullif(F.regexp_extract(text, TWO_WORDS, 1), F.lit("")))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).select(row, "kind", "start", "end", "value", "before")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs in its order, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
