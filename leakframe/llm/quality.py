"""Quality rules whose cutoffs carry a guarantee against rejecting good texts. DataFrame functions only.

For each stratum and rule, labelled rows held out for the purpose decide how
strict the rule may be: a cutoff is certified if an exact binomial test refutes,
at a level corrected for all strata and rules, that it rejects more than the
allowed share of good texts. Cutoffs are tested from lenient to strict and the
sequence stops at the first failure, so no further correction is due within it
(fixed-sequence testing). All rules together reject at most ``risk`` of the
good texts of every stratum, with probability 1 - ``doubt``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakframe.llm.matching import let
from leakframe.llm.scratch import stored

RISK = 0.05
DOUBT = 0.05
WINDOW = 5
LEAST_WORDS = 10  # base rule
MOST_REPEATED = 20  # base rule, percent of words in repeated windows

#: rule: cutoffs from lenient to strict; a text at or above the cutoff is rejected.
#: Fixed in advance, never taken from the labelled rows that certify them.
RULES: dict[str, list[float]] = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeated": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "shortness": [1 / 10, 1 / 12, 1 / 14, 1 / 16, 1 / 18, 1 / 20, 1 / 25, 1 / 30, 1 / 40],
    "long_words": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
    "short_words": [1.0, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
}


def measures(text: Column) -> Column:
    """Base counts of a text as one struct, row-local. Null and empty texts count zero everywhere."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return F.struct(
        let(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice among the text's windows.

    Most texts have no such window; only the others are sorted. Windows are
    told apart by 64-bit hashes of their words.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    count = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, window)).otherwise(0))
    return F.when(F.size(words) > window, count).otherwise(0).cast("long")


def _covered(hashed: Column, window: int) -> Column:
    """How many positions the windows cover that have an equal neighbour in sorted order."""

    def positions(ranked: Column) -> Column:
        marked = F.filter(
            ranked,
            lambda s, j: ((j > 0) & (F.get(ranked, j - 1)["h"] == s["h"])) | F.coalesce(F.get(ranked, j + 1)["h"] == s["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(marked, lambda s: s["i"]))

    def cover(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    ranked = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ranked, lambda r: let(positions(r), cover))


def scores() -> dict[str, Column]:
    """What the rules compare with their cutoffs, from the base counts. Texts without words score 0 but for shortness."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated": F.col("n_repeat_words") / words,
        "shortness": 1 / words.cast("double"),
        "long_words": F.col("word_chars") / words,
        "short_words": F.when(F.col("word_chars") > 0, words / chars).otherwise(0.0),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding, in logarithms so that large n don't vanish.

    From the mean on it is a half or more, whatever the rest of the sum, and 1 is
    returned; so no more than ``n * p`` terms are ever added.
    """
    log_odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), F.lit(1.0).alias("sum"), (n * math.log1p(-p)).alias("top"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + log_odds
        top = F.greatest(state["top"], term)
        return F.struct(term.alias("term"), (state["sum"] * F.exp(state["top"] - top) + F.exp(term - top)).alias("sum"), top.alias("top"))

    state = F.aggregate(F.when((k >= 1) & (k < n * p), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add)
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), state["sum"] * F.exp(state["top"])))


def certify(labelled: DataFrame, stratum: str, good: str, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """A certified cutoff for each stratum and rule: (stratum, rule, cutoff).

    ``labelled`` has the stratum, the rules' scores and ``good`` (boolean). All
    cutoffs up to the first failure are certified together, so any of them may
    be taken: the one that parts bad from good best, the most lenient of equals.
    A rule that parts nothing, or has no certified cutoff in a stratum for want
    of good rows, has no row and rejects nothing there.
    """
    share, strata = risk / len(RULES), F.col("_strata")
    candidates = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(cut)).alias("cutoff"), (F.col(rule) >= cut).alias("rejected"))
        for rule, cuts in RULES.items() for i, cut in enumerate(cuts)
    ]))
    # Strata x rules x cutoffs rows from here on.
    counts = (
        labelled.select(stratum, F.col(good).alias("_good"), candidates.alias("c")).select(stratum, "_good", "c.*")
        .groupBy(stratum, "rule", "step", "cutoff").agg(
            F.count_if("_good").alias("n"), F.count_if(F.col("_good") & F.col("rejected")).alias("k"),
            F.count_if(~F.col("_good")).alias("bad_n"), F.count_if(~F.col("_good") & F.col("rejected")).alias("bad_k"),
        )
    )
    counts = counts.crossJoin(F.broadcast(labelled.agg(F.greatest(F.count_distinct(stratum), F.lit(1)).alias("_strata"))))
    level = F.lit(doubt) / (strata * len(RULES))
    passed = counts.withColumn("passed", binomial_cdf(F.col("k"), F.col("n"), share) <= level)
    so_far = Window.partitionBy(stratum, "rule").orderBy("step")
    passed = passed.withColumn("all", F.min(F.col("passed").cast("int")).over(so_far)).where("all = 1")
    gain = F.col("bad_k") / F.greatest("bad_n", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    best = passed.withColumn("gain", gain).groupBy(stratum, "rule").agg(F.max(F.struct("gain", -F.col("step"), "cutoff")).alias("best"))
    return best.where("best.gain > 0").select(stratum, "rule", "best.cutoff")


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality",
    risk: float = RISK, doubt: float = DOUBT,
) -> DataFrame:
    """``key``, base counts, ``base_failed``, ``failed_rules`` and ``kept`` for every row of ``docs``.

    Labels whose key is null, unknown or not 0 or 1 certify nothing; a key
    labelled twice counts once, as good only if all its labels say so. Repeated
    rows of ``docs`` stay. Labelled rows with the same text in a stratum are one
    trial, good only if all of them are: the bounds are those of independent
    texts. They hold for the certified rules; the base rules come on top. A null
    stratum is a stratum of its own. With few or
    no labels no cutoff is certified, and the base rules alone decide.
    """
    table = stored(
        docs.select(F.col(key).alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.col(text).cast("string").alias("_text"))
        .select("_key", "_stratum", F.unhex(F.md5(F.coalesce("_text", F.lit("")).cast("binary"))).alias("_mark"), measures(F.col("_text")).alias("_m"))
        .select("_key", "_stratum", "_mark", "_m.words.*", "_m.lines.*", "_m.n_symbols")
    )
    scored = table.select("*", *[c.alias(name) for name, c in scores().items()])
    known = labels.where(F.col(key).isNotNull() & F.col(good).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg((F.min(good) == 1).alias("_good"))
    trials = scored.join(known, "_key").groupBy("_stratum", "_mark").agg(F.min("_good").alias("_good"), *[F.any_value(r).alias(r) for r in RULES])
    certified = certify(trials, "_stratum", "_good", risk, doubt)
    cutoffs = certified.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    failed = F.filter(F.array(*[F.when(F.col(r) >= F.col("_cutoffs")[r], F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        scored.join(cutoffs, "_stratum", "left")
        .withColumns({"base_failed": base_failed, "failed_rules": failed})
        .select(
            F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules",
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        )
    )

