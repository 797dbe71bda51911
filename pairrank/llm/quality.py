"""Quality rules whose thresholds come with a guarantee on a labelled holdout.

Fixed base rules reject documents that are hardly text. On top, each rule of ``RULES``
gives a document an integer score (higher is worse) and rejects it above a cutoff. For
every stratum and rule the strictest cutoff of the rule's ladder is taken for which an
exact binomial test shows, on the labelled good documents of the stratum, that the rule
rejects at most its share of the allowed rate of good documents:

    P(Binomial(n, rate) <= falsely rejected) <= level

which is the same as a Clopper-Pearson upper bound of at most ``rate``. Rejections only
grow towards the strict end of a ladder, so its cutoffs are tested in a fixed sequence
from the lenient end and need no correction among themselves; the level is divided by the
number of (stratum, rule) ladders (Bonferroni), and the rate by the number of rules, so
that with the asked confidence no stratum loses more than ``max_false`` of its good
documents to all rules together. Where the holdout is too small nothing is rejected.

Everything counts all labelled documents; nothing is sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.expressions import let, pick, words
from pairrank.runtime import materialise

# The characters counted as symbols, and the base limits.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Rule: (numerator, denominator, ladder of cutoffs). The score is floor(1000 * numerator / denominator).
RULES = {
    "symbols": ("n_symbols", "word_chars", range(0, 1001, 10)),
    "dup_lines": ("n_dup_lines", "n_lines", range(0, 1001, 20)),
    "repeats": ("n_repeat_words", "n_words", range(0, 501, 10)),
    "word_length": ("word_chars", "n_words", range(4000, 20001, 100)),
}
MAX_FALSE = 0.02
CONFIDENCE = 0.95
# Terms of a binomial tail that are added one by one; what is left is bounded from above.
TERMS = 100_000
# Rows of the cutoff table that may be broadcast.
BROADCAST_STRATA = 10_000


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a 3-word window found twice or more; ``hashes`` is one number a word."""
    windows = F.when(F.size(hashes) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 3),
        lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
    ))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(placed, lambda s: F.filter(
            F.transform(s, lambda x, j: F.when(
                x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]), x["i"])),
            lambda i: i.isNotNull(),
        ))
        # The union of the intervals [i, i + 3), from left to right.
        return F.aggregate(
            F.sort_array(repeated), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")),
            lambda a: a["n"],
        )

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def measures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Per row: doc_id, stratum, the counts that the rules use, and base_failed.

    Counts are over the whole text; a null text has no words. A null stratum is the
    stratum ``none``. Repeated rows are measured each for itself.
    """
    rows = pick(documents, doc_id=doc_id, text=text, stratum=stratum).select(
        "doc_id", F.coalesce(F.col("stratum").cast("string"), F.lit("none")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \t-\r]"))
    cut = rows.select("doc_id", "stratum", "text", words(F.col("text")).alias("words"), lines.alias("lines"))
    counted = cut.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    ).withColumn("n_repeat_words", F.coalesce(repeated_words(F.col("hashes")), F.lit(0)).cast("long")).drop("hashes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def score(rule: str) -> Column:
    """The rule's integer score; 0 where there is nothing to divide by."""
    above, below, _ = RULES[rule]
    return F.when(F.col(below) > 0, F.floor(1000 * F.col(above) / F.col(below))).otherwise(0).cast("long")


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1, by Stirling's series from x + 10 on."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = x
    for i in range(1, 10):
        shift = shift * (x + i)
    return series - F.log(shift)


def log_tail(n: Column, k: Column, rate: float) -> Column:
    """log P(Binomial(n, rate) <= k) for k < n * rate.

    Adds the terms from k downwards; they fall at least as fast as a geometric series,
    which bounds those beyond ``TERMS`` from above.
    """
    n, k = n.cast("double"), k.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    odds = (1 - rate) / rate
    summed = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(0), (F.least(k, F.lit(float(TERMS))) - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: let(a["term"] * (k - i) * odds / (n - k + i + 1), lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum"))),
    )
    falling = k * odds / (n - k + 1)
    rest = F.when(k > TERMS, summed["term"] * falling / (1 - falling)).otherwise(0.0)
    return top + F.log(summed["sum"] + rest)


def cutoffs(measured: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, confidence: float = CONFIDENCE,
            doc_id: str = "doc_id", good: str = "quality") -> DataFrame:
    """One row per stratum with labelled good documents: a cutoff for each rule, null if none is certified.

    ``labels`` holds 1 for good documents; of several labels of a document the largest
    counts, null ones don't. Only documents that pass the base rules are counted. Cutoffs
    are certified per stratum on ``n_good`` documents. Without labels the result is empty.
    """
    marked = pick(labels, doc_id=doc_id, good=good).groupBy("doc_id").agg(F.max("good").alias("good")).where("good = 1")
    holdout = measured.where(~F.col("base_failed")).join(marked, "doc_id", "left_semi")
    scores = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), score(r).alias("score")) for r in RULES)))
    # At most as many rows per stratum and rule as a rule has different scores on its ladder.
    top = F.element_at(F.create_map(*(F.lit(x) for r, (_, _, c) in RULES.items() for x in (r, c[-1] + 1))), F.col("rule"))
    seen = (
        holdout.select("stratum", scores.alias("s")).select("stratum", "s.*")
        .withColumn("score", F.least("score", top)).groupBy("stratum", "rule", "score").agg(F.count("*").alias("n"))
    )
    per_rule = seen.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n_good"), F.collect_list(F.struct("score", "n")).alias("seen"))
    ladder = F.explode(F.element_at(F.create_map(*(
        x for r, (_, _, c) in RULES.items() for x in (F.lit(r), F.sequence(F.lit(c[0]), F.lit(c[-1]), F.lit(c.step))))), F.col("rule")))
    tried = per_rule.withColumn("cutoff", ladder).withColumn("rejected", F.aggregate(
        F.filter("seen", lambda s: s["score"] > F.col("cutoff")), F.lit(0).cast("long"), lambda a, s: a + s["n"])).drop("seen")
    rate = max_false / len(RULES)
    level = math.log((1 - confidence) / (max(1, holdout.select("stratum").distinct().count()) * len(RULES)))
    certified = (
        tried.where(F.col("rejected") < F.col("n_good") * rate)
        .where(log_tail(F.col("n_good"), F.col("rejected"), rate) <= level)
    )
    chosen = certified.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return (
        per_rule.select("stratum", "rule", "n_good").join(chosen, ["stratum", "rule"], "left").groupBy("stratum")
        .agg(F.max("n_good").alias("n_good"), *(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES))
    )


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: the base rules passed and no certified cutoff of the stratum exceeded."""
    few = limits.count() <= BROADCAST_STRATA
    rows = measured.join(F.broadcast(limits) if few else limits, "stratum", "left")
    bad = F.col("base_failed")
    for rule in RULES:
        bad = bad | F.coalesce(score(rule) > F.col(f"max_{rule}"), F.lit(False))
    return rows.withColumn("kept", ~bad)


def filter_quality(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Measures and verdict of every row of ``documents``; the texts are read once."""
    measured = materialise(measures(documents), "quality")
    return judge(measured, materialise(cutoffs(measured, labels, **options), "cutoffs"))
