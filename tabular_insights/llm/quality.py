"""Quality rules whose cutoffs are chosen under a controlled risk of false rejection.

Each rule rejects a document whose measure exceeds a cutoff of a fixed grid. The labelled
good documents of a stratum are its holdout: with ``n`` of them and ``k`` rejected, the exact
binomial tail ``P(Bin(n, risk) <= k)`` is the p-value of "this rejects more than ``risk`` of
the good documents". A cutoff is certified where that value is at most its share of the
error; :func:`certify_in_sequence` says how the error is shared between strata, rules and
cutoffs, so that all statements hold together. Of the certified cutoffs those that reject the
most labelled bad documents are taken, the loosest of equals. A rule without a certified
cutoff that rejects a bad document is not used in the stratum.

Everything is DataFrame functions. Measures of a document need no shuffle; the counts per
stratum combine in each task. Strata are all labelled languages, however many; Spark picks
the join with the table of cutoffs, one row for each, by its size.

Defined cases: a null or empty text has no words and fails the base rules; documents
without a language, or of a language without a label, share the stratum ``other``; without labels no rule is certified and only
the base rules decide; repeated rows are judged alike, each giving its row; a label that
is null counts as neither good nor bad; an empty table gives an empty table. Windows of
words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabular_insights.llm.common import WORD, any_of
from tabular_insights.session import stage

REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Measures in thousandths and the grid of their cutoffs, loosest first.
RULES = {
    "symbol_rate": [200, 150, 100, 80, 60, 50, 40, 30, 20, 10],
    "repeat_rate": [300, 250, 200, 150, 100, 80, 60, 40, 20, 10],
    "dup_line_rate": [500, 400, 300, 250, 200, 150, 100, 80, 50, 20],
    "word_length": [14000, 12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500, 7000],
}
ALLOWANCE, ERROR = 0.02, 0.05
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of :data:`_COUNTS`; columns of those names are replaced."""
    base = df.drop(*_COUNTS).withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    base = base.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    )
    starts = F.when(
        F.size("_words") >= REPEAT_WINDOW, F.sequence(F.lit(0), F.size("_words") - REPEAT_WINDOW)
    ).otherwise(F.array().cast("array<int>"))
    base = base.withColumn(
        "_windows",
        F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(REPEAT_WINDOW)])),
    )
    base = base.withColumn(
        "_order",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeated = F.filter(
        "_order", lambda w, j: (w.h == F.get("_order", j - 1).h) | (w.h == F.get("_order", j + 1).h)
    )
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda w: w.i)),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct(
            (i + REPEAT_WINDOW).alias("end"),
            (a.n + F.least(F.lit(REPEAT_WINDOW), i + REPEAT_WINDOW - a.end)).alias("n"),
        ),
        lambda a: a.n,
    )
    long = lambda c: c.cast("long")
    return base.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": long(F.length(F.array_join("_words", ""))),
            "n_symbols": long(F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", ""))),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
        }
    ).drop("_text", "_words", "_lines", "_windows", "_order")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The measure of each rule in whole thousandths, rounded down."""
    part = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0)
    return {
        "symbol_rate": part("n_symbols", "word_chars"),
        "repeat_rate": part("n_repeat_words", "n_words"),
        "dup_line_rate": part("n_dup_lines", "n_lines"),
        "word_length": part("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """``P(Bin(n, risk) <= k)`` for ``k <= risk * n``; 1 beyond, where no test can succeed.

    The largest term in logarithms, times the sum of the terms below it as ratios to it.
    """
    log_choose = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda a, j: a + F.log((n - j + 1).cast("double") / j)
    )
    log_term = F.when(k > 0, log_choose).otherwise(0.0) + k * F.log(F.lit(risk)) + (n - k) * F.log(F.lit(1 - risk))
    ratios = F.aggregate(
        F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            (a.t * i * (1 - risk) / ((n - i + 1) * risk)).alias("t"),
            (a.s + a.t * i * (1 - risk) / ((n - i + 1) * risk)).alias("s"),
        ),
        lambda a: a.s,
    )
    return F.when(k > risk * n, 1.0).otherwise(F.exp(log_term) * F.when(k > 0, ratios).otherwise(1.0))


def strata(labelled: DataFrame, language: str) -> DataFrame:
    """The labelled languages."""
    return labelled.filter(F.col(language).isNotNull()).select(F.col(language).alias("stratum")).distinct()


def with_stratum(df: DataFrame, names: DataFrame, language: str) -> DataFrame:
    """``df`` with its stratum."""
    known = names.select(F.col("stratum").alias("_known"))
    joined = df.drop("stratum").join(known, F.col(language) == F.col("_known"), "left")
    return joined.withColumn("stratum", F.coalesce("_known", F.lit("other"))).drop("_known")


def _certified(passed: DataFrame, tests: dict[tuple[str, int], Column], risk: float, level: float) -> DataFrame:
    """Rows ``(stratum, rule, cutoff, caught)``: of the tests of each rule that are certified
    and reject a bad document the one that rejects most, the largest cutoff of equals."""
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    tested = passed.groupBy("stratum").agg(
        F.count(F.when(good, 1)).alias("n"),
        F.array(
            *[
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(cutoff).alias("cutoff"),
                    F.count(F.when(good & hit, 1)).alias("k"),
                    F.count(F.when(bad & hit, 1)).alias("caught"),
                )
                for (rule, cutoff), hit in tests.items()
            ]
        ).alias("tests"),
    )
    sure = tested.select("stratum", "n", F.inline("tests")).filter("caught > 0")
    sure = sure.filter(binomial_tail(F.col("n"), F.col("k"), risk) <= level)
    best = F.max(F.struct("caught", "cutoff")).alias("best")
    return sure.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "best.cutoff", "best.caught")


def certify_in_sequence(
    labelled: DataFrame, rules: dict[str, list[int]] = RULES, allowance: float = ALLOWANCE, error: float = ERROR
) -> DataFrame:
    """One row for each stratum of ``labelled`` (stratum, quality, measured counts): its
    cutoff for every rule, null where the rule is not used.

    The strata that have good labels share the error. Cutoffs are tested loosest first until one fails, which needs no division by their
    number; as a tighter cutoff rejects no fewer documents, the tests before a certified one
    are certified as well. Half of a stratum's error tests each rule by itself, at the
    allowance divided by the rules. The other half tests all rules at once, tightened
    together, at the whole allowance, which a few hundred good labels can meet. All these
    statements hold together, so the set of cutoffs that rejects more bad documents is taken.
    """
    passed = stage(labelled.filter(~base_failed()), "labelled")
    present = passed.filter("quality = 1").agg(F.count_distinct("stratum")).first()[0] or 1
    values, level = measures(), error / (2 * present)
    alone = {(rule, cutoff): values[rule] > cutoff for rule, grid in rules.items() for cutoff in grid}
    chosen = _certified(passed, alone, allowance / len(rules), level / len(rules))
    each = stage(chosen.groupBy("stratum").pivot("rule", list(rules)).agg(F.first("cutoff")), "cutoffs")
    caught = F.count(F.when((F.col("quality") == 0) & ~F.col("kept"), 1))
    each = each.join(judge(passed, each, rules).groupBy("stratum").agg(caught.alias("_each")), "stratum")
    steps = range(max(map(len, rules.values())))
    at = {rule: [grid[min(step, len(grid) - 1)] for step in steps] for rule, grid in rules.items()}
    together = {("all", -step): any_of(values[rule] > at[rule][step] for rule in rules) for step in steps}
    joint = _certified(passed, together, allowance, level).select("stratum", F.col("cutoff").alias("_step"), F.col("caught").alias("_joint"))
    both = each.join(joint, "stratum", "full")
    better = F.coalesce(F.col("_joint") > F.coalesce("_each", F.lit(0)), F.lit(False))
    cutoff = {rule: F.get(F.array(*map(F.lit, grid)), -F.col("_step")) for rule, grid in at.items()}
    return both.select("stratum", *[F.when(better, cutoff[rule]).otherwise(F.col(rule)).alias(rule) for rule in rules])


def judge(df: DataFrame, cutoffs: DataFrame, rules: dict[str, list[int]] = RULES) -> DataFrame:
    """Measured rows with ``base_failed``, ``rejected_by`` (rules) and ``kept``."""
    table = cutoffs.select("stratum", *[F.col(r).alias(f"_{r}") for r in rules])
    values = measures()
    hits = {r: F.coalesce(values[r] > F.col(f"_{r}"), F.lit(False)) for r in rules}
    joined = df.join(table, "stratum", "left").withColumn("base_failed", base_failed())
    return joined.withColumns(
        {
            "rejected_by": F.array_compact(F.array(*[F.when(hits[r], F.lit(r)) for r in rules])),
            "kept": ~F.col("base_failed") & ~any_of(hits.values()),
        }
    ).drop(*[f"_{r}" for r in rules])


def learn(measured: DataFrame, labels: DataFrame, id_col: str, language: str) -> tuple[DataFrame, DataFrame]:
    """Strata and cutoffs from measured documents and ``labels`` (id, quality), both staged."""
    label = labels.select(F.col(id_col).alias("_id"), F.col("quality"))
    counted = measured.select(F.col(id_col).alias("_id"), language, *_COUNTS)
    labelled = counted.join(label, "_id").drop("_id")
    names = stage(strata(labelled, language), "strata")
    return names, stage(certify_in_sequence(with_stratum(labelled, names, language)), "cutoffs")


def keep_good(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Rows of ``df`` that no rule rejects, with the measured columns.

    Texts are measured once to learn the cutoffs, of which only the counts are written
    down, and once more to apply them, so they are neither shuffled nor copied.
    """
    measured = stage(measure(df.select(id_col, lang_col, text_col), text_col).drop(text_col), "measured")
    names, cutoffs = learn(measured, labels, id_col, lang_col)
    judged = judge(with_stratum(measure(df, text_col), names, lang_col), cutoffs)
    # one test that needs the cutoffs: a part of it on the counts alone would be pushed
    # below the measuring, with every expression in it computed anew
    reasons = F.array_compact(F.concat("rejected_by", F.array(F.when(F.col("base_failed"), F.lit("base")))))
    return judged.filter(F.size(reasons) == 0)
