"""Validation, description and comparison of experiment results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import EXACT_UP_TO, wilcoxon_p
from quillspark.schemas import CONDITIONS, LANGUAGES

# The planned comparisons, in this direction: first minus second.
COMPARISONS = (
    ("english_baseline", "tamil_english_baseline"),
    ("english_baseline", "hindi_english_baseline"),
    ("tamil_english_baseline", "tamil_english_mitigated"),
    ("hindi_english_baseline", "hindi_english_mitigated"),
    ("tamil_english_mitigated", "english_baseline"),
    ("hindi_english_mitigated", "english_baseline"),
)
_MIXES = LANGUAGES[1:]
#: Ranges of values within which counts are accumulated, so that no group's values are ordered in one task.
RANGES = 1024
#: Greatest loss against the English baseline that a mitigated condition may show.
GAP = 0.10
ALPHA = 0.05


def condition_name(language: Column, mitigated: Column) -> Column:
    """``language_mitigated`` or ``language_baseline``."""
    return F.concat_ws("_", language, F.when(mitigated, "mitigated").otherwise("baseline"))


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def validate_records(results: DataFrame, seq: str = "id") -> DataFrame:
    """Adds ``exclusion_reason`` (null: valid) and ``condition``.

    The first missing field names the reason.  Of the complete records of one (experiment, question, language,
    mitigation), the first by ``seq`` holds the key, even if its score is out of bounds, and all later ones are
    duplicates, whatever their score; ``seq`` is unique.  NaN is within bounds.  A missing experiment counts as 'unknown'.
    """
    # The reasons, in the order in which they are looked for.
    gap = F.coalesce(*(F.when(test, F.lit(f"missing {what}")) for what, test in (
        ("question_id", _missing("question_id")), ("language", _missing("language")), ("mitigation condition", F.col("mitigation_enabled").isNull()),
        ("faithfulness score", F.col("faithfulness_score").isNull()), ("hallucination flag", F.col("hallucination_flag").isNull()),
        ("answer", _missing("generated_answer")), ("retrieved context", _missing("retrieved_context")),
    )))
    experiment = F.when(_missing("experiment_id"), "unknown").otherwise(F.col("experiment_id"))
    rows = results.withColumn("experiment_id", experiment).withColumn("_gap", gap)
    # The first of each key comes from a group-by that combines before it shuffles; rows meet it again by their unique
    # ``seq``, so a key that holds a third of all rows never comes to one task.
    key = ["experiment_id", "question_id", "language", "mitigation_enabled"]
    first = rows.filter("_gap is null").groupBy(*key).agg(F.min(seq).alias(seq)).select(seq, F.lit(True).alias("_first"))
    rows = rows.join(first, seq, "left")
    score = F.col("faithfulness_score")
    reason = F.coalesce("_gap", F.when(F.col("_first").isNull(), "duplicate record"), F.when(~F.isnan(score) & ((score < 0) | (score > 1)), "invalid faithfulness score outside [0.0, 1.0]"))
    return rows.withColumn("exclusion_reason", reason).drop("_gap", "_first").withColumn("condition", condition_name(F.col("language"), F.col("mitigation_enabled")))


def valid_records(results: DataFrame, seq: str = "id") -> DataFrame:
    """The records without a reason for exclusion."""
    return validate_records(results, seq).filter("exclusion_reason is null")


def exclusion_reasons(results: DataFrame) -> DataFrame:
    """Records by reason; 'valid' for those kept."""
    return validate_records(results).groupBy(F.coalesce("exclusion_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def _conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CONDITIONS], "condition string")


def counts_before(counted: DataFrame, group: list[str], value: str, width: float) -> DataFrame:
    """Adds ``before`` to rows (group, value, t), one a distinct value: how many rows of the group have a lesser value.

    Counts are added up over ranges of values, then within each range: a group that holds all rows, of however many
    distinct values, is spread over its ranges.
    """
    ranged = counted.withColumn("_range", F.floor(F.col(value) * (RANGES / width)).cast("bigint"))
    until = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy(*group, "_range").agg(F.sum("t").alias("t")).withColumn("_start", until(Window.partitionBy(*group).orderBy("_range"))).drop("t")
    inside = ranged.withColumn("_inside", until(Window.partitionBy(*group, "_range").orderBy(value)))
    return inside.join(starts, [*group, "_range"]).withColumn("before", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def medians(counted: DataFrame, group: list[str], value: str, width: float) -> DataFrame:
    """(group, median) of rows (group, value, t), one a distinct value with its count."""
    totals = counted.groupBy(*group).agg(F.sum("t").alias("_all"))
    covers = lambda at: F.max(F.when((F.col("before") <= at) & (F.col("before") + F.col("t") > at), F.col(value)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return counts_before(counted, group, value, width).join(totals, group).groupBy(*group).agg(((covers(low) + covers(high)) / 2).alias("median"))


def condition_stats(valid: DataFrame) -> DataFrame:
    """Description of each of the six conditions; empty ones have n 0 and nulls.  NaN scores don't count.

    Records are counted by distinct score first, by a group-by that combines before it shuffles; all else comes from
    the counts.
    """
    score = F.when(~F.isnan("faithfulness_score"), F.col("faithfulness_score"))
    counted = valid.select("condition", score.alias("s"), "hallucination_flag").filter("s is not null").groupBy("condition", "s").agg(F.count("*").alias("t"), F.count_if("hallucination_flag").alias("flagged"), F.count("hallucination_flag").alias("judged"))
    n, s, t = F.sum("t"), F.col("s"), F.col("t")
    spread = F.sum(s * s * t) - F.sum(s * t) * F.sum(s * t) / n
    seen = counted.groupBy("condition").agg(
        n.alias("n"), F.round(F.sum(s * t) / n, 4).alias("mean"), F.round(F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.when(n > 1, n - 1))).otherwise(0.0), 4).alias("std"),
        F.round(F.try_divide(F.sum("flagged"), F.sum("judged")), 4).alias("hallucination_rate"), F.min("s").alias("min"), F.max("s").alias("max"),
    )
    middle = medians(counted, ["condition"], "s", 1.0).select("condition", F.round("median", 4).alias("median"))
    return _conditions(valid.sparkSession).join(seen, "condition", "left").join(middle, "condition", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("condition", "n", "mean", "median", "std", "hallucination_rate", "min", "max")


def recall_stats(valid: DataFrame) -> DataFrame:
    """Mean recall at 1, 3 and 5 of each condition over the records that have it."""
    seen = valid.groupBy("condition").agg(*(F.round(F.avg(f"recall_at_{k}"), 4).alias(f"mean_recall_at_{k}") for k in (1, 3, 5)), F.count("recall_at_1").alias("n_with_recall"))
    return _conditions(valid.sparkSession).join(seen, "condition", "left").withColumn("n_with_recall", F.coalesce("n_with_recall", F.lit(0)))


def last_scores(valid: DataFrame, seq: str = "id") -> DataFrame:
    """One score per (question, condition): of the last record by ``seq``; NaN scores can't be compared."""
    return valid.filter(~F.isnan("faithfulness_score")).groupBy("question_id", "condition").agg(F.max_by("faithfulness_score", seq).alias("score"))


def paired_scores(scores: DataFrame) -> DataFrame:
    """question_id, cond1, cond2, score1, score2 for each comparison that has a side; a missing side is null.

    One pass: scores are pivoted by question and each row is spread over the six comparisons.
    """
    wide = scores.groupBy("question_id").pivot("condition", list(CONDITIONS)).agg(F.first("score"))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("cond1"), F.lit(b).alias("cond2"), F.col(a).alias("score1"), F.col(b).alias("score2")) for a, b in COMPARISONS)))
    return wide.select("question_id", rows.alias("x")).select("question_id", "x.*").filter("score1 is not null or score2 is not null")


def paired_diffs(scores: DataFrame) -> DataFrame:
    """The questions that both conditions of a comparison have, with the difference."""
    return paired_scores(scores).filter("score1 is not null and score2 is not null").withColumn("diff", F.col("score1") - F.col("score2"))


def missing_pairs(scores: DataFrame) -> DataFrame:
    """The questions that only one condition of a comparison has, and which is missing."""
    return paired_scores(scores).filter("score1 is null or score2 is null").select("question_id", "cond1", "cond2", F.when(F.col("score1").isNull(), "missing_cond1").otherwise("missing_cond2").alias("missing"))


def rank_sums(diffs: DataFrame) -> DataFrame:
    """Per comparison: n_nonzero, w_plus, w_minus and the tie term of the signed ranks of the non-zero differences.

    Ranks come from counts per size of difference, added up over ranges of sizes: no comparison is sorted in one task.
    Sizes are rounded to 1e-9, under which differences of decimal scores are equal.
    """
    size = F.round(F.abs("diff"), 9)
    counted = diffs.withColumn("size", size).filter("size > 0").groupBy("cond1", "cond2", "size").agg(F.count_if(F.col("diff") > 0).alias("up"), F.count("*").alias("t"))
    ranked = counts_before(counted, ["cond1", "cond2"], "size", 1.0).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    return ranked.groupBy("cond1", "cond2").agg(
        F.sum("t").alias("n_nonzero"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"),
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie_term"),
    )


def paired_comparisons(diffs: DataFrame) -> DataFrame:
    """One row per planned comparison: n, mean and median difference, statistic, p_value, significant, status."""
    spark = diffs.sparkSession
    planned = spark.createDataFrame([*COMPARISONS], "cond1 string, cond2 string")
    pair = ["cond1", "cond2"]
    described = diffs.groupBy(*pair).agg(F.count("*").alias("n"), F.round(F.avg("diff"), 4).alias("mean_diff"), F.count_if(F.col("diff") != 0).alias("n_changed"))
    middle = medians(diffs.groupBy(*pair, "diff").agg(F.count("*").alias("t")), pair, "diff", 2.0).select(*pair, F.round("median", 4).alias("median_diff"))
    rows = planned.join(described, pair, "left").join(middle, pair, "left").join(rank_sums(diffs), pair, "left")

    @F.pandas_udf("double")
    def p_of(w: pd.Series, n: pd.Series, ties: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else wilcoxon_p(a, int(b), c, c == 0 and b == d and b <= EXACT_UP_TO) for a, b, c, d in zip(w, n, ties, total, strict=True)])

    n = F.coalesce("n", F.lit(0))
    tested = (n >= 2) & (F.col("n_changed") > 0)
    w = F.when(tested, F.least("w_plus", "w_minus"))
    p = F.when(tested, p_of(w, F.col("n_nonzero"), F.col("tie_term"), n))
    return rows.select(
        "cond1", "cond2", n.alias("n"), F.when(n >= 2, F.col("mean_diff")).alias("mean_diff"), F.when(n >= 2, F.col("median_diff")).alias("median_diff"),
        w.alias("statistic"), F.round(p, 6).alias("p_value"), (p < ALPHA).alias("significant"),
        F.when(n < 2, "INSUFFICIENT DATA").when(F.col("n_changed") == 0, "NOT TESTABLE").otherwise("TESTED").alias("status"),
    )


def success_criterion(stats: DataFrame) -> DataFrame:
    """Does each mitigated mix come within ``GAP`` of the English baseline?  Rounded means, unrounded double difference."""
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("mean")))
    mixes = [f"{x}_mitigated" for x in _MIXES]
    row = stats.agg(of("english_baseline").alias("english_mean"), *(of(m).alias(m) for m in mixes))
    rows = row.select("english_mean", F.explode(F.array(*(F.struct(F.lit(m).alias("condition"), F.col(m).alias("mean")) for m in mixes))).alias("x")).select("x.condition", "english_mean", "x.mean")
    gap = F.col("english_mean") - F.col("mean")
    return rows.select("condition", "english_mean", "mean", gap.alias("difference"), F.when(gap.isNull(), "INSUFFICIENT DATA").when(gap <= GAP, "MET").otherwise("NOT MET").alias("status"))


def dashboard_overview(valid: DataFrame) -> DataFrame:
    """Questions, records, mean score and hallucination rate of the valid records; status 'empty' if there are none."""
    score = F.when(~F.isnan("faithfulness_score"), F.col("faithfulness_score"))
    return valid.agg(
        F.countDistinct("question_id").alias("questions"), F.count("*").alias("records"), F.coalesce(F.round(F.avg(score), 4), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.round(F.avg(F.col("hallucination_flag").cast("int")), 4), F.lit(0.0)).alias("hallucination_rate"), F.when(F.count("*") == 0, "empty").otherwise("ok").alias("status"),
    )


def dashboard_filter(valid: DataFrame, language: str | None = None, mitigation: bool | None = None, hallucination: bool | None = None) -> DataFrame:
    """Valid records that match every filter given."""
    for column, value in (("language", language), ("mitigation_enabled", mitigation), ("hallucination_flag", hallucination)):
        if value is not None:
            valid = valid.filter(F.col(column) == value)
    return valid


def chart_data(stats: DataFrame) -> DataFrame:
    """One row of maps from condition to mean and to hallucination rate, 0 where there is none."""
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("condition", F.coalesce(c, F.lit(0.0))))))
    return stats.agg(entry("mean").alias("mean"), entry("hallucination_rate").alias("hallucination_rate"))


def data_classification(results: DataFrame, declared_mock: bool = False) -> DataFrame:
    """'MOCK/TEST' if some record comes from a smoke or test run or the caller says so, else 'ACTUAL'."""
    mock = F.coalesce(F.col("question_id").contains("SMOKE"), F.lit(False)) | F.coalesce(F.col("experiment_id").contains("test"), F.lit(False))
    return results.agg(F.when(F.coalesce(F.bool_or(mock), F.lit(False)) | F.lit(declared_mock), "MOCK/TEST").otherwise("ACTUAL").alias("classification"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Count, mean, extremes and sum of the scores, NaN left out."""
    s = F.when(~F.isnan("faithfulness_score"), F.col("faithfulness_score"))
    return results.agg(F.count(s).alias("n"), F.round(F.avg(s), 4).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.round(F.sum(s), 2).alias("total"))


def reciprocal_ranks(results: DataFrame) -> DataFrame:
    """Mean reciprocal rank of the first expected document per language (an extension)."""
    hit = F.array_position(F.transform("retrieved_document_ids", lambda r: F.exists("expected_document_ids", lambda e: r.startswith(e) | e.startswith(r))), F.lit(True))
    return results.filter(F.col("retrieved_document_ids").isNotNull()).groupBy("language").agg(F.round(F.avg(F.coalesce(F.when(hit > 0, 1 / hit), F.lit(0.0))), 4).alias("mrr"), F.count("*").alias("n"))
