"""The experiment matrix: conditions, pending runs, recall, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import settings
from quillspark.operators.analytics import condition_name
from quillspark.schemas import LANGUAGES

KEY = ["experiment_id", "question_id", "language", "mitigation_enabled"]
# Parts of an error message that make a retry worthwhile.
TRANSIENT = ("rate limit", "ratelimit", "rate_limit", "too many requests", "429", "connection", "timeout", "503", "502")


def configs(spark: SparkSession) -> DataFrame:
    """The six conditions with the settings they run under."""
    s = settings(spark)
    rows = [(language, mitigated, s.embedding_model, s.generator_model, s.judge_model, s.top_k, s.hallucination_threshold) for language in LANGUAGES for mitigated in (False, True)]
    df = spark.createDataFrame(rows, "language string, mitigation_enabled boolean, embedding_model string, generator_model string, judge_model string, top_k int, hallucination_threshold double")
    return df.withColumn("experiment_id", condition_name(F.col("language"), F.col("mitigation_enabled")))


def language_variants(queries: DataFrame) -> DataFrame:
    """One row per question and language with that variant's text."""
    return queries.unpivot("question_id", list(LANGUAGES), "language", "query")


def experiment_matrix(queries: DataFrame, languages: list[str] | None = None, mitigation: bool | None = None) -> DataFrame:
    """Every question under every condition asked for; repeated questions count once.

    The six conditions are spread over each question's variants in place: no join, no shuffle but the one that drops
    repeats.
    """
    sides = [False, True] if mitigation is None else [mitigation]
    wanted = [x for x in LANGUAGES if languages is None or x in languages]
    cells = [F.struct(F.lit(x).alias("language"), F.lit(side).alias("mitigation_enabled"), F.col(x).alias("query")) for x in wanted for side in sides]
    rows = queries.groupBy("question_id").agg(*(F.min(x).alias(x) for x in LANGUAGES)).select("question_id", F.explode(F.array(*cells)).alias("c")).select("question_id", "c.*")
    return rows.select(condition_name(F.col("language"), F.col("mitigation_enabled")).alias("experiment_id"), "question_id", "language", "mitigation_enabled", "query")


def completed_keys(results: DataFrame, retry_unjudged: bool = False) -> DataFrame:
    """Keys of runs that ended without an error; a run without a judge's score counts as completed unless ``retry_unjudged``."""
    done = results.filter("error is null and completed_at is not null")
    return (done.filter("faithfulness_score is not null") if retry_unjudged else done).select(*KEY).distinct()


def resume_pending(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """The cells of the matrix that have no completed run."""
    done = completed_keys(results)
    return matrix.join(done, KEY, "left_anti")


def dry_run_summary(matrix: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Per experiment: cells, pending, skipped; without stored results every cell is pending."""
    done = matrix.select(*KEY).limit(0) if results is None else completed_keys(results)
    flagged = matrix.join(done.withColumn("done", F.lit(True)), KEY, "left")
    return flagged.groupBy("experiment_id").agg(F.count("*").alias("total"), F.count_if(F.col("done").isNull()).alias("pending"), F.count_if(F.col("done")).alias("skipped"))


def success_at(retrieved: Column, expected: Column, k: int) -> Column:
    """1.0 if one of the first k retrieved ids begins with an expected one or the other way round, else 0.0; 0.0 without expectations."""
    first = F.slice(F.coalesce(retrieved, F.array().cast("array<string>")), 1, k)
    return F.when(F.exists(first, lambda r: F.exists(F.coalesce(expected, F.array().cast("array<string>")), lambda e: r.startswith(e) | e.startswith(r))), 1.0).otherwise(0.0)


def recall_at_k(results: DataFrame) -> DataFrame:
    """id and recall at 1, 3 and 5 recomputed from the stored lists; null for failed runs."""
    ok = F.col("error").isNull()
    return results.select("id", *(F.when(ok, success_at(F.col("retrieved_document_ids"), F.col("expected_document_ids"), k)).alias(f"recall_at_{k}") for k in (1, 3, 5)))


def transient_errors(results: DataFrame) -> DataFrame:
    """Failed runs with whether a retry may help."""
    return results.filter("error is not null").select("id", F.lower("error").rlike("|".join(TRANSIENT)).alias("transient"))


def run_summary(results: DataFrame) -> DataFrame:
    """Per experiment: runs, completed, failed, mean score, hallucinations."""
    s = F.when(~F.isnan("faithfulness_score"), F.col("faithfulness_score"))
    return results.groupBy("experiment_id").agg(
        F.count("*").alias("executed"), F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.round(F.avg(s), 4).alias("mean_score"), F.count_if(F.col("hallucination_flag")).alias("hallucinations"),
    )


def latest_runs(results: DataFrame) -> DataFrame:
    """One row per run_id, the first stored (least id): a stored run may be repeated under another id.

    Only keys and ids meet in the group-by; rows are found again by their unique id.
    """
    first = results.groupBy("run_id").agg(F.min("id").alias("id")).select("id")
    return results.join(first, "id", "left_semi")


def insert_or_ignore(new: DataFrame, stored: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of ``new``, one a key, whose key is not stored yet, in the stored columns: unknown ones dropped, missing ones null."""
    fresh = new.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")
    return stored.limit(0).unionByName(fresh.select(*[c for c in stored.columns if c in fresh.columns]), allowMissingColumns=True)
