"""Command line: ingest, index, search, manifest, validate, experiment, analyze, export.

python -m quillspark.jobs ingest FOLDER OUT [--size N --overlap N]
python -m quillspark.jobs index CHUNKS OUT
python -m quillspark.jobs search INDEX QUESTION [-k N]
python -m quillspark.jobs manifest FOLDER CHUNKS INDEX MANIFEST
python -m quillspark.jobs validate QUERIES INDEX [--chunks CHUNKS] [--manifest MANIFEST] [--report REPORT]
python -m quillspark.jobs experiment QUERIES INDEX RESULTS [--language L] [--mitigation on|off] [--dry-run] [--protect NAME] [--skip-preflight]
python -m quillspark.jobs analyze RESULTS OUT [--experiment-id ID] [--mock-data]
python -m quillspark.jobs export RESULTS OUT [--format csv|json] [--experiment-id ID] [--limit N]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.config import settings
from quillspark.functions.stats import benjamini_hochberg
from quillspark.operators import analytics, chunking, detection, experiment, gates, quality
from quillspark.plans import rag
from quillspark.schemas import LANGUAGES
from quillspark.sources import datasets, files
from quillspark.tables import cut


def ingest(spark: SparkSession, folder: str, out: str, size: int, overlap: int) -> DataFrame:
    """Documents, failures and chunks of a folder below ``out``; the corpus statistics."""
    loaded = cut(files.load_files(files.scan_documents(spark, folder)))
    docs = files.documents(loaded)
    sinks.write_jsonl(docs, f"{out}/documents")
    sinks.write_jsonl(files.ingest_failures(loaded), f"{out}/failures")
    sinks.write_jsonl(chunking.chunk_documents(docs, size, overlap), f"{out}/chunks")
    chunks = datasets.read_chunks(spark, f"{out}/chunks")
    gates.processed_gates(docs, chunks).show(truncate=False)
    return quality.dataset_stats(docs, chunks)


def run_experiment(spark: SparkSession, queries: DataFrame, index: DataFrame, results: str, languages: list[str] | None, mitigation: bool | None) -> DataFrame:
    """Runs the cells without a completed run and appends them; their summary."""
    stored = spark.read.parquet(results) if datasets._exists(spark, results) else None
    matrix = experiment.experiment_matrix(queries, languages, mitigation)
    pending = matrix if stored is None else experiment.resume_pending(matrix, stored)
    pending = pending.withColumn("query_id", F.concat_ws("|", *experiment.KEY))
    on = F.element_at(F.split("query_id", r"\|"), -1) == "true"
    answers = rag.answer(pending, index, mitigation=on, options=settings(spark), normalizer=detection.content_words)
    expected = queries.groupBy("question_id").agg(F.min("expected_document_ids").alias("expected_document_ids"))
    rows = pending.join(answers.drop("query"), "query_id").withColumnRenamed("query", "original_query").join(expected, "question_id", "left")
    rows = rows.select("*", *(experiment.success_at(F.col("retrieved_document_ids"), F.col("expected_document_ids"), k).alias(f"recall_at_{k}") for k in (1, 3, 5)))
    ended = F.current_timestamp()
    rows = cut(rows.withColumn("run_id", F.sha2(F.col("query_id"), 256)).withColumn("id", F.xxhash64("query_id")).withColumn("started_at", ended - F.make_dt_interval(secs=F.coalesce("latency", F.lit(0.0)).cast("decimal(18,6)"))).withColumn("completed_at", ended).drop("query_id"))
    sinks.append(rows, results)
    return experiment.run_summary(rows)


def analyze(results: DataFrame, out: str, experiment_id: str | None = None, mock: bool = False) -> list[str]:
    """The analysis of stored runs as files below ``out``."""
    if experiment_id:
        results = results.filter(F.col("experiment_id") == experiment_id)
    valid = cut(analytics.valid_records(results))
    stats = analytics.condition_stats(valid)
    scores = cut(analytics.last_scores(valid))
    tables = {
        "condition_summary": stats, "paired_comparisons": benjamini_hochberg(analytics.paired_comparisons(analytics.paired_diffs(scores))), "success_criterion": analytics.success_criterion(stats),
        "recall_summary": analytics.recall_stats(valid), "exclusion_reasons": analytics.exclusion_reasons(results), "overview": analytics.dashboard_overview(valid),
    }
    sinks.export_csv(analytics.validate_records(results).filter("exclusion_reason is not null"), f"{out}/excluded_records")
    sinks.export_csv(analytics.missing_pairs(scores), f"{out}/missing_pairs")
    chart = analytics.chart_data(stats).first()
    sinks.write_text(results.sparkSession, f"{out}/chart_data.json", json.dumps({"mean": chart["mean"], "hallucination_rate": chart["hallucination_rate"]}, indent=2))
    return sinks.write_report(results.sparkSession, tables, out, {"classification": analytics.data_classification(results, mock).first().classification})


def main(argv: list[str] | None = None) -> None:
    """Parses the command line and runs one job."""
    parser = argparse.ArgumentParser(prog="quillspark")
    sub = parser.add_subparsers(dest="job", required=True)
    for name, *places in (("ingest", "folder", "out"), ("index", "chunks", "out"), ("search", "index", "question"), ("manifest", "folder", "chunks", "index", "manifest"), ("validate", "queries", "index"), ("experiment", "queries", "index", "results"), ("analyze", "results", "out"), ("export", "results", "out")):
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place)
    sub.choices["ingest"].add_argument("--size", type=int, default=500)
    sub.choices["ingest"].add_argument("--overlap", type=int, default=100)
    sub.choices["search"].add_argument("-k", type=int, default=5)
    sub.choices["experiment"].add_argument("--language", choices=LANGUAGES, action="append")
    sub.choices["experiment"].add_argument("--mitigation", choices=("on", "off"))
    sub.choices["experiment"].add_argument("--dry-run", action="store_true")
    sub.choices["experiment"].add_argument("--protect", action="append", default=[])
    sub.choices["experiment"].add_argument("--skip-preflight", action="store_true")
    for name in ("chunks", "manifest", "report"):
        sub.choices["validate"].add_argument(f"--{name}")
    sub.choices["analyze"].add_argument("--experiment-id")
    sub.choices["analyze"].add_argument("--mock-data", action="store_true")
    sub.choices["export"].add_argument("--experiment-id")
    sub.choices["export"].add_argument("--format", choices=("csv", "json"), default="csv")
    sub.choices["export"].add_argument("--limit", type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if a.job == "ingest":
        ingest(spark, a.folder, a.out, a.size, a.overlap).show(truncate=False)
    elif a.job == "index":
        sinks.write_index(rag.build_index(datasets.read_chunks(spark, a.chunks), settings(spark).embedding_dim), a.out)
    elif a.job == "search":
        asked = spark.createDataFrame([("q", a.question)], "query_id string, query string")
        hits = rag.retrieve(asked, datasets.load_index(spark, a.index), "query_id", "query", a.k)
        hits.select(F.explode("hits").alias("h")).select("h.rank", "h.score", "h.chunk_id", "h.text").orderBy("rank").show(truncate=120)
    elif a.job == "validate":
        index = datasets.load_index(spark, a.index)
        found = quality.preflight_violations(datasets.load_queries(spark, a.queries), index)
        if a.manifest:
            parts = {"index": a.index} | ({"chunks": a.chunks} if a.chunks else {})
            found = gates.file_preflight(spark, a.queries, a.manifest, parts).unionByName(found)
        found = cut(found)
        found.show(100, truncate=False)
        checks = found.groupBy(F.col("check").alias("gate")).agg(F.lit("FAIL").alias("status"), F.count("*").cast("string").alias("finding"))
        if a.chunks:
            checks = checks.unionByName(gates.corpus_gates(datasets.read_chunks(spark, a.chunks), index))
        checks = cut(checks)
        if a.report:
            gates.write_preflight_report(checks, a.report)
        if gates.verdict(checks).first().verdict != "PASS":
            raise SystemExit(1)
    elif a.job == "manifest":
        print(gates.write_manifest(spark, a.folder, {"chunks": a.chunks, "index": a.index}, a.manifest)["corpus_hash"])
    elif a.job == "export":
        rows = datasets.scan_results(spark.read.parquet(a.results), a.experiment_id)
        rows = rows if a.limit is None else rows.limit(a.limit)
        sinks.export_csv(rows, a.out) if a.format == "csv" else sinks.export_json_lines(rows, a.out)
    elif a.job == "experiment":
        gates.guard_target(a.results, tuple(a.protect))
        queries, index = datasets.load_queries(spark, a.queries), datasets.load_index(spark, a.index)
        side = None if a.mitigation is None else a.mitigation == "on"
        if a.dry_run:
            stored = spark.read.parquet(a.results) if datasets._exists(spark, a.results) else None
            experiment.dry_run_summary(experiment.experiment_matrix(queries, a.language, side), stored).orderBy("experiment_id").show(truncate=False)
        elif not a.skip_preflight and not quality.preflight_violations(queries, index).isEmpty():
            raise SystemExit("the query dataset has violations: run validate, or skip with --skip-preflight")
        else:
            run_experiment(spark, queries, index, a.results, a.language, side).orderBy("experiment_id").show(truncate=False)
    else:
        print("\n".join(analyze(spark.read.parquet(a.results), a.out, a.experiment_id, a.mock_data)))


if __name__ == "__main__":
    main()
