"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.chunking import chunk_documents
from quillspark.sources.files import documents, load_files

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks of the files that arrived in ``folder`` since the last call, appended to ``out``; stops when all are read."""
    name = F.element_at(F.split("path", "/"), -1)
    stream = spark.readStream.format("binaryFile").schema(_FILE).load(folder)
    files = stream.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), "content")
    chunks = chunk_documents(documents(load_files(files)))
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def windowed_runs(results: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Runs, failures and mean score by condition and window of their start; later rows than the watermark are dropped when streamed."""
    s = F.when(~F.isnan("faithfulness_score"), F.col("faithfulness_score"))
    return results.withWatermark("started_at", late).groupBy(F.window("started_at", width), "language", "mitigation_enabled").agg(F.count("*").alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.avg(s).alias("mean_score")).select(
        F.col("window.start").alias("window_start"), "language", "mitigation_enabled", "runs", "failed", F.round("mean_score", 4).alias("mean_score")
    )


def append_new_runs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs appended once each: a batch skips the run ids already stored, so a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["run_id"])
        try:
            fresh = fresh.join(spark.read.parquet(path).select("run_id"), "run_id", "left_anti").select(*batch.columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
