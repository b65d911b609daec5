"""Query datasets, JSON lines, vector indexes and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import id_list, stripped
from quillspark.schemas import CHUNK, DOCUMENT, QUERY_RECORD


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Documents or chunks from JSON lines; a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines."""
    return read_jsonl(spark, path, CHUNK)


def _first_mark(spark: SparkSession, path: str) -> str:
    """The first character of a file that is no blank; '' for a folder or an empty file.  Only the file's head is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return ""
    stream = fs.open(p)
    try:
        head = bytes(stream.readNBytes(4096))
    finally:
        stream.close()
    return head.decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")[:1]


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query records from .csv, .json or .jsonl; a missing file, other types and records that can't be read raise.

    JSON whose first character opens an array is read as a whole, anything else as lines, whatever the extension: every
    line is a record.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        names = [c.strip().split(" ")[0] for c in QUERY_RECORD.replace("array<string>", "array").split(",")]
        known = {c: F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in names}
        return raw.select(*((id_list(known[c]) if c == "expected_document_ids" else known[c]).alias(c) for c in names))
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(QUERY_RECORD).option("mode", "FAILFAST").json(path, multiLine=_first_mark(spark, path) == "[")
    raise ValueError(f"unsupported dataset: {path}")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored vector index; a missing one raises."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet from CSV with header, quoted line breaks kept; all columns are strings, empty cells ''."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.na.fill("")


def scan_results(results: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Stored runs: those of one experiment, else all in the order of experiment, question and id.

    Retrieved ids stored as JSON text are decoded; nulls and what can't be decoded give an empty list.
    """
    ids = F.col("retrieved_document_ids")
    if results.schema["retrieved_document_ids"].dataType.typeName() == "string":
        ids = F.from_json(ids, "array<string>")
    rows = results.withColumn("retrieved_document_ids", F.coalesce(ids, F.array().cast("array<string>")))
    return rows.orderBy("experiment_id", "question_id", "id") if experiment_id is None else rows.filter(F.col("experiment_id") == experiment_id)


def validate_queries(queries: DataFrame) -> DataFrame:
    """question_id and the variant that is blank."""
    variants = queries.unpivot("question_id", ["english", "tamil_english", "hindi_english"], "variant", "text")
    return variants.filter(F.col("text").isNull() | (stripped(F.col("text")) == "")).select("question_id", "variant")


def index_ids(metadata: DataFrame) -> DataFrame:
    """Distinct document and chunk ids of an index's metadata."""
    return metadata.select(F.explode(F.array("document_id", "chunk_id")).alias("id")).filter("id is not null").distinct()
