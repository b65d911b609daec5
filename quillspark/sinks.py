"""Exports. Tables are written by Spark; reports of a few rows by the driver, through Hadoop's file systems like the tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a report may hold.
REPORT_ROWS = 10_000


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at any path that Spark can write to, replaced as a whole: written beside it, then renamed."""
    fs, p = _file(spark, path)
    _, beside = _file(spark, f"{path}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def few_rows(df: DataFrame, most: int = REPORT_ROWS) -> pd.DataFrame:
    """The rows of a table that must be small; more than ``most`` raise."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows don't belong in a report")
    return rows


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str) -> None:
    """A vector index with its metadata; an empty one raises."""
    if df.isEmpty():
        raise ValueError("an empty index can't be saved")
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to a stored table."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; lists and maps as JSON; blanks at the ends stay; an empty table writes nothing."""
    if df.isEmpty():
        return
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_json(df: DataFrame, path: str) -> None:
    """A table of a few rows as one JSON array in one file, nulls kept."""
    rows = few_rows(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")))["j"]
    write_text(df.sparkSession, path, json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False))


def export_json_lines(df: DataFrame, path: str) -> None:
    """A table of any size as JSON lines with nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_table(rows: pd.DataFrame) -> list[str]:
    """The lines of a table in Markdown."""
    return ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows.itertuples(index=False))]


def write_report(spark: SparkSession, tables: dict[str, DataFrame], folder: str, summary: dict | None = None, title: str = "Analysis") -> list[str]:
    """A CSV for each non-empty table, analysis_summary.json and report.md below ``folder``; only for tables of a few rows."""
    done, everything, lines = [], dict(summary or {}), [f"# {title}"]
    for name, df in tables.items():
        rows = few_rows(df)
        everything[name] = json.loads(rows.to_json(orient="records"))
        lines += ["", f"## {name}", "", *markdown_table(rows)]
        if len(rows):
            write_text(spark, f"{folder}/{name}.csv", rows.to_csv(index=False))
            done.append(f"{name}.csv")
    write_text(spark, f"{folder}/analysis_summary.json", json.dumps(everything, indent=2, ensure_ascii=False))
    write_text(spark, f"{folder}/report.md", "\n".join(lines) + "\n")
    return [*done, "analysis_summary.json", "report.md"]
