"""Gates before a run: files against their manifest, sizes of corpus and index, empties; a verdict and a report of all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank
from quillspark.operators.quality import corpus_manifest, preflight_violations, review_incomplete
from quillspark.sinks import few_rows, markdown_table, read_text, write_text

_FINDING = "gate string, status string, finding string"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """filename, sha256, size_bytes of the visible files of a folder, hashed where they lie; of one file, its own."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.rlike("^[._]")).select(name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def content_hash(spark: SparkSession, path: str) -> str | None:
    """One hash for a table's or folder's files, in order of names; None where there are none."""
    try:
        files = file_hashes(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    row = corpus_manifest(files).first()
    return row.corpus_hash if row.num_source_documents else None


def write_manifest(spark: SparkSession, documents: str, parts: dict[str, str], path: str) -> dict:
    """Hashes of the source folder's files and of each part of the corpus (name: path), as a JSON manifest at ``path``."""
    row = corpus_manifest(file_hashes(spark, documents)).first()
    made = {"corpus_hash": row.corpus_hash, "num_source_documents": row.num_source_documents, "source_documents": [f.asDict() for f in row.source_documents]}
    made["parts"] = {name: content_hash(spark, place) for name, place in parts.items()}
    write_text(spark, path, json.dumps(made, indent=2))
    return made


def file_preflight(spark: SparkSession, dataset: str, manifest: str, parts: dict[str, str]) -> DataFrame:
    """(check, key): what is wrong with the files of a run.

    A missing dataset, and a missing or unreadable manifest, end the checks; else every part that is missing or differs
    from its recorded hash is listed.
    """
    found: list[tuple[str, str]] = []
    if content_hash(spark, dataset) is None:
        found.append(("dataset missing", dataset))
    elif (text := read_text(spark, manifest)) is None:
        found.append(("manifest missing", manifest))
    else:
        try:
            recorded = json.loads(text)
        except ValueError:
            recorded = None
        if not isinstance(recorded, dict):
            found.append(("manifest unreadable", manifest))
        else:
            if not recorded.get("corpus_hash"):
                found.append(("manifest without corpus_hash", manifest))
            for name, place in sorted(parts.items()):
                now, then = content_hash(spark, place), recorded.get("parts", {}).get(name)
                if now is None:
                    found.append(("part missing", name))
                elif then and now != then:
                    found.append(("part differs from manifest", name))
    return spark.createDataFrame(found, "check string, key string")


def _gate(df: DataFrame, name: str, bad: Column, finding: Column, status: str = "FAIL") -> DataFrame:
    return df.select(F.lit(name).alias("gate"), F.when(bad, status).otherwise("PASS").alias("status"), finding.alias("finding"))


def corpus_gates(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(gate, status, finding): are there empty chunks, and has the index as many distinct chunks as the corpus?"""
    c = chunks.agg(F.countDistinct("chunk_id").alias("chunks"), F.count_if(is_blank(F.col("chunk_text"))).alias("empty"))
    i = index.agg(F.countDistinct("chunk_id").alias("indexed"))
    one = c.unionByName(i, allowMissingColumns=True).agg(*(F.first(x, ignorenulls=True).alias(x) for x in ("chunks", "empty", "indexed")))
    empties = _gate(one, "empty chunks", F.col("empty") > 0, F.concat("empty", F.lit(" of "), "chunks"))
    sizes = _gate(one, "index size", F.col("chunks") != F.col("indexed"), F.concat(F.lit("chunks "), "chunks", F.lit(", indexed "), "indexed"))
    return empties.unionByName(sizes)


def processed_gates(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(gate, status, finding): documents and chunks without text, and a corpus without any."""
    d = _gate(docs.agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("text"))).alias("e")), "documents", (F.col("n") == 0) | (F.col("e") > 0), F.concat("e", F.lit(" empty of "), "n"))
    c = _gate(chunks.agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("chunk_text"))).alias("e")), "chunks", (F.col("n") == 0) | (F.col("e") > 0), F.concat("e", F.lit(" empty of "), "n"))
    return d.unionByName(c)


def production_gates(queries: DataFrame, chunks: DataFrame, index: DataFrame, sheet: DataFrame) -> DataFrame:
    """(gate, status, finding) of corpus, dataset and review; an unfinished review blocks, all else fails."""
    asked = _gate(preflight_violations(queries, index).agg(F.count("*").alias("n")), "dataset", F.col("n") > 0, F.concat("n", F.lit(" violations")))
    review = _gate(review_incomplete(sheet).agg(F.count("*").alias("n")), "review", F.col("n") > 0, F.concat("n", F.lit(" rows incomplete")), "BLOCKED")
    cells = _gate(queries.agg((6 * F.countDistinct("question_id")).alias("n")), "runs", F.col("n") == 0, F.concat("n", F.lit(" runs")))
    return corpus_gates(chunks, index).unionByName(asked).unionByName(review).unionByName(cells)


def verdict(gates: DataFrame) -> DataFrame:
    """One row: FAIL if a gate fails, else BLOCKED if one blocks, else PASS."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return gates.agg(F.when(has("FAIL"), "FAIL").when(has("BLOCKED"), "BLOCKED").otherwise("PASS").alias("verdict"))


def write_preflight_report(gates: DataFrame, path: str) -> str:
    """The gates and their verdict as Markdown; the verdict."""
    rows, said = few_rows(gates), verdict(gates).first().verdict
    write_text(gates.sparkSession, path, "\n".join([f"# Preflight: {said}", "", *markdown_table(rows), ""]))
    return said


def guard_target(path: str, protected: tuple[str, ...] = ()) -> None:
    """Raises if the results' last path element holds a protected name: runs are never appended to a closed study."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for p in protected:
        if p.lower() in name:
            raise PermissionError(f"{path} is protected")


def release_snapshot(spark: SparkSession, documents: str, parts: dict[str, str], out: str) -> str:
    """The source files and parts copied below ``out`` with manifest.csv and its hash in manifest.sha256; the hash."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    for name, place in {"documents": documents, **parts}.items():
        source, target = at(place), at(f"{out}/{name}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, True, conf)
    listed = few_rows(file_hashes(spark, documents).orderBy("filename"), 1_000_000)
    text = listed.to_csv(index=False)
    write_text(spark, f"{out}/manifest.csv", text)
    digest = spark.createDataFrame([(text,)], "t string").select(F.sha2("t", 256)).first()[0]
    write_text(spark, f"{out}/manifest.sha256", f"{digest}  manifest.csv\n")
    return digest
