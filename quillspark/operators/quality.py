"""Corpus statistics, referential checks, fingerprints and the review sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank, stripped
from quillspark.schemas import LANGUAGES

NO_EVIDENCE = "Refer to target chunks"
# The columns of a review sheet that people fill in.
REVIEW_FIELDS = (
    "reviewer_1_id", "reviewer_1_semantic_preservation_1to5", "reviewer_1_naturalness_1to5", "reviewer_1_entity_constraint_preservation", "reviewer_1_decision",
    "reviewer_1_proposed_revision", "reviewer_1_comments", "reviewer_2_id", "reviewer_2_semantic_preservation_1to5", "reviewer_2_naturalness_1to5",
    "reviewer_2_entity_constraint_preservation", "reviewer_2_decision", "reviewer_2_proposed_revision", "reviewer_2_comments", "adjudicator_id",
    "adjudication_decision", "final_approved_query_text", "adjudication_notes",
)
VARIANTS = {"tamil_english": "Tamil-English (Tanglish)", "hindi_english": "Hindi-English (Hinglish)"}


def latest_documents(docs: DataFrame) -> DataFrame:
    """One row a document: the one ingested last, of several the one with the greatest file name.

    Only keys, times and names meet in the group-by, which combines before it shuffles, never the texts.
    """
    named = docs.withColumn("_time", F.coalesce("ingestion_timestamp", F.lit(""))).withColumn("_name", F.coalesce("filename", F.lit("")))
    last = named.groupBy("document_id").agg(F.max(F.struct("_time", "_name")).alias("l")).select("document_id", "l._time", "l._name")
    return named.join(last, ["document_id", "_time", "_name"], "left_semi").drop("_time", "_name").dropDuplicates(["document_id"])


def dataset_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, empty ones, length of the non-empty chunks, documents by type."""
    d = docs.agg(F.count("*").alias("documents"), F.count_if(is_blank(F.col("text"))).alias("empty_documents"))
    types = docs.groupBy("document_type").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("document_type", F.lit("")), "count")))).alias("document_types"))
    size = F.length(stripped(F.col("chunk_text")))
    some = F.when(size > 0, size)
    c = chunks.agg(
        F.count("*").alias("chunks"), F.count_if(is_blank(F.col("chunk_text"))).alias("empty_chunks"), F.coalesce(F.round(F.avg(some), 4), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(some), F.lit(0)).alias("min_length"), F.coalesce(F.max(some), F.lit(0)).alias("max_length"),
    )
    rows = d.unionByName(c, allowMissingColumns=True).unionByName(types, allowMissingColumns=True)  # one row each
    return rows.agg(*(F.first(x, ignorenulls=True).alias(x) for x in rows.columns))


def doc_type_counts(docs: DataFrame) -> DataFrame:
    """Documents by type."""
    return docs.groupBy("document_type").agg(F.count("*").alias("n"))


def orphan_expected_ids(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(question_id, document_id) of expected documents that aren't indexed."""
    wanted = queries.select("question_id", F.explode("expected_document_ids").alias("document_id")).distinct()
    return wanted.join(indexed.select("document_id").distinct(), "document_id", "left_anti").select("question_id", "document_id")


def gold_evidence(queries: DataFrame, chunks: DataFrame, length: int = 160) -> DataFrame:
    """question_id, evidence: the beginnings of the first chunks of the expected documents, in their order.

    Only the beginnings are shuffled, never the chunks' texts.
    """
    piece = F.btrim(F.regexp_replace(F.substring("chunk_text", 1, length), "\n", " "))
    first = chunks.select("document_id", "chunk_index", piece.alias("piece")).groupBy("document_id").agg(F.min_by("piece", F.struct("chunk_index", "piece")).alias("piece"))
    wanted = queries.groupBy("question_id").agg(F.min("expected_document_ids").alias("ids")).select("question_id", F.posexplode_outer("ids").alias("pos", "document_id"))
    found = wanted.join(first, "document_id", "left").filter("pos is null or piece is not null or document_id is not null")
    listed = found.groupBy("question_id").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda s: s["piece"]), " | ")
    return listed.select("question_id", F.when(F.size("x") > 0, joined).otherwise(NO_EVIDENCE).alias("evidence"))


def review_sheet(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per question and mixed variant in the 26 columns of the sheet: evidence, and the fields that reviewers and adjudicators fill in."""
    q = queries.groupBy("question_id").agg(*(F.min(c).alias(c) for c in (*LANGUAGES, "domain", "category", "expected_document_ids")))
    rows = q.unpivot(["question_id", "english", "domain", "category", "expected_document_ids"], list(VARIANTS), "variant", "code_mixed_query")
    names = F.create_map(*(F.lit(x) for kv in VARIANTS.items() for x in kv))
    return rows.join(gold_evidence(queries, chunks), "question_id").select(
        "question_id", names[F.col("variant")].alias("language_variant"), "code_mixed_query", F.col("english").alias("english_reference_query"), "domain", "category",
        F.concat_ws(";", "expected_document_ids").alias("expected_document_ids"), F.col("evidence").alias("gold_evidence_snippet"),
        *(F.lit("PENDING" if c.endswith("decision") else "").alias(c) for c in REVIEW_FIELDS),
    )


def nested_benchmark(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a question for a benchmark in JSON: its English reference, and each mixed variant with the state of its review."""
    q = queries.groupBy("question_id").agg(*(F.min(c).alias(c) for c in (*LANGUAGES, "domain", "category", "difficulty", "expected_document_ids")))
    none = F.lit(None).cast("string")
    reviewer = F.struct(*(none.alias(c) for c in ("decision", "id", "score", "notes")))
    pending = lambda c: F.struct(
        F.col(c).alias("query"), F.lit("Romanized").alias("script_type"), F.lit("PENDING_HUMAN_BILINGUAL_REVIEW").alias("status"), reviewer.alias("reviewer_1"), reviewer.alias("reviewer_2"),
        F.struct(F.lit("PENDING").alias("status"), none.alias("final_query"), none.alias("adjudicator")).alias("adjudication"),
    )
    return q.join(gold_evidence(queries, chunks), "question_id").select(
        "question_id", F.coalesce("domain", F.lit("General")).alias("domain"), F.coalesce("category", F.lit("General")).alias("category"), F.coalesce("difficulty", F.lit("Medium")).alias("difficulty"),
        "expected_document_ids", F.col("evidence").alias("gold_supporting_evidence"), F.struct(F.col("english").alias("query"), F.lit("CANONICAL_ENGLISH_REFERENCE").alias("status")).alias("english"),
        *(pending(c).alias(c) for c in VARIANTS),
    )


def review_incomplete(sheet: DataFrame) -> DataFrame:
    """question_id, language_variant, reason of each row of a sheet that is not ready to be applied; exact repeats count once."""
    upper = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    waits = lambda c: upper(c).isin("", "PENDING")
    reason = (
        F.when(waits("reviewer_1_decision") | waits("reviewer_2_decision"), "reviewer decisions pending").when(waits("adjudication_decision"), "adjudication decision pending")
        .when(upper("final_approved_query_text") == "", "missing final_approved_query_text")
    )
    return sheet.distinct().select("question_id", "language_variant", reason.alias("reason")).filter("reason is not null")


def documents_by_file(docs: DataFrame) -> DataFrame:
    """filename, documents (distinct ids), rows."""
    return docs.groupBy("filename").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("rows"))


def of_files(docs: DataFrame, filenames: list[str]) -> DataFrame:
    """The documents of the files named."""
    return docs.filter(F.col("filename").isin(*filenames))


def review_progress(sheet: DataFrame) -> DataFrame:
    """Per variant: distinct rows, rows that both reviewers decided, rows adjudicated."""
    decided = lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("", "PENDING") == F.lit(False)
    return sheet.distinct().groupBy("language_variant").agg(
        F.count("*").alias("rows"), F.count_if(decided("reviewer_1_decision") & decided("reviewer_2_decision")).alias("both_decided"), F.count_if(decided("adjudication_decision")).alias("adjudicated"),
    )


def reviewer_agreement(sheet: DataFrame) -> DataFrame:
    """Raw agreement of the two reviewers, in percent of the rows that both decided; decisions as they are written."""
    a, b = (F.upper(F.trim(f"reviewer_{n}_decision")) for n in (1, 2))
    both = sheet.distinct().select(a.alias("a"), b.alias("b")).filter("a is not null and b is not null and a not in ('', 'PENDING') and b not in ('', 'PENDING')")
    return both.agg(F.count("*").alias("both_decided"), F.count_if(F.col("a") == F.col("b")).alias("matches"), F.round(100 * F.avg((F.col("a") == F.col("b")).cast("int")), 4).alias("percent"))


def cohen_kappa(sheet: DataFrame) -> DataFrame:
    """Agreement of the two reviewers beyond chance, decisions as they are written (an extension)."""
    a, b = (F.upper(F.trim(f"reviewer_{n}_decision")) for n in (1, 2))
    both = sheet.distinct().select(a.alias("a"), b.alias("b")).filter("a is not null and b is not null and a not in ('', 'PENDING') and b not in ('', 'PENDING')")
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("c"), F.lit(0).alias("x"), F.col("n").alias("y")))).alias("s")).groupBy("s.c").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = seen.unionByName(sides.agg(F.sum(F.col("x") * F.col("y")).alias("chance")), allowMissingColumns=True)
    one = rows.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "same", "chance")))
    by_chance = F.col("chance") / (F.col("n") * F.col("n"))
    return one.select("n", F.round(F.try_divide(F.col("same") / F.col("n") - by_chance, 1 - by_chance), 4).alias("kappa"))


def apply_review(queries: DataFrame, sheet: DataFrame) -> DataFrame:
    """Queries with the approved texts of the sheet in place of the mixed variants they were given for.

    An approved text for a question that isn't there raises ``KeyError``.
    """
    done = sheet.filter(F.trim("final_approved_query_text") != "").select("question_id", F.when(F.col("language_variant").contains("Tamil"), "tamil_english").otherwise("hindi_english").alias("column"), F.trim("final_approved_query_text").alias("text"))
    unknown = [r.question_id for r in done.select("question_id").distinct().join(queries.select("question_id"), "question_id", "left_anti").limit(5).collect()]
    if unknown:
        raise KeyError(f"approved texts for unknown questions: {unknown}")
    approved = done.groupBy("question_id").pivot("column", list(VARIANTS)).agg(F.max("text")).withColumnsRenamed({c: f"new_{c}" for c in VARIANTS})
    q = queries.dropDuplicates(["question_id"]).join(approved, "question_id", "left")
    return q.withColumns({c: F.coalesce(f"new_{c}", c) for c in VARIANTS}).drop(*(f"new_{c}" for c in VARIANTS))


def duplicate_queries(queries: DataFrame) -> DataFrame:
    """(kind, value, n): question ids stored more than once, and variants equal but for case under several questions."""
    ids = queries.groupBy(F.col("question_id").alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("question_id").alias("kind"), "value", "n")
    distinct = queries.unpivot("question_id", list(LANGUAGES), "kind", "text").filter("text is not null").select("question_id", "kind", F.lower("text").alias("value")).distinct()
    texts = distinct.groupBy("kind", "value").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "value", "n")
    return ids.unionByName(texts)


def preflight_violations(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(check, key): every row of a query dataset that an experiment can't start with."""
    mock = queries.filter(F.upper("question_id").rlike("SMOKE|MOCK|TEST")).select(F.lit("mock row").alias("check"), F.col("question_id").alias("key"))
    unnamed = queries.filter(is_blank(F.col("question_id"))).select(F.lit("missing question_id").alias("check"), F.lit("").alias("key"))
    repeated = queries.groupBy("question_id").count().filter("count > 1 and question_id is not null").select(F.lit("duplicate question_id").alias("check"), F.col("question_id").alias("key"))
    blank = queries.unpivot("question_id", list(LANGUAGES), "variant", "text").filter(is_blank(F.col("text"))).select(F.concat(F.lit("blank "), F.col("variant")).alias("check"), F.col("question_id").alias("key"))
    none = queries.filter(F.col("expected_document_ids").isNull() | (F.size("expected_document_ids") == 0)).select(F.lit("no expected documents").alias("check"), F.col("question_id").alias("key"))
    orphan = orphan_expected_ids(queries, indexed).select(F.lit("expected document not indexed").alias("check"), F.concat_ws(":", "question_id", "document_id").alias("key"))
    return mock.unionByName(unnamed).unionByName(repeated).unionByName(blank).unionByName(none).unionByName(orphan)


def corpus_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a fingerprint of a table's distinct rows that doesn't depend on their order and sums up in parts.

    The sum of 60-bit pieces of the rows' hashes; the SHA-256 of count and sum is the fingerprint.
    """
    h = F.sha2(F.concat_ws(":", *columns), 256)
    part = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    total = rows.select(*columns).distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").alias("s"))
    return total.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("corpus_hash"))


def corpus_manifest(files: DataFrame, chunks_sha: str | None = None) -> DataFrame:
    """One row: the files of a folder with size and hash, and the hash over 'name:hash' in order of names (a folder's files, not its documents)."""
    listed = F.sort_array(F.collect_list(F.struct("filename", "sha256", "size_bytes")))
    folded = F.concat(F.array_join(F.transform("files", lambda f: F.concat(f["filename"], F.lit(":"), f["sha256"])), ""), F.lit(chunks_sha or ""))
    return files.agg(listed.alias("files")).select(F.size("files").alias("num_source_documents"), F.col("files").alias("source_documents"), F.sha2(folded, 256).alias("corpus_hash"))
