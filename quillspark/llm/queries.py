"""The pN_ queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import annotators, languages, leakage, mojibake, packing, pairs, splitting, tongues, unify
from quillspark.tables import table

QUERY_FIELDS = ["original_query", "normalized_query"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of experiment_results in which some character is not the plain one."""
    return unify.disguised_values(table(spark, sf_dir, "experiment_results"), "id", QUERY_FIELDS)


def p1_equal_looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain forms of all queries with the number of values and spellings."""
    return unify.equal_looking(table(spark, sf_dir, "experiment_results"), "id", QUERY_FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to be revised or rejected and reviewers who can't be relied on."""
    return annotators.disputed(table(spark, sf_dir, "human_query_review_sheet"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus decision of every item with its probabilities."""
    return annotators.consensus(annotators.review_labels(table(spark, sf_dir, "human_query_review_sheet"))).items


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every reviewer with its posterior interval."""
    return annotators.reliability(annotators.consensus(annotators.review_labels(table(spark, sf_dir, "human_query_review_sheet"))))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of decisions and of scores."""
    return annotators.krippendorff(annotators.review_labels(table(spark, sf_dir, "human_query_review_sheet"))).withColumn("alpha", F.round("alpha", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective runs of experiment_results with their defect."""
    return pairs.defective_pairs(table(spark, sf_dir, "experiment_results"), tongues=tongues.sampled(table(spark, sf_dir, "documents")))


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs have which defect, and by what a truncated response was told."""
    found = pairs.defective_pairs(table(spark, sf_dir, "experiment_results"), tongues=tongues.sampled(table(spark, sf_dir, "documents")), with_reason=True)
    return found.groupBy("defect", "why").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks that aren't valid pieces, and documents without chunks."""
    return splitting.audit_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "source_documents"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pieces of every document."""
    return splitting.split_documents(table(spark, sf_dir, "source_documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the texts whose language label is missing or wrong, or that mix languages."""
    return languages.mislabelled(table(spark, sf_dir, "experiment_results"), table(spark, sf_dir, "query_records"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text and of each of its segments, of every run and of every question."""
    return languages.all_segments(table(spark, sf_dir, "experiment_results"), table(spark, sf_dir, "query_records"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or part of one."""
    return packing.containers(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(packing.containers(table(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an evaluation item, and the item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a character garbled by a wrong encoding."""
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their text restored as far as it can be told."""
    return mojibake.restored_text(table(spark, sf_dir, "documents")).filter("garbled").select("doc_id", "restored")


P4_FOUND = r"""
with d as (select document_id, max_by(text, ingestion_timestamp) as text from source_documents group by document_id),
c as (select distinct document_id, chunk_index, chunk_text, char_start, char_end from chunks),
j as (
  select c.*, d.text, length(d.text) as n,
    lag(char_end) over w as before, row_number() over w as rn, lead(chunk_index) over w is null as is_last
  from c join d using (document_id) window w as (partition by c.document_id order by chunk_index, char_start, char_end, chunk_text))
select document_id, chunk_index from j
where not coalesce(0 <= char_start and char_start < char_end and char_end <= n and char_end - char_start <= 500 and length(chunk_text) <= 500
  and chunk_text = trim(substring(text, char_start + 1, char_end - char_start), E' \n\r\t')
  and case when rn = 1 then char_start = 0 else char_start = before - 100 end
  and (not is_last or char_end = n)
  and (char_end = n or not regexp_matches(substring(text, char_start + 101, 400), '\s') or regexp_matches(substring(text, char_end, 1), '\s')), false)
union all
select document_id, -1 from d where document_id not in (select document_id from c)
"""


P2_AGREEMENT = r"""
with s as (select distinct * from human_query_review_sheet),
l as (
  select question_id || '|' || language_variant as item, unnest([reviewer_1_decision, reviewer_2_decision]) as d, upper(trim(unnest([reviewer_1_semantic_preservation_1to5, reviewer_2_semantic_preservation_1to5]))) as r from s),
u as (
  select item, case when k in ('ACCEPT', 'ACCEPTED') then 1 when k in ('REVISE', 'REVISED') then 2 when k in ('REJECT', 'REJECTED') then 3 end as decision,
    case r when 'ONE' then 1 when 'TWO' then 2 when 'THREE' then 3 when 'FOUR' then 4 when 'FIVE' then 5 else try_cast(regexp_extract(r, '^([1-5])(?:\.0+)?(?:\s*/\s*5)?$', 1) as int) end as score
  from (select *, regexp_replace(upper(d), '[^A-Z]', '', 'g') as k from l) where item is not null),
v as (select 'decision' as kind, item, decision as v from u where decision is not null union all select 'score', item, score from u where score is not null),
n as (select kind, item, v, count(*) as c from v group by all),
m as (select kind, item, sum(c) as m from n group by all having sum(c) > 1),
seen as (
  select a.kind, sum(a.c * b.c * case when a.kind = 'decision' then 1.0 else (a.v - b.v) ** 2 end / (m.m - 1)) as x
  from m join n a using (kind, item) join n b on b.kind = a.kind and b.item = a.item and b.v <> a.v group by 1),
t as (select n.kind, v, sum(c) as c from n join m using (kind, item) group by all),
expected as (select a.kind, sum(a.c * b.c * case when a.kind = 'decision' then 1.0 else (a.v - b.v) ** 2 end) as x from t a join t b on a.kind = b.kind and a.v <> b.v group by 1)
select kind, round(1 - seen.x / (expected.x / (count_m.n - 1)), 6) as alpha, count_m.items as n_items, count_m.n::bigint as n_labels
from (select kind, count(*) as items, sum(m) as n from m group by 1) count_m join seen using (kind) join expected using (kind)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p2_agreement": P2_AGREEMENT}
