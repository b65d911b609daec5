"""The queries of the core over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.stats import benjamini_hochberg
from quillspark.functions.vectors import l2_normalize
from quillspark import sinks
from quillspark.operators import analytics as an
from quillspark.operators import chunking, detection, gates, judging, quality, retrieval
from quillspark.operators import experiment as ex
from quillspark.plans import generation, rag
from quillspark.sources import datasets, files
from quillspark.streaming import incremental
from quillspark.tables import checkpoint_dir, cut, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "experiment_results")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_records")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_documents")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks")


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "human_query_review_sheet")


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return an.valid_records(_runs(spark, sf))


# --- analytics -------------------------------------------------------------------------------------------------

CONDITION = "language || case when mitigation_enabled then '_mitigated' else '_baseline' end"
CONDITIONS = "(select unnest(['english_baseline', 'english_mitigated', 'tamil_english_baseline', 'tamil_english_mitigated', 'hindi_english_baseline', 'hindi_english_mitigated']) as condition)"
VALIDATED = f"""
with g as (
  select *, case when experiment_id is null or experiment_id = '' then 'unknown' else experiment_id end as exp,
    case when question_id is null or question_id = '' then 'missing question_id' when language is null or language = '' then 'missing language'
      when mitigation_enabled is null then 'missing mitigation condition' when faithfulness_score is null then 'missing faithfulness score'
      when hallucination_flag is null then 'missing hallucination flag' when generated_answer is null or generated_answer = '' then 'missing answer'
      when retrieved_context is null or retrieved_context = '' then 'missing retrieved context' end as gap
  from experiment_results),
k as (select *, row_number() over (partition by exp, question_id, language, mitigation_enabled, gap is null order by id) as rn from g),
v as (
  select * exclude (exp, gap, rn, experiment_id), exp as experiment_id, {CONDITION} as condition,
    coalesce(gap, case when rn > 1 then 'duplicate record' end, case when not isnan(faithfulness_score) and (faithfulness_score < 0 or faithfulness_score > 1) then 'invalid faithfulness score outside [0.0, 1.0]' end) as exclusion_reason
  from k),
valid as (select * from v where exclusion_reason is null)
"""
NUMBER = "case when not isnan(faithfulness_score) then faithfulness_score end"
LAST = f"{VALIDATED}, s as (select question_id, condition, max_by(faithfulness_score, id) as score from valid where not isnan(faithfulness_score) group by 1, 2)"
PLANNED = """(values ('english_baseline', 'tamil_english_baseline'), ('english_baseline', 'hindi_english_baseline'), ('tamil_english_baseline', 'tamil_english_mitigated'),
  ('hindi_english_baseline', 'hindi_english_mitigated'), ('tamil_english_mitigated', 'english_baseline'), ('hindi_english_mitigated', 'english_baseline')) p(cond1, cond2)"""
PAIRED = f"{LAST}, d as (select a.question_id, p.cond1, p.cond2, a.score as score1, b.score as score2, a.score - b.score as diff from {PLANNED} join s a on a.condition = p.cond1 join s b on b.condition = p.cond2 and a.question_id = b.question_id)"


@_query(f"select id, {CONDITION} as condition from experiment_results where language is not null and mitigation_enabled is not null")
def condition_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).filter("language is not null and mitigation_enabled is not null")
    return rows.select("id", an.condition_name(F.col("language"), F.col("mitigation_enabled")).alias("condition"))


@_query(f"{VALIDATED} select id, exclusion_reason from v")
def validate_records(spark: SparkSession, sf: str) -> DataFrame:
    return an.validate_records(_runs(spark, sf)).select("id", "exclusion_reason")


@_query(f"{VALIDATED} select coalesce(exclusion_reason, 'valid') as reason, count(*) as n from v group by 1")
def exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return an.exclusion_reasons(_runs(spark, sf))


STATS = f"""{VALIDATED}, n as (select condition, {NUMBER} as s, hallucination_flag as h from valid), t as (
  select condition, count(*) as n, round(avg(s), 4) as mean, round(median(s), 4) as median, round(coalesce(stddev_samp(s), 0), 4) as std, round(avg(h::int), 4) as hallucination_rate, min(s) as min, max(s) as max
  from n where s is not null group by 1),
st as (select c.condition, coalesce(n, 0) as n, mean, median, std, hallucination_rate, min, max from {CONDITIONS} c left join t using (condition))"""


@_query(f"{STATS} select * from st")
def condition_stats(spark: SparkSession, sf: str) -> DataFrame:
    return an.condition_stats(_valid(spark, sf))


@_query(f"""{VALIDATED} select c.condition, round(avg(recall_at_1), 4) as mean_recall_at_1, round(avg(recall_at_3), 4) as mean_recall_at_3, round(avg(recall_at_5), 4) as mean_recall_at_5, count(recall_at_1) as n_with_recall
from {CONDITIONS} c left join valid using (condition) group by 1""")
def recall_stats(spark: SparkSession, sf: str) -> DataFrame:
    return an.recall_stats(_valid(spark, sf))


@_query(f"""{VALIDATED} select count(distinct question_id) as questions, count(*) as records, coalesce(round(avg({NUMBER}), 4), 0.0) as mean_score, coalesce(round(avg(hallucination_flag::int), 4), 0.0) as hallucination_rate,
case when count(*) = 0 then 'empty' else 'ok' end as status from valid""")
def dashboard_overview(spark: SparkSession, sf: str) -> DataFrame:
    return an.dashboard_overview(_valid(spark, sf))


@_query(f"{VALIDATED} select id, condition, hallucination_flag from valid where language = 'tamil_english' and mitigation_enabled and hallucination_flag")
def dashboard_filter(spark: SparkSession, sf: str) -> DataFrame:
    return an.dashboard_filter(_valid(spark, sf), "tamil_english", True, True).select("id", "condition", "hallucination_flag")


@_query(f"{PAIRED} select question_id, cond1, cond2, round(diff, 6) as diff from d")
def paired_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return an.paired_diffs(an.last_scores(_valid(spark, sf))).select("question_id", "cond1", "cond2", F.round("diff", 6).alias("diff"))


@_query(f"""{LAST}, q as (select distinct question_id from s)
select q.question_id, p.cond1, p.cond2, case when a.score is null then 'missing_cond1' else 'missing_cond2' end as missing
from q cross join {PLANNED} left join s a on a.question_id = q.question_id and a.condition = p.cond1 left join s b on b.question_id = q.question_id and b.condition = p.cond2
where (a.score is null) <> (b.score is null)""")
def missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return an.missing_pairs(an.last_scores(_valid(spark, sf)))


@_query(f"""{PAIRED}, r as (select cond1, cond2, diff, rank() over w + (count(*) over (partition by cond1, cond2, round(abs(diff), 9)) - 1) / 2.0 as rank
  from d where round(abs(diff), 9) > 0 window w as (partition by cond1, cond2 order by round(abs(diff), 9)))
select cond1, cond2, count(*) as n_nonzero, round(coalesce(sum(rank) filter (diff > 0), 0), 1) as w_plus, round(coalesce(sum(rank) filter (diff < 0), 0), 1) as w_minus from r group by 1, 2""")
def wilcoxon_w(spark: SparkSession, sf: str) -> DataFrame:
    w = an.rank_sums(an.paired_diffs(an.last_scores(_valid(spark, sf))))
    return w.select("cond1", "cond2", "n_nonzero", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"))


#: The normal approximation by the series of the error function: SQL has none.
COMPARED = f"""{PAIRED}, r as (select cond1, cond2, diff, round(abs(diff), 9) as size, rank() over w + (count(*) over (partition by cond1, cond2, round(abs(diff), 9)) - 1) / 2.0 as rank
  from d where round(abs(diff), 9) > 0 window w as (partition by cond1, cond2 order by round(abs(diff), 9))),
ties as (select cond1, cond2, sum(t * t * t - t)::double as tie from (select cond1, cond2, size, count(*) as t from r group by 1, 2, 3) group by 1, 2),
w as (select cond1, cond2, count(*)::double as k, least(coalesce(sum(rank) filter (diff > 0), 0), coalesce(sum(rank) filter (diff < 0), 0))::double as w from r group by 1, 2),
ag as (select cond1, cond2, count(*) as n, round(avg(diff), 4) as mean_diff, round(median(diff), 4) as median_diff, count(*) filter (diff <> 0) as changed from d group by 1, 2),
z as (select *, abs(w - k * (k + 1) / 4) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - tie / 48) / sqrt(2) as x from w join ties using (cond1, cond2)),
e as (select cond1, cond2, w, case when x > 5 then 0 else 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda i: (case when i % 2 = 0 then 1 else -1 end) * (case when x = 0 then 0 else exp((2 * i + 1) * ln(x) - lgamma(i + 1)) end) / (2 * i + 1))) end as p from z),
c as (select p.cond1, p.cond2, coalesce(n, 0) as n, case when n >= 2 then mean_diff end as mean_diff, case when n >= 2 then median_diff end as median_diff, case when n >= 2 and changed > 0 then e.w end as statistic,
  case when n >= 2 and changed > 0 then e.p end as p, case when coalesce(n, 0) < 2 then 'INSUFFICIENT DATA' when changed = 0 then 'NOT TESTABLE' else 'TESTED' end as status
  from {PLANNED} left join ag on ag.cond1 = p.cond1 and ag.cond2 = p.cond2 left join e on e.cond1 = p.cond1 and e.cond2 = p.cond2),
b as (select *, case when p is not null then round(p, 6) * count(p) over () / row_number() over (order by round(p, 6) nulls last) end as q, row_number() over (order by round(p, 6) nulls last) as k from c)"""


@_query(f"""{COMPARED} select cond1, cond2, n, mean_diff, median_diff, round(statistic, 1) as statistic, round(p, 5) as p_value, p < 0.05 as significant, status,
case when p is not null then round(least(1.0, min(q) over (order by k desc)), 4) end as q_value from b""")
def paired_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    diffs = cut(an.paired_diffs(an.last_scores(_valid(spark, sf))))
    rounded = {"statistic": 1, "p_value": 5, "q_value": 4}
    rows = benjamini_hochberg(an.paired_comparisons(diffs))
    return rows.withColumns({c: F.round(c, k) for c, k in rounded.items()})


@_query(f"""{STATS}, e as (select mean as english_mean from st where condition = 'english_baseline')
select condition, english_mean, mean, english_mean - mean as difference, case when english_mean - mean is null then 'INSUFFICIENT DATA' when english_mean - mean <= 0.10 then 'MET' else 'NOT MET' end as status
from st, e where condition in ('tamil_english_mitigated', 'hindi_english_mitigated')""")
def success_criterion(spark: SparkSession, sf: str) -> DataFrame:
    return an.success_criterion(an.condition_stats(_valid(spark, sf)))


@_query("select case when coalesce(bool_or(coalesce(contains(question_id, 'SMOKE'), false) or coalesce(contains(experiment_id, 'test'), false)), false) then 'MOCK/TEST' else 'ACTUAL' end as classification from experiment_results")
def data_classification(spark: SparkSession, sf: str) -> DataFrame:
    return an.data_classification(_runs(spark, sf))


@_query(f"select count(s) as n, round(avg(s), 4) as mean, min(s) as min, max(s) as max, round(sum(s), 2) as total from (select {NUMBER} as s from experiment_results)")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return an.eval_summary(_runs(spark, sf))


@_query(f"{STATS} select condition, coalesce(mean, 0.0) as mean, coalesce(hallucination_rate, 0.0) as hallucination_rate from st")
def chart_data(spark: SparkSession, sf: str) -> DataFrame:
    """The charts' maps, one row an entry."""
    chart = an.chart_data(an.condition_stats(_valid(spark, sf)))
    return chart.select(F.explode("mean").alias("condition", "mean"), "hallucination_rate").select("condition", "mean", F.element_at("hallucination_rate", F.col("condition")).alias("hallucination_rate"))


@_query("""with h as (select language, list_position(list_transform(retrieved_document_ids, lambda r: len(list_filter(expected_document_ids, lambda e: starts_with(r, e) or starts_with(e, r))) > 0), true) as hit
  from experiment_results where retrieved_document_ids is not null)
select language, round(avg(coalesce(1.0 / nullif(hit, 0), 0.0)), 4) as mrr, count(*) as n from h group by 1""")
def mean_reciprocal_rank(spark: SparkSession, sf: str) -> DataFrame:
    return an.reciprocal_ranks(_runs(spark, sf))


# --- experiment ------------------------------------------------------------------------------------------------

MATRIX = """with q as (select question_id, min(english) as english, min(tamil_english) as tamil_english, min(hindi_english) as hindi_english from query_records group by 1),
u as (select question_id, unnest([{'language': 'english', 'query': english}, {'language': 'tamil_english', 'query': tamil_english}, {'language': 'hindi_english', 'query': hindi_english}]) as x from q),
m as (select x.language || case when mitigation_enabled then '_mitigated' else '_baseline' end as experiment_id, question_id, x.language as language, mitigation_enabled, x.query as query
  from u cross join (select unnest([true, false]) as mitigation_enabled)),
done as (select distinct experiment_id, question_id, language, mitigation_enabled from experiment_results where error is null and completed_at is not null)
"""


@_query(f"{MATRIX} select * from m")
def experiment_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ex.experiment_matrix(_asked(spark, sf))


@_query(f"{MATRIX} select * from m where language in ('english', 'hindi_english') and mitigation_enabled")
def matrix_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return ex.experiment_matrix(_asked(spark, sf), ["english", "hindi_english"], True)


@_query("select question_id, unnest(['english', 'tamil_english', 'hindi_english']) as language, unnest([english, tamil_english, hindi_english]) as query from query_records")
def language_variants(spark: SparkSession, sf: str) -> DataFrame:
    return ex.language_variants(_asked(spark, sf))


@_query(f"{MATRIX} select * from done")
def completed_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ex.completed_keys(_runs(spark, sf))


@_query(f"{MATRIX} select m.* from m anti join done using (experiment_id, question_id, language, mitigation_enabled)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    return ex.resume_pending(ex.experiment_matrix(_asked(spark, sf)), _runs(spark, sf))


@_query(f"""{MATRIX} select m.experiment_id, count(*) as total, count(*) filter (d.question_id is null) as pending, count(*) filter (d.question_id is not null) as skipped
from m left join done d on (m.experiment_id, m.question_id, m.language, m.mitigation_enabled) = (d.experiment_id, d.question_id, d.language, d.mitigation_enabled) group by 1""")
def dry_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ex.dry_run_summary(ex.experiment_matrix(_asked(spark, sf)), _runs(spark, sf))


_HIT = "len(list_filter(coalesce(retrieved_document_ids, [])[1:{k}], lambda r: len(list_filter(coalesce(expected_document_ids, []), lambda e: starts_with(r, e) or starts_with(e, r))) > 0)) > 0"


@_query("select id, " + ", ".join(f"case when error is null then case when {_HIT.format(k=k)} then 1.0 else 0.0 end end::double as recall_at_{k}" for k in (1, 3, 5)) + " from experiment_results")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return ex.recall_at_k(_runs(spark, sf))


@_query("select id, regexp_matches(lower(error), 'rate limit|ratelimit|rate_limit|too many requests|429|connection|timeout|503|502') as transient from experiment_results where error is not null")
def transient_errors(spark: SparkSession, sf: str) -> DataFrame:
    return ex.transient_errors(_runs(spark, sf))


@_query(f"""select experiment_id, count(*) as executed, count(*) filter (error is null) as completed, count(*) filter (error is not null) as failed, round(avg({NUMBER}), 4) as mean_score,
count(*) filter (hallucination_flag) as hallucinations from experiment_results group by 1""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ex.run_summary(_runs(spark, sf))


@_query("select run_id, min(id) as id from experiment_results group by 1")
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return ex.latest_runs(_runs(spark, sf)).select("run_id", "id")


@_query("select id, experiment_id, question_id, coalesce(retrieved_document_ids, []) as retrieved_document_ids from experiment_results order by experiment_id, question_id, id")
def scan_results(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.scan_results(_runs(spark, sf)).select("id", "experiment_id", "question_id", "retrieved_document_ids")


@_query("select id, question_id, case when id % 7 = 0 then [] else coalesce(retrieved_document_ids, []) end as retrieved_document_ids from experiment_results where experiment_id = 'english_baseline'")
def scan_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment's runs, their ids read back from JSON text; every seventh text is broken and gives no ids."""
    rows = _runs(spark, sf).withColumn("retrieved_document_ids", F.when(F.col("id") % 7 == 0, '["broken').otherwise(F.to_json("retrieved_document_ids")))
    return datasets.scan_results(rows, "english_baseline").select("id", "question_id", "retrieved_document_ids")


@_query("""select id, run_id, question_id, language from experiment_results where id % 3 <> 0
union all select min(id), run_id, min_by(question_id, id), null from experiment_results where run_id not in (select run_id from experiment_results where id % 3 <> 0) group by run_id""")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """All runs inserted into a store that holds two thirds of them; the new rows lack a column and bring an unknown one."""
    rows = _runs(spark, sf).select("id", "run_id", "question_id", "language")
    stored = rows.filter("id % 3 <> 0")
    new = ex.latest_runs(rows).drop("language").withColumn("unknown", F.lit(1))
    return stored.unionByName(ex.insert_or_ignore(new, stored))


@_query("select condition_name, language, mitigation_enabled, top_k from (select unnest(['english', 'tamil_english', 'hindi_english']) as language), (select unnest([true, false]) as mitigation_enabled), (select 5::int as top_k), lateral (select language || case when mitigation_enabled then '_mitigated' else '_baseline' end as condition_name) x")
def experiment_configs(spark: SparkSession, sf: str) -> DataFrame:
    return ex.configs(spark).select(F.col("experiment_id").alias("condition_name"), "language", "mitigation_enabled", "top_k")


@_query(f"""select strftime(time_bucket(interval 1 hour, started_at), '%Y-%m-%d %H:%M:%S') as window_start, language, mitigation_enabled, count(*) as runs, count(*) filter (error is not null) as failed, round(avg({NUMBER}), 4) as mean_score
from experiment_results where started_at is not null group by 1, 2, 3""")
def windowed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.windowed_runs(_runs(spark, sf)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# --- retrieval -------------------------------------------------------------------------------------------------


@_query("""with p as (select q.vec_id as query_id, c.vec_id as id, list_inner_product(q.embedding::double[], c.embedding::double[]) as s from embeddings q, embeddings c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from p)
select query_id, id, round(s, 5) as score, rank from r where rank <= 5""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = retrieval.top_k(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 5, without_self=True)
    return hits.withColumn("score", F.round("score", 5))


@_query("select vec_id, list_transform(embedding, lambda x: round(x::double / greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])), 1e-10), 6)) as unit from embeddings")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform(l2_normalize(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@_query()
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return rag.build_index(_chunks(spark, sf)).select("chunk_id", "embedding")


@_query()
def rag_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf).drop("latency")


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """The whole matrix, baseline and mitigated, answered and judged."""
    asked = ex.experiment_matrix(_asked(spark, sf)).select(F.concat_ws("|", "question_id", "language", "mitigation_enabled").alias("query_id"), "query", "mitigation_enabled")
    return rag.answer(asked, cut(rag.build_index(_chunks(spark, sf))), mitigation=F.col("mitigation_enabled"), normalizer=detection.content_words)


@_query("select id, array_to_string(list_transform(retrieved_document_ids, lambda t, i: '--- Document ' || i || ' ---' || chr(10) || t), chr(10) || chr(10)) as context from experiment_results where retrieved_document_ids is not null")
def build_context(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).filter("retrieved_document_ids is not null").select("id", rag.build_context(F.col("retrieved_document_ids")).alias("context"))


@_query("""select id, sha256('Answer only from the context.' || chr(10) || chr(10) || '<context>' || chr(10) || retrieved_context || chr(10) || '</context>' || chr(10) || chr(10) || 'Query: ' || original_query || chr(10)) as prompt_hash
from experiment_results where retrieved_context is not null and original_query is not null""")
def prompt_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).filter("retrieved_context is not null and original_query is not null")
    return rows.select("id", rag.prompt_hash(rag.build_prompt(F.col("original_query"), F.col("retrieved_context"))).alias("prompt_hash"))


@_query("select distinct unnest([document_id, chunk_id]) as id from chunks")
def indexed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.index_ids(_chunks(spark, sf))


# --- question understanding ------------------------------------------------------------------------------------

_LEXICON = {k: "[" + ", ".join(f"'{w}'" for w in words) + "]" for k, words in (("tamil", detection.TAMIL_WORDS), ("hindi", detection.HINDI_WORDS))}
DETECTED = f"""with t as (select id, original_query as q, list_distinct(regexp_extract_all(lower(coalesce(original_query, '')), '[a-z]+')) as w, list_transform(regexp_extract_all(original_query, '[\\p{{L}}\\p{{N}}_]+'), lambda x:
    case when regexp_matches(x, '[\\x{{0900}}-\\x{{097F}}]') then 'Hindi' when regexp_matches(x, '[\\x{{0B80}}-\\x{{0BFF}}]') then 'Tamil' when regexp_matches(x, '[a-zA-Z]') then 'English' end) as sc from experiment_results),
f as (select id, q, list_has_any(w, {_LEXICON['tamil']}) as ta, list_has_any(w, {_LEXICON['hindi']}) as hi, list_filter(['English', 'Hindi', 'Tamil'], lambda l: list_contains(sc, l)) as ls from t),
det as (select id, q, case when q is null or trim(q, E' \\n\\t\\r') = '' then 0 when ta or hi then 1 else 2 end as pass, ta, hi, ls from f)"""


@_query(f"""{DETECTED} select id, case pass when 0 then false when 1 then true else len(ls) > 1 end as is_code_mixed,
case pass when 0 then 'Unknown' when 1 then 'English' || case when ta then ',Tamil' else '' end || case when hi then ',Hindi' else '' end else case when len(ls) = 0 then 'Unknown' else array_to_string(ls, ',') end end as languages,
case pass when 0 then 1.0 when 1 then 0.85 else case when len(ls) > 1 then 0.95 else 0.7 end end::double as confidence from det""")
def detect_code_mix(spark: SparkSession, sf: str) -> DataFrame:
    d = _runs(spark, sf).select("id", detection.detect(F.col("original_query")).alias("d"))
    return d.select("id", "d.is_code_mixed", F.concat_ws(",", "d.languages").alias("languages"), F.col("d.confidence").cast("double").alias("confidence"))


@_query(f"""{DETECTED}, ch as (select id, q, i, q[i] as ch from (select id, q, unnest(range(1, len(q) + 1)) as i from f where q is not null and not ta and not hi)),
m as (select *, regexp_matches(ch, '[\\p{{L}}\\p{{N}}_]') as inside from ch),
s as (select *, sum((inside and not coalesce(before, false))::int) over (partition by id order by i) as word from (select *, lag(inside) over (partition by id order by i) as before from m)),
wd as (select id, word, min(i) - 1 as a, max(i) as b, case when bool_or(regexp_matches(ch, '[\\x{{0900}}-\\x{{097F}}]')) then 'Hindi' when bool_or(regexp_matches(ch, '[\\x{{0B80}}-\\x{{0BFF}}]')) then 'Tamil'
  when bool_or(regexp_matches(ch, '[a-zA-Z]')) then 'English' else 'Unknown' end as language from s where inside group by 1, 2),
gr as (select *, sum(new) over (partition by id order by word) as run from (select *, (language is distinct from lag(language) over (partition by id order by word))::int as new from wd)),
sp as (select id, run, language, min(a) as a, max(b) as b from gr group by 1, 2, 3)
select sp.id, sp.a::int as "start", sp.b::int as "end", sp.language, substring(f.q, sp.a + 1, sp.b - sp.a) as text from sp join f on sp.id = f.id""")
def language_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of all queries, one row a span."""
    return detection.language_spans(_runs(spark, sf), "id", "original_query").select("id", F.explode("spans").alias("s")).select("id", "s.*")


@_query("select id, list_distinct(regexp_extract_all(lower(coalesce(original_query, '')), '[a-z]+')).list_sort() as tokens from experiment_results")
def tokenize_lower(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("id", F.sort_array(tx.tokens_lower(F.col("original_query"))).alias("tokens"))


#: Blanks that Python strips, for SQL's trim.
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


@_query(f"""{DETECTED}, n as (select id, q, case pass when 0 then false when 1 then true else not (len(ls) = 1 and ls[1] = 'English') end as routed, trim(trim(trim(lower(q), {WS}), chr(39) || chr(34)), {WS}) as reply from det)
select id, case when routed and reply <> '' then reply else q end as normalized_query, coalesce(routed and reply <> '', false) as normalization_applied, coalesce(routed and reply = '', false) as error_fallback from n""")
def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).select("id", "original_query")
    return detection.normalize(rows, "original_query", str.lower).select("id", "normalized_query", "normalization_applied", "error_fallback")


_WORDS = {k: "[" + ", ".join(f"'{w}'" for w in words) + "]" for k, words in (("all", detection.TAMIL_WORDS + detection.HINDI_WORDS),)}["all"]


@_query(f"""{DETECTED}, c as (select det.*, e.mitigation_enabled, case e.id % 7 when 0 then 0 when 1 then 21 when 2 then null else e.id % 7 end as k,
  array_to_string(list_filter(str_split_regex(trim(e.original_query, {WS}), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: not list_contains({_WORDS}, trim(lower(x), '?.!,'))), ' ') as content from det join experiment_results e using (id)),
m as (select *, coalesce(case pass when 0 then false when 1 then true else len(ls) > 1 end, false) as mixed, case when pass = 0 then 'query must not be blank' when k not between 1 and 20 then 'top_k must be from 1 to 20' end as error,
  trim(trim(content, chr(39) || chr(34)), {WS}) as reply from c)
select id as request_id, case when error is null then mixed else false end as code_mix_detected, error is null and mixed and coalesce(mitigation_enabled, true) and reply <> '' and reply <> q as mitigation_applied, error,
  case when error is null then least(coalesce(k, 5), (select count(distinct chunk_id) from chunks)) else 0 end::int as n_hits from m""")
def chat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored query asked again by chat, with some bad numbers of hits."""
    k = F.col("id") % 7
    asked = _runs(spark, sf).select(F.col("id").alias("request_id"), F.col("original_query").alias("query"), "mitigation_enabled", F.when(k == 0, 0).when(k == 1, 21).when(k > 2, k).cast("int").alias("top_k"))
    made = rag.chat(asked, cut(rag.build_index(_chunks(spark, sf))), normalizer=detection.content_words)
    hits = F.when(F.col("error").isNull(), F.size("retrieved_document_ids")).otherwise(0)
    return made.select("request_id", "code_mix_detected", "mitigation_applied", "error", hits.alias("n_hits"))


@_query("select id, case when mitigation_enabled and mitigation_applied and trim(coalesce(normalized_query, '')) <> '' then normalized_query else original_query end as used_query from experiment_results")
def mitigation_routing(spark: SparkSession, sf: str) -> DataFrame:
    used = detection.routed_query(F.col("original_query"), F.col("mitigation_enabled"), F.col("normalized_query"), F.col("mitigation_applied"), F.lit(False))
    return _runs(spark, sf).select("id", used.alias("used_query"))


@_query("""with r as (select id, id % 6 as kind, round(faithfulness_score, 3) as s, faithfulness_score is null as none, isnan(faithfulness_score) as odd, faithfulness_explanation as e from experiment_results),
t as (select *, '{"faithfulness_score": ' || case when odd then 'NaN' else printf('%.3f', s) end || ', "explanation": "The ans' as broken from r),
v as (select *, case when none or kind = 4 then null when kind = 2 then case when odd or s < 0 then null else least(1.0, s) end when kind = 3 then case when odd then 1.0 else greatest(0.0, least(1.0, -s)) end
  else case when odd then 1.0 else greatest(0.0, least(1.0, s)) end end as score from t)
select id, score::double as score, score < 0.8 as hallucination,
case when none then 'Judge unavailable: empty response.' when kind = 4 then 'Judge response did not contain a score.' when kind = 2 and score is null then 'Judge unavailable: invalid JSON response.'
  when kind = 2 then '[Recovered from truncated judge response] ' || broken[1:200] else coalesce(e, 'No explanation provided.') end as explanation from v""")
def parse_judge(spark: SparkSession, sf: str) -> DataFrame:
    """A reply for every run: fenced, plain, broken off, with the score negated, without one, or quoted; none where no score is stored."""
    s, kind = F.col("faithfulness_score"), F.col("id") % 6
    number = F.when(F.isnan(s), F.lit("NaN")).otherwise(F.format_string("%.3f", F.round(s, 3)))
    negated = F.when(F.isnan(s), F.lit("NaN")).otherwise(F.format_string("%.3f", -F.round(s, 3)))
    tail = F.coalesce(F.concat(F.lit(', "explanation": '), F.substring(F.to_json(F.struct(F.col("faithfulness_explanation").alias("e"))), 6, 100_000)), F.lit("}"))
    tail = F.when(F.col("faithfulness_explanation").isNull(), F.lit("}")).otherwise(tail)
    head = F.lit('{"faithfulness_score": ')
    plain = F.concat(head, number, tail)
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(kind == 2, F.concat(head, number, F.lit(', "explanation": "The ans'))).when(kind == 3, F.concat(head, negated, tail))
        .when(kind == 4, F.lit('{"score": 1}')).when((kind == 5) & ~F.isnan(s), F.concat(head, F.lit('"'), number, F.lit('"'), tail)).otherwise(plain)
    )
    parsed = _runs(spark, sf).select("id", judging.parse_reply(F.when(s.isNotNull(), reply)).alias("p"))
    return parsed.select("id", "p.score", "p.hallucination", "p.explanation")


@_query("select id, len(original_query) as n from experiment_results where original_query is not null")
def query_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).filter("original_query is not null").select("id", F.length("original_query").cast("bigint").alias("n"))


# --- corpus ----------------------------------------------------------------------------------------------------


def _chunked(docs: str) -> str:
    """SQL of the chunks of ``docs`` (a query: document_id, text)."""
    last = " ".join(f"when strpos(r, reverse({b})) > 0 then length(w) - strpos(r, reverse({b})) + 1" for b in ("chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "'। '", "' '"))
    window = "substring(text, a + 101, 400)"
    return f"""with recursive d as ({docs}), t as (select document_id, trim(coalesce(text, ''), {WS}) as text from d),
cut as (
  select document_id, text, 0 as a, case when length(text) <= 500 then length(text) else 100 + coalesce((select case {last} end from (select substring(text, 101, 400) as w, reverse(substring(text, 101, 400)) as r)), 400) end as b from t where text <> ''
  union all
  select document_id, text, a, case when a + 500 >= length(text) then length(text) else a + 100 + coalesce((select case {last} end from (select {window} as w, reverse({window}) as r)), 400) end as b
  from (select document_id, text, b - 100 as a from cut where b < length(text))),
p as (select document_id, a::int as char_start, b::int as char_end, trim(substring(text, a + 1, b - a), {WS}) as chunk_text from cut),
made as (select *, (row_number() over (partition by document_id order by char_start) - 1)::int as chunk_index from p where chunk_text <> '')
select document_id || '_c' || chunk_index as chunk_id, document_id, chunk_index, chunk_text, char_start, char_end from made"""


#: SQL of the cleaned text; compatibility forms are left, which these tables don't have.
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, chr(12), chr(10), 'g'), '\r\n?', chr(10), 'g'),
  '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}\x{{2060}}]', '', 'g'), '(?m)^[ \t]*[-=_*~]{{5,}}[ \t]*$', '', 'g'), '[^\S\r\n]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {ws})"""
LATEST = "select document_id, max_by(text, (ingestion_timestamp, filename)) as text from source_documents group by 1"


@_query(_chunked(LATEST))
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(quality.latest_documents(_docs(spark, sf))).drop("metadata")


@_query("select document_id, max_by(title, (ingestion_timestamp, filename)) as title, max_by(filename, (ingestion_timestamp, filename)) as filename, max_by(metadata['domain'], (ingestion_timestamp, filename)) as domain, max_by(document_type, (ingestion_timestamp, filename)) as document_type from source_documents where trim(text) <> '' group by 1")
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What the first chunk of each document carries of it."""
    first = chunking.chunk_documents(quality.latest_documents(_docs(spark, sf))).filter("chunk_index = 0")
    return first.select("document_id", *(F.col("metadata")[c].alias(c) for c in ("title", "filename", "domain", "document_type")))


@_query(f"select document_id, ingestion_timestamp, {_CLEAN.format(c='text', ws=WS)} as text from source_documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("document_id", "ingestion_timestamp", tx.clean_text(F.col("text")).alias("text"))


def _as_files(df: DataFrame, key: Column, extension: str | Column, content: Column) -> DataFrame:
    """Rows as the scanned files that a loader gets."""
    extension = F.lit(f".{extension}") if isinstance(extension, str) else extension
    name = F.concat(key, extension)
    return df.select(name.alias("path"), name.alias("filename"), extension.alias("extension"), F.encode(content, "UTF-8").alias("content"))


@_query(f"""with c as (select document_id || '.txt' as filename, octet_length(encode(text)) as byte_size, {_CLEAN.format(c='text', ws=WS)} as text from source_documents)
select sha256(filename || ':')[1:16] as document_id, filename, 'txt' as document_type, split_part(text, chr(10), 1)[1:100] as title, text, byte_size::bigint as byte_size from c where text <> ''""")
def load_txt(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text as a text file, loaded again."""
    docs = _docs(spark, sf)
    loaded = files.documents(files.load_files(_as_files(docs, F.col("document_id"), "txt", F.col("text"))))
    return loaded.select("document_id", "filename", "document_type", "title", "text", F.col("metadata")["byte_size"].cast("bigint").alias("byte_size"))


@_query(f"""with s as (select document_id || '.json' as filename, document_type, trim(title, {WS}) as t, text as b, coalesce(metadata['domain'], '') as d from source_documents),
x as (select filename, unnest(['0', '1', '2']) as part, unnest([case when t <> '' and not contains(b, t) then t || chr(10) || chr(10) || b else b end, b, d]) as text,
  unnest([case when t <> '' then t else replace(filename, '.json', '') || ' #1' end, replace(filename, '.json', '') || ' #2', replace(filename, '.json', '') || ' Item 3']) as title, unnest([document_type, null, null]) as kept from s),
c as (select *, {_CLEAN.format(c='text', ws=WS)} as clean from x)
select sha256(filename || ':' || part)[1:16] as document_id, filename, title, clean as text, kept, part as "index" from c where clean <> ''""")
def load_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a JSON list, loaded again: with title and content, with a body alone, and its domain as plain text."""
    docs = _docs(spark, sf)
    content = F.concat_ws(",", F.to_json(F.struct("title", F.col("text").alias("Content"), "document_type")), F.to_json(F.struct(F.col("text").alias("body"))), F.concat(F.lit('"'), F.coalesce(F.col("metadata")["domain"], F.lit("")), F.lit('"')))
    loaded = files.documents(files.load_files(_as_files(docs, F.col("document_id"), "json", F.concat(F.lit("["), content, F.lit("]")))))
    return loaded.select("document_id", "filename", "title", "text", F.col("metadata")["document_type"].alias("kept"), F.col("metadata")["index"].alias("index"))


@_query(f"""with r as (select question_id || '.csv' as filename, unnest(['0', '1', '2']) as part, unnest([tamil_english, hindi_english, '']) as q, unnest([english, english, '']) as a, domain as d from query_records),
x as (select *, case when a = '' then 'DOMAIN: ' || d when q <> '' and not contains(a, q) then 'Question: ' || {_CLEAN.format(c='q', ws=WS)} || chr(10) || 'Answer: ' || a else a end as text from r),
c as (select *, {_CLEAN.format(c='text', ws=WS)} as clean from x)
select sha256(filename || ':' || part)[1:16] as document_id, filename, case when a <> '' and q <> '' then {_CLEAN.format(c='q', ws=WS)} else replace(filename, '.csv', '') || ' Row ' || (part::int + 1) end as title,
  clean as text, part as row_index, case when a <> '' then d end as domain from c where clean <> ''""")
def load_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Every question as a CSV file of three rows, loaded again: its two mixes with the English form, and a row that has only a domain."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    row = lambda q, a: F.concat_ws(",", quoted(q), quoted(a), quoted(F.col("domain")))
    content = F.concat_ws("\n", F.lit(" Question,ANSWER,DOMAIN"), row(F.col("tamil_english"), F.col("english")), row(F.col("hindi_english"), F.col("english")), row(F.lit(""), F.lit("")))
    loaded = files.documents(files.load_files(_as_files(_asked(spark, sf), F.col("question_id"), "csv", content)))
    return loaded.select("document_id", "filename", "title", "text", F.col("metadata")["row_index"].alias("row_index"), F.col("metadata")["DOMAIN"].alias("domain"))


@_query("""select question_id || case when difficulty is null then '.zip' else '.json' end as path, case when difficulty is null then 'UnreadableFile: unsupported file type: .zip' else 'UnreadableFile: malformed JSON' end as reason
from query_records where difficulty is null or category is null""")
def ingest_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Every question as a file: of a type without a reader where it has no difficulty, broken JSON where it has no category."""
    rows = _asked(spark, sf)
    content = F.when(F.col("category").isNull(), F.lit('{"text": ')).otherwise(F.to_json(F.struct(F.col("english").alias("text"))))
    extension = F.when(F.col("difficulty").isNull(), ".zip").otherwise(".json")
    failed = files.ingest_failures(files.load_files(_as_files(rows, F.col("question_id"), extension, content)))
    return failed.select("path", F.regexp_replace("reason", "(malformed JSON).*", "$1").alias("reason"))


@_query(_chunked(f"select sha256(document_id || '.txt:')[1:16] as document_id, {_CLEAN.format(c='text', ws=WS)} as text from ({LATEST})"))
def ingest_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Files to cleaned documents to chunks."""
    docs = quality.latest_documents(_docs(spark, sf))
    return chunking.chunk_documents(files.documents(files.load_files(_as_files(docs, F.col("document_id"), "txt", F.col("text"))))).drop("metadata")


@_query("""select question_id, english, tamil_english, case when difficulty in ('Easy', 'Hard') then 2 else 0 end as n, case when difficulty in ('Easy', 'Hard') then english end as first from query_records""")
def extract_fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    """A reply for every question, read again: fenced for easy ones, plain for hard ones, broken off for the others."""
    items = F.to_json(F.array(F.struct("english"), F.struct(F.col("tamil_english").alias("english"))))
    reply = (
        F.when(F.col("difficulty") == "Easy", F.concat(F.lit("Here it is:\n```json\n"), items, F.lit("\n```\nDone."))).when(F.col("difficulty") == "Hard", F.concat(F.lit(" "), items))
        .otherwise(F.concat(F.lit("```json\n"), F.substring(items, 1, 20)))
    )
    parsed = _asked(spark, sf).select("question_id", "english", "tamil_english", tx.fenced_items(reply, "struct<english string>").alias("i"))
    return parsed.select("question_id", "english", "tamil_english", F.size("i").alias("n"), F.try_element_at("i", F.lit(1))["english"].alias("first"))


def _written(document: str, _: str) -> str:
    """An offline provider of questions: two for a document, none for an eighth of the documents."""
    if document[:1] in "01":
        return "Sorry, nothing comes to mind."
    item = '{{"english": "What does {0} say?", "tamil_english": "{0} enna solludhu?", "hindi_english": "{0} kya kehta hai?", "difficulty": "Easy", "category": "c{1}"}}'
    return f"```json\n[{item.format(document, 1)}, {item.format(document, 2)}]\n```"


@_query("""with d as (select distinct document_id from source_documents where document_id[1] not in ('0', '1')), r as (select document_id, 2 * (row_number() over (order by document_id) - 1) as before from d)
select 'GEN-Q' || case when before + k < 10 then '0' else '' end || (before + k) as question_id, 'Mixed' as domain, 'What does ' || document_id || ' say?' as english, [document_id] as expected_document_ids, 'c' || k as category
from r, (select unnest([1, 2]) as k) x union all select question_id, domain, english, expected_document_ids, category from query_records""")
def generate_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions generated from every document, after the existing ones."""
    docs = quality.latest_documents(_docs(spark, sf))
    made = generation.with_existing(_asked(spark, sf), generation.generate_queries(docs, _written, "Mixed"))
    return made.select("question_id", "domain", "english", "expected_document_ids", "category")


@_query("select filename, count(distinct document_id) as documents, count(*) as rows from source_documents group by 1")
def documents_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return quality.documents_by_file(_docs(spark, sf))


@_query("select document_id, filename, ingestion_timestamp from source_documents where filename in ('fee_table.csv', 'branch_rules.txt', 'reading_room.pdf')")
def documents_of_files(spark: SparkSession, sf: str) -> DataFrame:
    return quality.of_files(_docs(spark, sf), ["fee_table.csv", "branch_rules.txt", "reading_room.pdf"]).select("document_id", "filename", "ingestion_timestamp")


@_query("""with f as (select filename, sha256(count(*)::varchar || ':' || sum(octet_length(encode(text)))) as sha from source_documents group by 1)
select count(*) as num_source_documents, sha256(string_agg(filename || ':' || sha, '' order by filename)) as corpus_hash from f""")
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered fold over the corpus's source files, each with a hash of its number of rows and bytes."""
    total = F.sum(F.octet_length("text").cast("bigint"))
    per_file = _docs(spark, sf).groupBy("filename").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), total.cast("string")), 256).alias("sha256"), total.alias("size_bytes"))
    return quality.corpus_manifest(per_file).select(F.col("num_source_documents").cast("bigint").alias("num_source_documents"), "corpus_hash")


CORPUS_GATES = """select 'empty chunks' as gate, case when count(*) filter (trim(coalesce(chunk_text, ''), E' \\n\\r\\t') = '') > 0 then 'FAIL' else 'PASS' end as status,
  count(*) filter (trim(coalesce(chunk_text, ''), E' \\n\\r\\t') = '') || ' of ' || count(distinct chunk_id) as finding from chunks
union all select 'index size', case when a <> b then 'FAIL' else 'PASS' end, 'chunks ' || a || ', indexed ' || b from (select count(distinct chunk_id) as a, count(distinct chunk_id) filter (chunk_index <> 1) as b from chunks)"""


@_query(CORPUS_GATES)
def corpus_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks against an index that lacks the second chunk of each document."""
    return gates.corpus_gates(_chunks(spark, sf), _chunks(spark, sf).filter("chunk_index <> 1"))


@_query("""select 'documents' as gate, case when e > 0 or n = 0 then 'FAIL' else 'PASS' end as status, e || ' empty of ' || n as finding from (select count(*) as n, count(*) filter (trim(coalesce(text, '')) = '') as e from source_documents)
union all select 'chunks', case when e > 0 or n = 0 then 'FAIL' else 'PASS' end, e || ' empty of ' || n from (select count(*) as n, count(*) filter (trim(coalesce(chunk_text, '')) = '') as e from chunks)""")
def processed_gates(spark: SparkSession, sf: str) -> DataFrame:
    return gates.processed_gates(_docs(spark, sf), _chunks(spark, sf))


REVIEW_OPEN = """select question_id, language_variant, case when upper(trim(coalesce(reviewer_1_decision, ''))) in ('', 'PENDING') or upper(trim(coalesce(reviewer_2_decision, ''))) in ('', 'PENDING') then 'reviewer decisions pending'
  when upper(trim(coalesce(adjudication_decision, ''))) in ('', 'PENDING') then 'adjudication decision pending' when trim(coalesce(final_approved_query_text, '')) = '' then 'missing final_approved_query_text' end as reason
from (select distinct * from human_query_review_sheet)"""


@_query(f"select * from ({REVIEW_OPEN}) where reason is not null")
def review_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return quality.review_incomplete(_sheet(spark, sf))


@_query("select document_id, ingestion_timestamp, sha256(filename || ':' || coalesce(title, ''))[1:16] as doc_key from source_documents")
def doc_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("document_id", "ingestion_timestamp", tx.document_id(F.col("filename"), F.coalesce("title", F.lit(""))).alias("doc_key"))


@_query("select question_id, language_variant, reviewer_1_id, reviewer_2_id, list_filter(list_transform(str_split(coalesce(expected_document_ids, ''), ';'), lambda x: trim(x)), lambda x: x <> '') as ids from human_query_review_sheet")
def parse_id_list(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf).select("question_id", "language_variant", "reviewer_1_id", "reviewer_2_id", tx.id_list(F.col("expected_document_ids"), ";").alias("ids"))


@_query("""select (select count(*) from source_documents) as documents, (select count(*) from source_documents where text is null or trim(text, E' \\n\\r\\t') = '') as empty_documents, count(*) as chunks,
count(*) filter (chunk_text is null or trim(chunk_text, E' \\n\\r\\t') = '') as empty_chunks, coalesce(round(avg(nullif(length(trim(chunk_text, E' \\n\\r\\t')), 0)), 4), 0.0) as avg_length,
coalesce(min(nullif(length(trim(chunk_text, E' \\n\\r\\t')), 0)), 0)::int as min_length, coalesce(max(length(trim(chunk_text, E' \\n\\r\\t'))), 0)::int as max_length from chunks""")
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dataset_stats(_docs(spark, sf), _chunks(spark, sf)).drop("document_types")


@_query("select document_type, count(*) as n from source_documents group by 1")
def doc_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.doc_type_counts(_docs(spark, sf))


@_query("""select distinct question_id, document_id from (select question_id, unnest(list_concat(expected_document_ids, ['no ' || domain])) as document_id from query_records) w
where document_id not in (select document_id from chunks)""")
def orphan_expected_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that expect one more document, which isn't there."""
    rows = _asked(spark, sf).withColumn("expected_document_ids", F.concat(F.coalesce("expected_document_ids", F.array().cast("array<string>")), F.array(F.concat(F.lit("no "), "domain"))))
    return quality.orphan_expected_ids(rows, _chunks(spark, sf))


GOLD = """with f as (select document_id, min_by(p, (chunk_index, p)) as piece from (select document_id, chunk_index, trim(replace(substring(chunk_text, 1, 160), chr(10), ' ')) as p from chunks) group by 1),
q as (select question_id, min(expected_document_ids) as ids from query_records group by 1),
w as (select question_id, unnest(ids) as document_id, unnest(range(len(ids))) as pos from q),
g as (select q.question_id, coalesce(string_agg(f.piece, ' | ' order by w.pos), 'Refer to target chunks') as evidence from q left join w using (question_id) left join f using (document_id) group by 1)"""


@_query(f"{GOLD} select * from g")
def gold_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gold_evidence(_asked(spark, sf), _chunks(spark, sf))


@_query(f"""{GOLD}, m as (select question_id, min(english) as english, min(tamil_english) as ta, min(hindi_english) as hi, min(domain) as domain, min(category) as category, min(expected_document_ids) as ids from query_records group by 1)
select m.question_id, unnest(['Tamil-English (Tanglish)', 'Hindi-English (Hinglish)']) as language_variant, unnest([ta, hi]) as code_mixed_query, english as english_reference_query, domain, category,
coalesce(array_to_string(ids, ';'), '') as expected_document_ids, evidence as gold_evidence_snippet, """ + ", ".join(f"'{'PENDING' if c.endswith('decision') else ''}' as {c}" for c in quality.REVIEW_FIELDS) + " from m join g using (question_id)")
def review_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return quality.review_sheet(_asked(spark, sf), _chunks(spark, sf))


@_query(f"""{GOLD}, m as (select question_id, min(domain) as domain, min(category) as category, min(tamil_english) as ta from query_records group by 1)
select question_id, coalesce(domain, 'General') as domain, coalesce(category, 'General') as category, evidence, ta as tamil_query, 'PENDING_HUMAN_BILINGUAL_REVIEW' as status, 'PENDING' as adjudication from m join g using (question_id)""")
def nested_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The nested benchmark, some of its fields laid flat."""
    made = quality.nested_benchmark(_asked(spark, sf), _chunks(spark, sf))
    return made.select("question_id", "domain", "category", F.col("gold_supporting_evidence").alias("evidence"), F.col("tamil_english.query").alias("tamil_query"), "tamil_english.status", F.col("tamil_english.adjudication.status").alias("adjudication"))


_DECIDED = "upper(trim(coalesce({c}, ''))) not in ('', 'PENDING')"


@_query(f"""select language_variant, count(*) as rows, count(*) filter ({_DECIDED.format(c='reviewer_1_decision')} and {_DECIDED.format(c='reviewer_2_decision')}) as both_decided, count(*) filter ({_DECIDED.format(c='adjudication_decision')}) as adjudicated
from (select distinct * from human_query_review_sheet) group by 1""")
def review_progress(spark: SparkSession, sf: str) -> DataFrame:
    return quality.review_progress(_sheet(spark, sf))


@_query(f"""with b as (select upper(trim(reviewer_1_decision)) as a, upper(trim(reviewer_2_decision)) as b from (select distinct * from human_query_review_sheet) where {_DECIDED.format(c='reviewer_1_decision')} and {_DECIDED.format(c='reviewer_2_decision')})
select count(*) as both_decided, count(*) filter (a = b) as matches, round(100 * avg((a = b)::int), 4) as percent from b""")
def reviewer_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reviewer_agreement(_sheet(spark, sf))


@_query(f"""with b as (select upper(trim(reviewer_1_decision)) as a, upper(trim(reviewer_2_decision)) as b from (select distinct * from human_query_review_sheet) where {_DECIDED.format(c='reviewer_1_decision')} and {_DECIDED.format(c='reviewer_2_decision')}),
t as (select count(*)::double as n, count(*) filter (a = b)::double as same from b),
c as (select sum(x * y)::double as chance from (select c, count(*) filter (s = 1) as x, count(*) filter (s = 2) as y from (select a as c, 1 as s from b union all select b, 2 from b) group by 1))
select n::bigint as n, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 4) as kappa from t, c""")
def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return quality.cohen_kappa(_sheet(spark, sf))


@_query("""with q as (select question_id, min(english) as english, min(tamil_english) as ta, min(hindi_english) as hi from query_records group by 1),
a as (select question_id, max(trim(final_approved_query_text)) filter (contains(language_variant, 'Tamil')) as nt, max(trim(final_approved_query_text)) filter (not contains(language_variant, 'Tamil')) as nh
  from human_query_review_sheet where trim(final_approved_query_text) <> '' group by 1)
select question_id, english, coalesce(nt, ta) as tamil_english, coalesce(nh, hi) as hindi_english from q left join a using (question_id)""")
def apply_review(spark: SparkSession, sf: str) -> DataFrame:
    q = _asked(spark, sf).groupBy("question_id").agg(*(F.min(c).alias(c) for c in ("english", "tamil_english", "hindi_english")))
    return quality.apply_review(q, _sheet(spark, sf))


@_query("""select 'question_id' as kind, question_id as value, count(*) as n from query_records group by 2 having count(*) > 1
union all select kind, value, count(*) from (select distinct question_id, unnest(['english', 'tamil_english', 'hindi_english']) as kind, lower(unnest([english, tamil_english, hindi_english])) as value from query_records) where value is not null group by 1, 2 having count(*) > 1""")
def duplicate_queries(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_queries(_asked(spark, sf))


@_query("select question_id, variant from (select question_id, unnest(['english', 'tamil_english', 'hindi_english']) as variant, unnest([english, case when category is not null then tamil_english else ' ' end, hindi_english]) as t from query_records) where t is null or trim(t, E' \\n\\r\\t') = ''")
def invalid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose Tamil-English form is blanked where they have no category."""
    rows = _asked(spark, sf).withColumn("tamil_english", F.when(F.col("category").isNotNull(), F.col("tamil_english")).otherwise(" \n\t"))
    return datasets.validate_queries(rows)


@_query("""select 'mock row' as "check", question_id as key from query_records where regexp_matches(upper(question_id), 'SMOKE|MOCK|TEST')
union all select 'missing question_id', '' from query_records where question_id is null or trim(question_id) = ''
union all select 'duplicate question_id', question_id from query_records where question_id is not null group by 2 having count(*) > 1
union all select 'blank ' || variant, question_id from (select question_id, unnest(['english', 'tamil_english', 'hindi_english']) as variant, unnest([english, tamil_english, hindi_english]) as t from query_records) where t is null or trim(t, E' \\n\\r\\t') = ''
union all select 'no expected documents', question_id from query_records where expected_document_ids is null or len(expected_document_ids) = 0
union all select 'expected document not indexed', question_id || ':' || document_id from (select distinct question_id, unnest(expected_document_ids) as document_id from query_records) where document_id not in (select document_id from chunks)""")
def preflight_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.preflight_violations(_asked(spark, sf), _chunks(spark, sf))


PRODUCTION = f"""{CORPUS_GATES} union all select 'dataset', case when n > 0 then 'FAIL' else 'PASS' end, n || ' violations' from (select count(*) as n from ({_SQL["preflight_violations"]}))
union all select 'review', case when n > 0 then 'BLOCKED' else 'PASS' end, n || ' rows incomplete' from (select count(*) as n from ({REVIEW_OPEN}) where reason is not null)
union all select 'runs', case when n = 0 then 'FAIL' else 'PASS' end, n || ' runs' from (select 6 * count(distinct question_id) as n from query_records)"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    return gates.production_gates(_asked(spark, sf), chunks, chunks.filter("chunk_index <> 1"), _sheet(spark, sf))


@_query(PRODUCTION)
def production_gates(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf)


@_query(f"select case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status = 'BLOCKED') then 'BLOCKED' else 'PASS' end as verdict from ({PRODUCTION})")
def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return gates.verdict(_gated(spark, sf))


@_query("""with t as (select count(*) as n, coalesce(sum(('0x' || sha256(chunk_id || ':' || document_id || ':' || chunk_text)[1:15])::hugeint), 0) as s from (select distinct chunk_id, document_id, chunk_text from chunks))
select n, sha256(n || ':' || s) as corpus_hash from t""")
def corpus_hash(spark: SparkSession, sf: str) -> DataFrame:
    return quality.corpus_hash(_chunks(spark, sf), "chunk_id", "document_id", "chunk_text")


@_query("select count(*) as n, count(distinct document_id) as n_unique from source_documents")
def unique_doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_unique"))


@_query("select document_id, max(ingestion_timestamp) as ingestion_timestamp from source_documents group by 1")
def latest_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quality.latest_documents(_docs(spark, sf)).select("document_id", "ingestion_timestamp")


@_query("select document_id, ingestion_timestamp, len(list_filter(str_split(text, chr(10)), lambda l: trim(l) <> '')) as lines from source_documents")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("document_id", "ingestion_timestamp", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("lines"))


# --- written and read again ------------------------------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid4().hex}/{name}"


@_query("select document_id, ingestion_timestamp, filename, title, text, metadata['domain'] as domain from source_documents")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as JSON lines, read again."""
    path = _place(spark, "documents")
    sinks.write_jsonl(_docs(spark, sf), path)
    return datasets.read_jsonl(spark, path).select("document_id", "ingestion_timestamp", "filename", "title", "text", F.col("metadata")["domain"].alias("domain"))


@_query("select question_id, domain, english, tamil_english, hindi_english, category, expected_document_ids, difficulty from query_records")
def query_dataset_json(spark: SparkSession, sf: str) -> DataFrame:
    """The query dataset as JSON lines under a .json name, loaded again: no line is lost."""
    path = _place(spark, "queries.json")
    sinks.export_json_lines(_asked(spark, sf), path)
    return datasets.load_queries(spark, path).select("question_id", "domain", "english", "tamil_english", "hindi_english", "category", "expected_document_ids", "difficulty")


@_query("select question_id, domain, english, category, list_filter(coalesce(expected_document_ids, []), lambda x: x <> '') as expected_document_ids from query_records")
def query_dataset_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The query dataset as CSV with ids separated by commas, loaded again."""
    path = _place(spark, "queries.csv")
    sinks.export_csv(_asked(spark, sf).withColumn("expected_document_ids", F.concat_ws(" , ", "expected_document_ids")), path)
    return datasets.load_queries(spark, path).select("question_id", "domain", "english", "category", "expected_document_ids")


@_query("select " + ", ".join(f"coalesce({c}, '') as {c}" for c in ("question_id", "language_variant", "code_mixed_query", *quality.REVIEW_FIELDS)) + " from human_query_review_sheet")
def review_sheet_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The review sheet as CSV, scanned again; empty cells are ''."""
    path = _place(spark, "sheet")
    sinks.export_csv(_sheet(spark, sf), path)
    return datasets.read_review_sheet(spark, path).select("question_id", "language_variant", "code_mixed_query", *quality.REVIEW_FIELDS)


@_query("select id, run_id, generated_answer, error, coalesce(retrieved_document_ids, []) as retrieved_document_ids from experiment_results where generated_answer <> ''")
def results_csv(spark: SparkSession, sf: str) -> DataFrame:
    """All runs with an answer exported as CSV, lists as JSON, and scanned again."""
    path = _place(spark, "results")
    sinks.export_csv(_runs(spark, sf).filter("generated_answer <> ''"), path)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return datasets.scan_results(raw).select(F.col("id").cast("bigint").alias("id"), "run_id", "generated_answer", "error", "retrieved_document_ids")


@_query("select distinct chunk_id, document_id, chunk_text from (select *, row_number() over (partition by chunk_id order by chunk_text) as k from chunks) where k = 1")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The index of all chunks, each once, saved and loaded again."""
    path = _place(spark, "index")
    once = _chunks(spark, sf).groupBy("chunk_id").agg(F.min(F.struct("chunk_text", "document_id")).alias("c")).select("chunk_id", "c.*")
    sinks.write_index(rag.build_index(once), path)
    return datasets.load_index(spark, path).select("chunk_id", "document_id", "chunk_text")


@_query("select condition_name, case when language = 'english' then 3 else 5 end::int as top_k from (select unnest(['english', 'tamil_english', 'hindi_english']) as language), (select unnest(['baseline', 'mitigated']) as side), lateral (select language || '_' || side as condition_name) x")
def insert_configs(spark: SparkSession, sf: str) -> DataFrame:
    """All six configurations inserted where the English ones are stored with another k: those stay."""
    made = ex.configs(spark)
    stored = made.filter("language = 'english'").select("experiment_id", F.lit(3).alias("top_k"))
    return stored.unionByName(ex.insert_or_ignore(made, stored, "experiment_id")).withColumnRenamed("experiment_id", "condition_name")


@_query("select run_id, count(*)::bigint as n from (select distinct run_id from experiment_results) group by 1")
def append_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All runs as a stream appended once each, and once more: nothing is added."""
    path = _place(spark, "stored")
    schema = _runs(spark, sf).schema
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/experiment_result[s].parquet")  # a pattern: file or folder
        incremental.append_new_runs(stream, path, _place(spark, f"log{k}")).awaitTermination()
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in three languages answered over the chunk corpus and judged."""
    return _answered(spark, sf_dir)


def queries() -> dict[str, Query]:
    """The core's queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the core's queries that SQL can express."""
    return dict(_SQL)
