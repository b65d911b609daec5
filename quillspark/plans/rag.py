"""Questions to judged answers as one DataFrame plan."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import Settings
from quillspark.functions.vectors import Encode, embedder, hashed_vectors, text_prefix
from quillspark.operators.detection import Detector, detect, normalize, routed_query
from quillspark.operators.experiment import TRANSIENT
from quillspark.operators.judging import parse_reply
from quillspark.operators.retrieval import top_k
from quillspark.tables import cut, spread

INSUFFICIENT = "The context does not answer this question."


def build_context(texts: Column) -> Column:
    """Numbered documents, a blank line between them."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("--- Document "), (i + 1).cast("string"), F.lit(" ---\n"), t)), "\n\n")


def build_prompt(query: Column, context: Column) -> Column:
    """What a generator is asked."""
    return F.concat(F.lit("Answer only from the context.\n\n<context>\n"), context, F.lit("\n</context>\n\nQuery: "), query, F.lit("\n"))


def prompt_hash(prompt: Column) -> Column:
    """SHA-256 of a prompt."""
    return F.sha2(prompt, 256)


def extractive_answer(query: str, context: str) -> str:
    """The offline generator: the sentence of the context that shares most words with the question."""
    wanted = {w for w in query.lower().split() if len(w) > 2}
    best, most = INSUFFICIENT, 1
    for line in context.split("\n"):
        for sentence in re.split(r"(?<!\bRs)\. ", line):
            n = len(wanted & set(sentence.lower().split()))
            if n > most and not line.startswith("--- Document"):
                best, most = sentence.strip(), n
    return best


def overlap_judge(answer: str, context: str) -> str:
    """The offline judge: the share of the answer's words that the context has, as a judge's JSON reply."""
    words = answer.lower().split()
    have = set(context.lower().split())
    score = sum(w in have for w in words) / len(words) if words else 0.0
    return f'{{"faithfulness_score": {score:.3f}, "explanation": "word overlap"}}'


@dataclass(frozen=True)
class Retry:
    """How often a provider is called, and the wait before the second call, doubled each time.

    ``only_transient``: errors without a sign that a later call may succeed aren't retried.
    """

    attempts: int = 1
    delay: float = 0.0
    only_transient: bool = True
    sleep: Callable[[float], None] = time.sleep

    def again(self, error: str, attempt: int) -> bool:
        """Waits and says yes where another call is due after ``attempt`` (from 0)."""
        if attempt + 1 >= self.attempts or self.only_transient and not any(t in error.lower() for t in TRANSIENT):
            return False
        self.sleep(self.delay * 2**attempt)
        return True


#: A generator is called again on transient errors, a judge on any.
GENERATOR_RETRY, JUDGE_RETRY = Retry(4, 2.0), Retry(3, 2.0, only_transient=False)


def called(call: Callable[[str, str], str], a: str, b: str, retry: Retry) -> tuple[str | None, str | None, int]:
    """(reply, error, calls) of a provider; an error that no retry mends gives a null reply."""
    for attempt in range(retry.attempts):
        try:
            return call(a, b), None, attempt + 1
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if not retry.again(error, attempt):
                break
    return None, error, attempt + 1


def _provider(call: Callable[[str, str], str], retry: Retry) -> Callable[[Column, Column], Column]:
    """An Arrow function (reply, error, calls, seconds); where the first argument is null nothing is called."""

    @F.pandas_udf("struct<text string, error string, calls int, seconds double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            began = time.perf_counter()
            reply = (None, None, 0) if x is None else called(call, x, y or "", retry)
            rows.append((*reply, round(time.perf_counter() - began, 3)))
        return pd.DataFrame(rows, columns=["text", "error", "calls", "seconds"])

    return run


#: Equal vectors are searched as one where at most this share of the index is distinct.
DISTINCT_SHARE = 0.8


def _hits(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query, chunk_id, score, rank: the best chunks of each question.

    Chunks with equal vectors have equal scores, so the first of them by key stands for all, and a hit of it is one of
    each of the k first.
    """
    vectors = index.filter("embedding is not null").select("chunk_id", "embedding", F.xxhash64("embedding").alias("h"))
    rows, distinct = vectors.agg(F.count("*"), F.count_distinct("h")).first()
    if distinct > DISTINCT_SHARE * rows:
        return top_k(asked, index, k, query_key="query", key="chunk_id")
    place = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("chunk_id"))
    alike = cut(vectors.withColumn("place", place).filter(F.col("place") <= k).groupBy("h", "embedding").agg(F.sort_array(F.collect_list("chunk_id")).alias("alike")).withColumn("chunk_id", F.col("alike")[0]))
    hits = top_k(asked, alike, k, query_key="query", key="chunk_id").join(alike.select("chunk_id", "alike"), "chunk_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id"))
    return hits.select("query", F.explode("alike").alias("chunk_id"), "score").withColumn("rank", rank).filter(F.col("rank") <= k)


def search(texts: DataFrame, index: DataFrame, k: int, model: str = Settings.embedding_model, encode: Encode = hashed_vectors) -> DataFrame:
    """query, hits: the best chunks for each distinct non-blank ``query``, best first.

    ``index``: chunk_id (unique), document_id, chunk_text, embedding.  Equal questions are embedded and searched once,
    and so are equal vectors where many are; texts are fetched for the chunks that were hit only, once each, after the
    search.
    """
    dim = int(index.sparkSession.conf.get("spark.quillspark.embedding_dim", None) or Settings.embedding_dim)
    asked = texts.select("query").filter(F.trim("query") != "").distinct().withColumn("embedding", embedder(dim, text_prefix(model, True), encode)(F.col("query")))
    hits = cut(_hits(asked, index, k))
    wanted = hits.select("chunk_id").distinct()
    texts = index.select("chunk_id", "document_id", F.col("chunk_text").alias("text")).join(wanted, "chunk_id", "left_semi")
    return hits.join(texts, "chunk_id").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "document_id", "text", "score"))).alias("hits"))


def retrieve(queries: DataFrame, index: DataFrame, key: str, query: str, k: int, model: str = Settings.embedding_model, encode: Encode = hashed_vectors) -> DataFrame:
    """key, hits: the best chunks of each question, best first; blank questions have none."""
    named = queries.select(F.col(key).alias("query_id"), F.col(query).alias("query"))
    return named.join(search(named, index, k, model, encode), "query").select(F.col("query_id").alias(key), "hits")


def build_index(chunks: DataFrame, dim: int = Settings.embedding_dim, model: str = Settings.embedding_model, encode: Encode = hashed_vectors) -> DataFrame:
    """Distinct chunks with their unit vectors."""
    distinct = spread(chunks.select("chunk_id", "document_id", "chunk_text")).dropDuplicates(["chunk_id"])
    return distinct.withColumn("embedding", embedder(dim, text_prefix(model, False), encode)(F.col("chunk_text")))


def index_of(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """An index of chunks and given vectors (chunk_id, embedding); a chunk without a vector, or the other way round, raises."""
    odd = chunks.select("chunk_id").distinct().join(vectors.select("chunk_id", "embedding"), "chunk_id", "full").filter("embedding is null").count()
    odd += vectors.join(chunks, "chunk_id", "left_anti").count()
    if odd:
        raise ValueError(f"{odd} chunks and vectors don't meet")
    return chunks.select("chunk_id", "document_id", "chunk_text").dropDuplicates(["chunk_id"]).join(vectors.select("chunk_id", "embedding"), "chunk_id")


def answer(
    queries: DataFrame,
    index: DataFrame,
    key: str = "query_id",
    query: str = "query",
    mitigation: Column | None = None,
    options: Settings | None = None,
    normalizer: Callable[[str], str] = lambda q: q,
    generate: Callable[[str, str], str] = extractive_answer,
    judge: Callable[[str, str], str] = overlap_judge,
    detector: Detector = detect,
    encode: Encode = hashed_vectors,
    mixed_only: bool = False,
    hits: Column | None = None,
    generator_retry: Retry = GENERATOR_RETRY,
    judge_retry: Retry = JUDGE_RETRY,
) -> DataFrame:
    """One row a question: detection, the query searched, hits, answer, score, hallucination.

    ``hits``: how many of the ``top_k`` hits a question uses, all if null; ``mixed_only``: only code-mixed questions are
    normalized.  A provider that still fails after its retries gives a null answer or score and an error, never a lost
    row: an unavailable judge is no hallucination.
    """
    options = options or Settings()
    on = F.lit(options.mitigation_enabled) if mitigation is None else mitigation
    # written, so that the normalizer, a service as a rule, is called once a question
    routed = cut(normalize(queries, query, normalizer, mixed_only, detector).withColumn("used_query", routed_query(F.col(query), on, F.col("normalized_query"), F.col("normalization_applied"), F.col("error_fallback"))))
    found = search(routed.select(F.col("used_query").alias("query")), index, options.top_k, options.embedding_model, encode)
    rows = routed.join(found.withColumnRenamed("query", "used_query"), "used_query", "left")
    if hits is not None:
        rows = rows.withColumn("hits", F.slice("hits", 1, F.coalesce(hits, F.lit(options.top_k))))
    rows = rows.withColumn("context", F.coalesce(build_context(F.transform("hits", lambda h: h["text"])), F.lit("")))
    rows = rows.withColumn("generated", _provider(generate, generator_retry)(F.col("used_query"), F.col("context")))
    rows = rows.withColumn("reply", _provider(judge, judge_retry)(F.col("generated.text"), F.col("context")))
    judged = parse_reply(F.col("reply.text"), options.hallucination_threshold)
    explained = F.when(F.col("reply.error").isNotNull(), F.concat(F.lit("Judge unavailable: "), F.col("reply.error"))).otherwise(F.col("judged.explanation"))
    return rows.withColumn("judged", judged).select(
        key, query, F.col("normalized_query"), (F.col("used_query") != F.col(query)).alias("mitigation_applied"), F.col("detection.is_code_mixed").alias("is_code_mixed"), F.col("detection.languages").alias("languages"), "used_query",
        F.transform("hits", lambda h: h["chunk_id"]).alias("retrieved_document_ids"), F.col("context").alias("retrieved_context"), F.col("generated.text").alias("generated_answer"),
        F.coalesce("generated.error", "reply.error").alias("error"), F.col("judged.score").alias("faithfulness_score"), F.col("judged.hallucination").alias("hallucination_flag"),
        explained.alias("faithfulness_explanation"), F.round(F.col("generated.seconds") + F.col("reply.seconds"), 3).alias("latency"),
    )


#: Hits that one request may ask for.
MOST_HITS = 20


def chat(requests: DataFrame, index: DataFrame, key: str = "request_id", query: str = "query", options: Settings | None = None, **providers: object) -> DataFrame:
    """Interactive requests (key, query, mitigation_enabled, top_k) answered and judged, nothing stored.

    Only code-mixed questions are normalized.  ``top_k`` null is the setting's; outside 1 to ``MOST_HITS``, and for a
    blank query, the row has an error and no answer.  No more hits are searched than the most that a valid request asks
    for.  Errors name their stage.
    """
    options = options or Settings()
    bad = F.when(F.coalesce(F.trim(F.col(query)), F.lit("")) == "", "query must not be blank").when(~F.col("top_k").between(1, MOST_HITS), f"top_k must be from 1 to {MOST_HITS}")
    asked = requests.withColumn("_bad", bad).withColumn(query, F.when(F.col("_bad").isNull(), F.col(query)).otherwise(""))
    wanted = F.coalesce("top_k", F.lit(options.top_k))
    most = requests.filter(bad.isNull()).agg(F.max(wanted)).first()[0] or 1
    made = answer(asked, index, key, query, F.coalesce("mitigation_enabled", F.lit(True)), replace(options, top_k=min(most, MOST_HITS)), mixed_only=True, hits=wanted, **providers)
    rows = made.drop(query).join(requests.select(key, query, "mitigation_enabled", bad.alias("_bad")), key)
    staged = F.coalesce("_bad", F.when(F.col("generated_answer").isNull(), F.concat(F.lit("Generation failed: "), "error")))
    return rows.select(
        key, F.when(staged.isNull(), F.col("generated_answer")).otherwise("").alias("answer"), F.col(query).alias("original_query"), F.when(F.col("mitigation_applied"), F.col("normalized_query")).alias("normalized_query"),
        F.col("is_code_mixed").alias("code_mix_detected"), F.col("languages").alias("detected_languages"), "mitigation_enabled", "mitigation_applied", "retrieved_document_ids",
        *(F.when(staged.isNull(), F.col(c)).alias(c) for c in ("faithfulness_score", "hallucination_flag", "faithfulness_explanation")), "latency", staged.alias("error"),
    )
