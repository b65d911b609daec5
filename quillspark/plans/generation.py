"""Questions for a query dataset, written by a provider from the corpus's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import fenced_items
from quillspark.plans.rag import GENERATOR_RETRY, Retry, _provider
from quillspark.schemas import QUERY_RECORD
from quillspark.tables import cut

_ITEM = "struct<english string, tamil_english string, hindi_english string, difficulty string, category string>"


def question_prompt(document: Column, text: Column) -> Column:
    """What a provider is asked for one document."""
    task = "Write four questions that this text answers, each in English, Romanized Tamil-English and Romanized Hindi-English, with difficulty and category, as a JSON array."
    return F.concat(F.lit("Document "), document, F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit(f"\n\n{task}"))


def generate_queries(docs: DataFrame, provider: Callable[[str, str], str], domain: str, prefix: str = "GEN-Q", first: int = 1, retry: Retry = GENERATOR_RETRY) -> DataFrame:
    """Query records that ``provider(document_id, prompt)`` writes for each document, numbered by document and place.

    A reply may be fenced; one that can't be read, or an error, gives no questions.  The provider runs once, its
    replies are written; only the number of questions a document is ordered, never texts.
    """
    replies = docs.select("document_id", _provider(provider, retry)(F.col("document_id"), question_prompt(F.col("document_id"), F.col("text"))).alias("r"))
    items = cut(replies.select("document_id", fenced_items(F.col("r.text"), _ITEM).alias("items")).filter(F.size("items") > 0))
    before = F.coalesce(F.sum("n").over(Window.orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = items.groupBy("document_id").agg(F.sum(F.size("items")).alias("n")).select("document_id", before.alias("before"))
    rows = items.join(starts, "document_id").select("document_id", "before", F.posexplode("items").alias("pos", "i"))
    made = rows.select(
        F.concat(F.lit(prefix), F.format_string("%02d", F.col("before") + F.col("pos") + first)).alias("question_id"), F.lit(domain).alias("domain"), "i.english", "i.tamil_english", "i.hindi_english",
        F.lit("Romanized").alias("script_type"), "i.category", F.array("document_id").alias("expected_document_ids"), "i.difficulty",
    )
    return made.select(*[c.split(" ")[0] for c in QUERY_RECORD.replace("array<string>", "array").split(", ")])


def with_existing(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """The query dataset with the generated records after the existing ones, none dropped."""
    return existing.unionByName(generated, allowMissingColumns=True)
