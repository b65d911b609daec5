"""Reading a judge's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank, stripped

# Messages of the judge.
NO_EXPLANATION = "No explanation provided."
RECOVERED = "[Recovered from truncated judge response] "


def parse_reply(reply: Column, threshold: float = 0.8) -> Column:
    """struct<score, hallucination, explanation> of a reply in JSON, fenced or not.

    A reply that can't be read gives nulls, never 0: an unavailable judge is no hallucination.  Scores are clamped to
    [0, 1], NaN to 1; broken JSON yields the score if it still shows.
    """
    body = stripped(F.regexp_replace(F.regexp_replace(stripped(reply), "^```(?:json)?", ""), "```$", ""))
    # bare NaN and Infinity are no JSON; clamped, they are 1
    body = F.regexp_replace(body, r'("faithfulness_score"\s*:\s*)(?:NaN|Infinity)\b', "$11.0")
    tree = F.try_parse_json(body)
    raw = F.try_variant_get(tree, "$.faithfulness_score", "string")
    has = F.get_json_object(body, "$.faithfulness_score").isNotNull()
    number = raw.try_cast("double")
    found = F.regexp_extract(reply, r'"faithfulness_score"\s*:\s*([0-9]*\.?[0-9]+)', 1)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    out = lambda s, e: F.struct(s.cast("double").alias("score"), (s < threshold).alias("hallucination"), e.alias("explanation"))
    none = F.lit(None).cast("double")
    return (
        F.when(is_blank(reply), out(none, F.lit("Judge unavailable: empty response.")))
        .when(tree.isNotNull() & has & number.isNotNull(), out(clamp(number), F.coalesce(F.try_variant_get(tree, "$.explanation", "string"), F.lit(NO_EXPLANATION))))
        .when(tree.isNotNull() & ~has, out(none, F.lit("Judge response did not contain a score.")))
        .when(tree.isNotNull(), out(none, F.lit("Judge unavailable: invalid response value.")))
        .when(found != "", out(clamp(found.try_cast("double")), F.concat(F.lit(RECOVERED), F.substring(reply, 1, 200))))
        .otherwise(out(none, F.lit("Judge unavailable: invalid JSON response.")))
    )
