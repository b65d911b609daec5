"""Two-pass detection of code-mixed questions, and when they are normalized."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank, stripped, tokens_lower
from quillspark.schemas import SPAN

# Romanized words that mark a question as mixed.
TAMIL_WORDS = (
    "ennoda", "enakku", "naan", "neenga", "avan", "aval", "avanga", "namma", "eppadi", "eppo", "enna", "enga", "ethu", "yaarku", "panrathu", "panrom",
    "pannu", "sollu", "sollunga", "paarunga", "theriyuma", "iruku", "irukkum", "varum", "poiduchu", "aagum", "seiyalam", "aana", "illa", "illama",
    "aachu", "kita", "kku", "oda", "la", "ku", "panna", "evlo", "kudukanum", "venuma",
)
HINDI_WORDS = (
    "mere", "mera", "meri", "mujhe", "humara", "aap", "tum", "unka", "unke", "kaise", "kab", "kahan", "kyun", "kya", "kaisa", "karu", "karna",
    "karein", "karo", "kar", "hain", "hai", "tha", "thi", "chahiye", "milega", "milegi", "sakta", "sakti", "chahta", "par", "mein", "se", "ko", "ka",
    "ki", "ke", "liye", "bhi", "aur",
)
ROMANIZED, MIXED, PLAIN = 0.85, 0.95, 0.70


def detect(query: Column) -> Column:
    """struct<is_code_mixed, languages, confidence>, all in the JVM.

    A Romanized word of the lexicons decides; else the scripts of the words do.  Blank and null are Unknown.
    """
    has = lambda words: F.arrays_overlap(tokens_lower(query), F.array(*map(F.lit, words)))
    tamil, hindi = has(TAMIL_WORDS), has(HINDI_WORDS)
    words = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    devanagari, tamil_script = r"[\x{0900}-\x{097F}]", r"[\x{0B80}-\x{0BFF}]"
    some = lambda test: F.exists(words, test)
    scripts = F.array_compact(F.array(
        F.when(some(lambda w: w.rlike("[a-zA-Z]") & ~w.rlike(devanagari) & ~w.rlike(tamil_script)), F.lit("English")),
        F.when(some(lambda w: w.rlike(devanagari)), F.lit("Hindi")), F.when(some(lambda w: w.rlike(tamil_script) & ~w.rlike(devanagari)), F.lit("Tamil")),
    ))
    scripts = F.when(F.size(scripts) == 0, F.array(F.lit("Unknown"))).otherwise(scripts)
    romanized = F.array_compact(F.array(F.lit("English"), F.when(tamil, F.lit("Tamil")), F.when(hindi, F.lit("Hindi"))))
    out = lambda mixed, languages, sure: F.struct(mixed.alias("is_code_mixed"), languages.alias("languages"), sure.alias("confidence"))
    return (
        F.when(is_blank(query), out(F.lit(False), F.array(F.lit("Unknown")), F.lit(1.0)))
        .when(tamil | hindi, out(F.lit(True), romanized, F.lit(ROMANIZED)))
        .otherwise(out(F.size(scripts) > 1, scripts, F.when(F.size(scripts) > 1, MIXED).otherwise(PLAIN)))
    )


_RUN = re.compile(r"[\p{L}\p{N}_]+")


def spans_of(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, language, text) of the runs of words in one script; a word without a known script ends a run."""
    out: list[tuple[int, int, str, str]] = []
    for m in _RUN.finditer(text):
        word = m[0]
        language = "Hindi" if re.search("[ऀ-ॿ]", word) else "Tamil" if re.search("[஀-௿]", word) else "English" if re.search("[a-zA-Z]", word) else "Unknown"
        start = out.pop()[0] if out and out[-1][2] == language else m.start()
        out.append((start, m.end(), language, text[start : m.end()]))
    return out


def language_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, spans: none for questions with a Romanized word or without text; offsets are code points."""
    romanized = F.arrays_overlap(tokens_lower(F.col(text)), F.array(*map(F.lit, TAMIL_WORDS + HINDI_WORDS)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "spans": [[dict(zip(("start", "end", "language", "text"), s, strict=True)) for s in spans_of(t)] if t else [] for t in b["text"]]})

    rows = df.select(F.col(key).alias("key"), F.when(~romanized, F.col(text)).alias("text"))
    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, spans {SPAN}").withColumnRenamed("key", key)


def needs_normalization(detection: Column) -> Column:
    """Everything but plain English: questions in one native script are sent, too."""
    return ~(~detection["is_code_mixed"] & (F.size(detection["languages"]) == 1) & (detection["languages"][0] == "English"))


Normalizer = Callable[[str], str]
#: A detector: a question's column to struct<is_code_mixed, languages, confidence>.
Detector = Callable[[Column], Column]


def normalize(df: DataFrame, query: str, normalizer: Normalizer, mixed_only: bool = False, detector: Detector = detect) -> DataFrame:
    """Adds ``detection``, ``normalized_query``, ``normalization_applied``, ``error_fallback``.

    Only routed rows reach the provider.  An empty reply or an error keeps the question and sets the fallback;
    ``mixed_only`` is the interactive variant, which leaves single-script questions alone.
    """

    @F.pandas_udf("struct<text string, failed boolean>")
    def call(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, False))
                continue
            try:
                reply = (normalizer(t) or "").strip().strip("\"'").strip()
            except Exception:
                reply = ""
            rows.append((reply or t, not reply))
        return pd.DataFrame(rows, columns=["text", "failed"])

    d = df.withColumn("detection", detector(F.col(query)))
    routed = F.col("detection.is_code_mixed") if mixed_only else needs_normalization(F.col("detection"))
    d = d.withColumn("_routed", routed & ~is_blank(F.col(query))).withColumn("_reply", call(F.when(F.col("_routed"), F.col(query))))
    return d.select("*", F.coalesce("_reply.text", F.col(query)).alias("normalized_query"), (F.col("_routed") & ~F.col("_reply.failed")).alias("normalization_applied"), (F.col("_routed") & F.col("_reply.failed")).alias("error_fallback")).drop("_routed", "_reply")


def content_words(query: str) -> str:
    """The offline normalizer: the question without the Romanized words of the lexicons; '' if nothing is left."""
    drop = {*TAMIL_WORDS, *HINDI_WORDS}
    return " ".join(w for w in query.split() if w.lower().strip("?.!,") not in drop)


def routed_query(query: Column, mitigation: Column, normalized: Column, applied: Column, fallback: Column) -> Column:
    """The query that is searched: the normalized one if mitigation is on and it was applied without falling back."""
    return F.when(mitigation & applied & ~fallback & (stripped(F.coalesce(normalized, F.lit(""))) != ""), normalized).otherwise(query)
