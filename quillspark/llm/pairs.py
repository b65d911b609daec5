"""Problem 3: prompt and response pairs whose response is no proper answer.

Shortened versions show when responses are sorted: what a response breaks off is there in its neighbour.  Two
texts that happen to differ in a name or an amount would never be neighbours, so the closing unit of each response
(its last sentence or its list) is sorted with names, codes and digits masked: all beginnings of a complete unit
stand right before it.  A unit that also occurs complete is whole, with or without its full stop.  Where sorting
knows no longer version, its ending decides: how often its last words end a unit at all, as a share of their
occurrences, and whether its last word only begins a known one, which sorting the words tells.  Lengths at which one
generator's responses pile up mark a length limit.  Copy, refusal, error and language rules follow; the language is
told by characters (:mod:`quillspark.llm.tongues`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.tongues import Tongues, words_of
from quillspark.llm.unify import plain_text
from quillspark.tables import cut, spread

# What stands for no answer, as letters and digits in lower case.
PLACEHOLDERS = ["", "na", "none", "null", "nil", "nan", "undefined", "noanswer", "noresponse", "noreply", "empty", "blank", "tbd", "todo", "answer"]

# How failure messages of a service begin.
ERROR_TEXT = (
    r"^\W*(?:(?:an? )?(?:unexpected |internal )?(?:exception|error) (?:has )?occurred\b|error code: ?\d|traceback \(most recent call last\)"
    r"|internal server error|bad gateway|service unavailable|gateway time-?out|too many requests|rate limit (?:reached|exceeded)"
    r"|model has been decommissioned|(?:http(?:/\d\.\d)?|status|error)[ :]+(?:code )?[45]\d\d\b|[a-z.]*(?:error|exception|timeout): )"
)

# Declining to answer, in the first person or of the material given.
REFUSAL = (
    r"\bi(?:'m| am)? (?:sorry|afraid)\b.*\b(?:can't|cannot|unable|not able|don't|won't)\b"
    r"|\bi (?:can't|cannot|can not|couldn't|could not|won't|will not|must decline|must refuse|have to (?:refuse|decline|pass)|do not|don't|did not|didn't|would rather not|am not|am unable|am in no|have no|lack|find no|found no)\b"
    r"|\b(?:context|passages?|sources?|(?:supplied|retrieved|given|provided) text|excerpts?|material)\b.*\b(?:does not|do not|don't|doesn't|lacks?|unrelated|insufficient|silent|nothing|impossible|not mention(?:ed)?|not contain|not possible)\b"
    r"|\bno (?:answer|relevant [a-z]+|information)\b.*\b(?:derived|found|given|available)\b|\bnothing relevant\b|\binsufficient (?:detail|information|context)"
    r"|\b(?:cannot|can't|can not|not) be (?:answered|determined)\b|\bno idea\b|\boutside (?:what i|my|the scope)|\bbeyond my\b"
    r"|\bas an? (?:ai|assistant|language model)\b|\bi(?:'m| am) (?:only|just|merely) an?\b|\bnot (?:be )?(?:right|appropriate|proper|possible|suitable|safe)\b[^.]*\bfor me\b|\b(?:i|something) .*\b(?:refuse|decline)\b|\bnot (?:able|allowed|permitted) to (?:answer|help|discuss)\b"
)

# Brackets; one left open breaks off.
BRACKETS = ("()", "[]", "{}")
#: Nats by which another language must be likelier than English.
FOREIGN_MARGIN = 2.0
#: Last words that end a unit in a lesser share of their occurrences are no ending; the share of the shorter context counts as so many occurrences.
ENDING_SHARE, BACK_OFF = 0.01, 1.0
#: Length limit: so many responses of a generator have a length, so many times as many as either side of it has on average, over so many lengths.
MIN_SPIKE, SPIKE_FACTOR, SPIKE_REACH = 20, 5.0, 10
#: Share that those at a limit have of all that reach it.
LIMIT_SHARE = 0.2

_ERROR = re.compile(ERROR_TEXT, re.I)
_REFUSAL = re.compile(REFUSAL)
_APOLOGY = re.compile(r"\W*(?:(?:i'm |i am |we are |we're )?sorry|apologies|my apologies|unfortunately|regrettably)\W*")
#: Quotations, whose language doesn't count.
_QUOTED = re.compile("\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|(?<!\\w)'[^'\n]*'(?!\\w)")
_ASKED = re.compile(r"\s*(?:(?:the )?(?:user'?s? )?(?:original )?(?:question|query|you asked|q)(?: was| is)?\s*[:\-]\s*)", re.I)
_CLOSED = re.compile(r"[.!?।。…؟]['\")\]”’»*]*$")
_CUT_LOOK = re.compile(r"(?:…|\.\.\.)['\"”’)]*$|(?:^|\n)\s*\d{1,2}[.)]$")
_DANGLING = re.compile(r"[,;:(\[–—-]$|(?:^|\n)\s*[-*•]$")
_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])(?:\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?।。]['\")”’]?)(?<!\b(?:Rs|No|Mr|Ms|Dr)\.) +(?=[\p{Lu}\p{Lo}\"“'])")
_LETTER, _NATIVE = re.compile(r"\p{L}"), re.compile(r"(?!\p{Latin})\p{L}")
_NAME = re.compile(r"\p{Lu}[\p{L}'’]+")
_NOT_LETTERS = re.compile(r"[^\p{L}\p{N}\p{M}]+")
_MASKS = [(re.compile(x), y) for x, y in ((r"Rs\.\s*", "rs "), (r"\d", "9"), (r"\b\p{Lu}{2}-(?=9|$)", "@-"), (r"(?<=[\p{Ll}9%,;:.@] )\p{Lu}[\p{L}'’]*(?:[ -]\p{Lu}[\p{L}'’]*)*(?= )", "@"), (r"\s+", " "), (r"[.!?।。]['\")\]”’]*$", ""))]


def _letters(text: str | None) -> str:
    """Letters, digits and marks in lower case, the rest dropped."""
    return _NOT_LETTERS.sub("", text.lower()) if text else ""


def masked(unit: str) -> str:
    """A sentence or list without what differs by chance: digits, codes, and names between the first and the last word; no closing mark."""
    unit = unit.strip()
    for pattern, by in _MASKS:
        unit = pattern.sub(by, unit)
    return unit


def units_of(text: str) -> list[str]:
    """Sentences of a text; consecutive items of a list are one unit."""
    out: list[str] = []
    in_list = False
    for line in text.split("\n"):
        if not line.strip():
            continue
        if _ITEM.match(line):
            if in_list:
                out[-1] += "\n" + line
            else:
                out.append(line)
            in_list = True
        else:
            out += _SENTENCE.split(line)
            in_list = False
    return out


def _is_empty(raw: str | None, seen: str) -> bool:
    letters = _letters(seen)
    return not raw or letters in PLACEHOLDERS or seen.strip()[:1] in "[(<{" and len(letters) < 24 and not re.sub("answer|none|null|empty|blank|response|reply|given|available|text|no", "", letters)


def _is_error(answer: str, letters: str, error: str | None) -> bool:
    if _ERROR.match(answer):
        return True
    key = _letters(error)
    return len(key) > 8 and letters.endswith(key) and len(letters) - len(key) < 40


def _is_foreign(body: str, tongues: Tongues | None) -> bool:
    """Not English, quotations aside: mostly in another script, or likelier another language by its characters."""
    said = _QUOTED.sub(" ", body)
    native = len(_NATIVE.findall(said))
    if native and 2 * native > len(_LETTER.findall(said)):
        return True
    return tongues is not None and tongues.english_margin(words_of(said)) < -FOREIGN_MARGIN


def judge(prompt: str | None, other: str | None, raw: str | None, error: str | None, tongues: Tongues | None = None) -> tuple[str | None, str]:
    """(defect that shows in this row alone, or None; the response without a repeated question before it).

    Without ``tongues`` only another script tells another language.
    """
    answer = (plain_text(raw) or "").replace("’", "'").replace("‘", "'").strip()
    if _is_empty(raw, answer):
        return "empty", ""
    letters = _letters(answer)
    if _is_error(answer, letters, error):
        return "error_text", ""
    prompt, other = (plain_text(prompt) or "").strip(), (plain_text(other) or "").strip()
    bare = answer[m.end() :] if (m := _ASKED.match(answer)) else answer
    p, q, asked = _letters(prompt), _letters(other), _letters(bare)
    for x in (p, q):
        if x and (asked in (x, x + x) or letters in (x, x + x)):
            return "copied_question", ""
    if p and q and asked in (p + q, q + p):
        return "copied_question", ""
    body = bare
    for x in (prompt, other):
        if x and bare.startswith(x) and _letters(rest := bare[len(x) :]):
            body = rest.lstrip(" \n?!.:;,") or bare
            break
    parts = [u.lower() for u in units_of(body)[:2]]
    if _REFUSAL.search(parts[0]) or len(parts) > 1 and _APOLOGY.fullmatch(parts[0]) and _REFUSAL.search(parts[1]):
        return "refusal", ""
    return ("other_language", "") if _is_foreign(body, tongues) else (None, body)


_ROW = "id {key}, generator string, defect string, size int, cut_look boolean, unit string, dangling boolean, whole array<string>, names array<string>"


def _judged(batches: Iterator[pd.DataFrame], tongues: Tongues | None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for p, q, a, e in zip(batch["p"], batch["q"], batch["a"], batch["e"], strict=True):
            defect, body = judge(p, q, a, e, tongues)
            unit, cut_look, dangling, whole, names = None, False, False, None, None
            if defect is None:
                text = body.strip()
                parts = units_of(text)
                closed = bool(_CLOSED.search(text))
                cut_look = bool(_CUT_LOOK.search(text))
                keys = [masked(u) for u in parts]
                if closed or cut_look:
                    whole = keys[:-1] if cut_look else keys
                else:
                    unit, dangling = keys[-1], bool(_DANGLING.search(text)) or any(parts[-1].count(a) > parts[-1].count(b) for a, b in BRACKETS)
                    whole = keys if _ITEM.match(parts[-1]) and not dangling else keys[:-1]
                names = list({n for u in parts[: len(parts) - (unit is not None)] for n in _NAME.findall(u)})
            rows.append((defect, len(a or ""), cut_look, unit, dangling, whole, names))
        out = pd.DataFrame(rows, columns=["defect", "size", "cut_look", "unit", "dangling", "whole", "names"])
        out.insert(0, "id", batch["id"].to_numpy())
        out.insert(1, "generator", batch["generator"].to_numpy())
        yield out


def _beginnings(keys: DataFrame) -> DataFrame:
    """Of ``keys`` (distinct: unit, complete), the incomplete units that begin a longer complete one.

    A range-partitioned sort brings each beginning before the units that continue it.  Partitions are read from
    their end, carrying the next complete unit; across partition borders it comes from the heads, one row a
    partition, which is all that reaches the driver.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(keys.repartitionByRange(n, "unit").withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.desc("unit")))
    heads = {r.part: r.head for r in ordered.filter("complete").groupBy("part").agg(F.min("unit").alias("head")).collect()}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        following = later = None  # the next two complete units
        for k, batch in enumerate(batches):
            if k == 0 and len(batch):
                own = batch["part"].iloc[0]
                following = next((heads[p] for p in sorted(heads) if p > own), None)
            found = []
            for unit, complete in zip(batch["unit"], batch["complete"], strict=True):
                if complete:
                    if unit != following:
                        following, later = unit, following
                else:
                    longer = later if following == unit else following
                    found.append((unit, longer is not None and longer.startswith(unit)))
            yield pd.DataFrame(found, columns=["unit", "shortened"])

    return ordered.mapInPandas(scan, "unit string, shortened boolean")


def _endings(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of units (unit, n): how often each pair of words, and each word, occurs, and how often it ends a unit.

    Units are counted before they are taken into words, so what is spread out is one row a distinct unit's word.
    """
    words = _last_words(F.col("unit"))
    long = units.select("n", words.alias("w")).select("n", F.size("w").alias("m"), F.posexplode("w").alias("at", "word"), F.col("w").alias("w"))
    pairs = long.select("n", F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).otherwise("").alias("before"), "word", (F.col("at") == F.col("m") - 1).alias("last"))
    count = [F.sum("n").alias("seen"), F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).alias("ends")]
    by_pair = cut(pairs.groupBy("before", "word").agg(*count))
    return by_pair, by_pair.groupBy("word").agg(F.sum("seen").alias("word_seen"), F.sum("ends").alias("word_ends"))


def _last_words(unit: Column) -> Column:
    return F.split(F.regexp_replace(unit, "[,;:]", ""), " ")


def _broken(complete: DataFrame, open_units: DataFrame, names: DataFrame) -> DataFrame:
    """(unit, why) of the open units (unit, n) that break off: ``shortened``, ``part of a word`` or ``no ending``.

    ``complete``: unit, n; ``names``: the words that masking hides.
    """
    # A list never counts as complete by itself: only a longer one can tell.
    as_whole = complete.filter(~F.col("unit").rlike(_LIST))
    unknown = cut(open_units.join(as_whole.select("unit"), "unit", "left_anti"))
    shortened = _beginnings(complete.select("unit", F.lit(True).alias("complete")).unionByName(unknown.select("unit", F.lit(False).alias("complete"))))

    items = lambda df, stop: df.filter(F.col("unit").rlike(_LIST)).select(F.explode(F.slice(F.split("unit", _NEXT_ITEM), 1, stop)).alias("unit"), "n")
    closed_items = items(complete, F.greatest(F.size(F.split("unit", _NEXT_ITEM)) - 1, F.lit(1)))
    known = as_whole.select("unit", "n").unionByName(closed_items).unionByName(open_units.select("unit", "n"))
    by_pair, by_word = _endings(known.groupBy("unit").agg(F.sum("n").alias("n")))
    total = by_word.agg(F.sum("word_ends").alias("e"), F.sum("word_seen").alias("s")).first()
    prior = (total.e or 0) / (total.s or 1)

    last = _last_words(F.col("unit"))
    open_last = shortened.join(unknown, "unit").select("unit", "n", "shortened", F.element_at(last, -1).alias("word"), F.when(F.size(last) > 1, F.get(last, F.size(last) - 2)).otherwise("").alias("before"))
    # words that end open units only may be parts of words
    only_open = open_last.groupBy("word").agg(F.sum("n").alias("open_ends"))
    words = by_word.join(only_open, "word", "left").select("word", (F.col("word_seen") > F.coalesce("open_ends", F.lit(0))).alias("complete"))
    words = words.unionByName(names.select("word", F.lit(True).alias("complete"))).groupBy("word").agg(F.bool_or("complete").alias("complete"))
    # a number may begin any other
    partial = _beginnings(words.filter(F.col("word").rlike(r"\p{L}$")).select(F.col("word").alias("unit"), "complete")).filter("shortened").select(F.col("unit").alias("word"), F.lit(True).alias("partial"))

    judged = open_last.join(by_pair, ["before", "word"], "left").join(by_word, "word", "left").join(partial, "word", "left")
    # one occurrence, the unit's own, doesn't count
    share = lambda ends, seen, shorter: (F.greatest(ends - 1, F.lit(0)) + BACK_OFF * shorter) / (F.greatest(seen - 1, F.lit(0)) + BACK_OFF)
    by_one = share(F.col("word_ends"), F.col("word_seen"), F.lit(prior))
    by_two = share(F.col("ends"), F.col("seen"), by_one)
    why = F.when(F.col("shortened"), "shortened").when(F.col("partial"), "part of a word").when(by_two < ENDING_SHARE, "no ending")
    return judged.select("unit", why.alias("why")).filter("why is not null")


#: How a masked list begins, and where its next item does.
_LIST, _NEXT_ITEM = r"^(?:[-*•]|9+[.)])(?: |$)", r" (?=(?:[-*•]|9+[.)]) )"


def length_limits(rows: DataFrame) -> DataFrame:
    """(generator, size) at which a generator's responses pile up: many more than at the lengths before and after it.

    A limit cuts off what would be longer: of the responses of that length most are open, and they are no small part
    of those that reach it.  Longer ones, of runs under another limit, may well be there.
    """
    lengths = rows.filter("defect is null").groupBy("generator", "size").agg(F.count("*").alias("n"), F.count("unit").alias("open"))
    at = Window.partitionBy("generator").orderBy("size")
    near = lambda a, b: F.coalesce(F.sum("n").over(at.rangeBetween(a, b)), F.lit(0)) / SPIKE_REACH
    beside = F.greatest(near(-SPIKE_REACH, -1), near(1, SPIKE_REACH))
    reach = F.sum("n").over(at.rowsBetween(0, Window.unboundedFollowing))
    seen = lengths.withColumn("beside", beside).withColumn("reach", reach)
    return seen.filter((F.col("n") >= MIN_SPIKE) & (F.col("n") > SPIKE_FACTOR * F.col("beside")) & (2 * F.col("open") > F.col("n")) & (F.col("n") > LIMIT_SHARE * F.col("reach"))).select("generator", "size")


def _truncated(rows: DataFrame) -> DataFrame:
    """(id, why) of the rows of :func:`_judged` whose response breaks off."""
    complete = cut(rows.select(F.explode("whole").alias("unit")).groupBy("unit").agg(F.count("*").alias("n")))
    openers = rows.filter("unit is not null").select("id", "unit", "dangling", "generator", "size")
    broken = _broken(complete, openers.groupBy("unit").agg(F.count("*").alias("n")), rows.select(F.explode("names").alias("word")).distinct())
    limits = length_limits(rows).withColumn("at_limit", F.lit(True))
    why = F.coalesce("why", F.when(F.col("dangling"), "open bracket or mark"), F.when(F.col("at_limit"), "length limit"))
    open_rows = openers.join(broken, "unit", "left").join(limits, ["generator", "size"], "left").select("id", why.alias("why")).filter("why is not null")
    return open_rows.unionByName(rows.filter("cut_look").select("id", F.lit("ellipsis").alias("why")))


def defective_pairs(
    df: DataFrame,
    key: str = "id",
    prompt: str = "original_query",
    other_prompt: str = "normalized_query",
    response: str = "generated_answer",
    error: str = "error",
    generator: str = "generator_model",
    tongues: Tongues | None = None,
    with_reason: bool = False,
) -> DataFrame:
    """(key, defect) of each row whose response is no proper answer; one defect a row.

    ``tongues`` tells languages by characters; without it only another script does.  ``with_reason`` adds ``why`` a
    response counts as truncated, null for other defects.

    Defects, the first that holds: ``empty``, ``error_text``, ``copied_question``, ``refusal``, ``other_language``,
    ``truncated``.  A null or empty response is ``empty`` whatever the other columns hold; null prompts or errors just
    make no copy or error; repeated rows come out once; an empty table gives no rows; other columns are not read.
    """
    base = df.select(F.col(key).alias("id"), F.coalesce(F.col(generator), F.lit("")).alias("generator"), F.col(prompt).alias("p"), F.col(other_prompt).alias("q"), F.col(response).alias("a"), F.col(error).alias("e"))
    shared = df.sparkSession.sparkContext.broadcast(tongues)  # a model of a bounded sample
    rows = cut(spread(base).mapInPandas(lambda batches: _judged(batches, shared.value), _ROW.format(key=df.schema[key].dataType.simpleString())))
    alone = rows.filter("defect is not null").select("id", "defect", F.lit(None).cast("string").alias("why"))
    out = alone.unionByName(_truncated(rows).select("id", F.lit("truncated").alias("defect"), "why")).select(F.col("id").alias(key), "defect", "why")
    return out.groupBy(key, "defect").agg(F.min("why").alias("why")) if with_reason else out.select(key, "defect").distinct()
