"""Problem 8: text decoded with the wrong character encoding.

Every candidate decoding of a garbled place is a chain of steps "these characters were bytes of W read wrongly; read
them as R".  The chain with the least description length wins: the zstandard size of the sentence under the
dictionary of its language, plus a fixed cost for each character foreign to the language and for each step of the
chain.  Where no chain is shorter than the text as it stands, the text is left unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import pandas as pd
import regex as re
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.unify import SUSPECT
from quillspark.tables import cut, spread

# Single-byte encodings in which text is commonly misread.
CODECS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "iso8859_2", "cp1254", "cp1253", "cp866", "iso8859_15")
#: Encodings whose own bytes are commonly misread in another single-byte encoding.
ORIGINS = ("cp1252", "mac_roman", "cp437", "cp850")

#: Bytes a step of a chain costs: reading as UTF-8 proves itself by its form, another single-byte encoding doesn't.
STEP_COST, SWAP_COST = 1.0, 3.0
#: Bytes for each character that the language hardly has.
FOREIGN_COST = 3.0
MAX_STEPS = 3
#: The most bytes of sentences taken from a text by ``_some_sentences``.
SAMPLE_BYTES = 8_000
DICTIONARY_BYTES = 112_640
#: A character is at home in a language if so large a share of its sentences beyond ASCII have it.
HOME_SHARE = 0.02

_SEGMENT = re.compile(r"[^\n]*?(?:[.!?।…]['\"”’»]?(?=\s)\s*|\n+|$)")
_LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")
_TOKEN = re.compile(r"\S*[^\x00-\x7f]\S*")


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[dict[str, int], dict[int, str]]:
    """Characters of the upper half of ``codec`` as bytes, and back; bytes it leaves out stand for the control characters of the same number."""
    to_char = {}
    for b in range(0x80, 0x100):
        try:
            to_char[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            to_char[b] = chr(b)
    to_byte = {c: b for b, c in to_char.items()}
    for b in range(0x80, 0xA0):  # decoders for the web pass control characters through
        to_byte.setdefault(chr(b), b)
    return to_byte, to_char


@lru_cache(maxsize=None)
def _utf8_runs(codec: str) -> re.Pattern:
    """Characters that are well-formed multi-byte UTF-8 when taken as bytes of ``codec``."""
    to_byte, _ = _tables(codec)

    def of(*spans: tuple[int, int]) -> str:
        return "[" + "".join(re.escape(c) for c, b in to_byte.items() if any(lo <= b <= hi for lo, hi in spans)) + "]"

    tail = of((0x80, 0xBF))
    return re.compile(f"(?:{of((0xC2, 0xDF))}{tail}|{of((0xE0, 0xEF))}{tail}{{2}}|{of((0xF0, 0xF4))}{tail}{{3}})+")


def _as_utf8(text: str, codec: str) -> str:
    """``text`` with what is UTF-8 in the bytes of ``codec`` read as such."""
    to_byte, _ = _tables(codec)

    def decoded(m: re.Match) -> str:
        try:
            return bytes(to_byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _utf8_runs(codec).sub(decoded, text)


#: Characters beyond ASCII in a row: no decoding reaches beyond them.
_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 17)
def _readings(run: str) -> tuple[str, ...]:
    """A run as UTF-8 in each of ``CODECS``; () if none of them changes it.  Runs recur far more often than sentences."""
    read = tuple(_as_utf8(run, c) for c in CODECS)
    return () if all(r == run for r in read) else read


_WIDE_LE = re.compile("[" + "".join(f"\\u{hi:02x}{lo:02x}-\\u{hi:02x}{up:02x}" for hi in range(0x20, 0x7F) for lo, up in ((0x20, 0x7E),)) + "ਠ-੾]{3,}")


def _from_utf16(text: str) -> str:
    """Pairs of ASCII bytes that were read as single characters of two bytes."""

    def decoded(m: re.Match) -> str:
        forms = [m[0].encode(e).decode("latin-1") for e in ("utf-16-le", "utf-16-be")]
        return max(forms, key=lambda s: sum(c.islower() or c == " " for c in s))

    return _WIDE_LE.sub(decoded, text)


@lru_cache(maxsize=1 << 16)
def _swap(text: str, wrong: str, right: str) -> str | None:
    to_byte, _ = _tables(wrong)
    _, to_char = _tables(right)
    out = []
    for c in text:
        if c >= "\x80":
            if (b := to_byte.get(c)) is None:
                return None
            c = to_char[b]
        out.append(c)
    return "".join(out)


@dataclass
class Language:
    """What describes clean text of one language: zstandard dictionary and alphabet beyond ASCII."""

    dictionary: bytes
    alphabet: frozenset[str]


class Restorer:
    """Finds the shortest description of each sentence; holds one compressor a language."""

    def __init__(self, languages: dict[str, Language]) -> None:
        self._languages = languages
        self._compressors: dict[str, zstandard.ZstdCompressor] = {}
        self._seen: dict[tuple[str, str], tuple[str, float]] = {}
        self._strange: dict[tuple[str, str], int] = {}

    def _foreign(self, run: str, lang: str) -> int:
        """How many characters of a run are foreign to the language."""
        if (n := self._strange.get((run, lang))) is None:
            home = self._languages[lang].alphabet
            if len(self._strange) > 200_000:
                self._strange.clear()
            n = self._strange[run, lang] = sum(c not in home for c in run)
        return n

    def _cost(self, text: str, lang: str) -> float:
        c = self._compressors.get(lang)
        if c is None:
            data = zstandard.ZstdCompressionDict(self._languages[lang].dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_checksum=False, write_dict_id=False)
            data.precompute_compress(compression_params=params)  # digested once, not once a call
            c = self._compressors[lang] = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
        return len(c.compress(text.encode("utf-8", "surrogatepass"))) + FOREIGN_COST * sum(self._foreign(r, lang) for r in _RUN.findall(text))

    def _chains(self, text: str) -> dict[str, float]:
        """Candidate decodings by UTF-8 and their chain costs; equal readings of all runs are one candidate."""
        found = {text: 0.0}
        layer = [text]
        for step in range(1, MAX_STEPS + 1):
            following = []
            for t in layer:
                runs, between = _RUN.findall(t), _RUN.split(t)
                read = [_readings(r) or (r,) * len(CODECS) for r in runs]
                outs = ["".join(x for pair in zip(between, (*some, ""), strict=True) for x in pair) for some in dict.fromkeys(zip(*read, strict=True))]
                for out in [*outs, _from_utf16(t)]:
                    if out not in found:
                        found[out] = STEP_COST * step
                        following.append(out)
            layer = following
        return found

    def sentence(self, text: str, lang: str) -> tuple[str, float]:
        """(shortest decoding, bytes saved)."""
        if (lang, text) in self._seen:
            return self._seen[lang, text]
        chains = self._chains(text)
        own = self._cost(text, lang)
        best, least = min(((t, self._cost(t, lang) + extra) for t, extra in chains.items() if t != text), key=lambda x: (x[1], x[0]), default=(text, own))
        if least >= own:
            best, least = text, own
        strange = [m[0] for m in _TOKEN.finditer(best) if any(self._foreign(r, lang) for r in _RUN.findall(m[0]))]
        if strange:
            start, tried = best, {best}
            for wrong in CODECS:
                for right in ORIGINS:
                    swapped = {} if wrong == right else {t: s for t in strange if (s := _swap(t, wrong, right)) and s != t and not _LOST.search(s)}
                    if not swapped or (out := _TOKEN.sub(lambda m: swapped.get(m[0], m[0]), start)) in tried:
                        continue
                    tried.add(out)
                    if (cost := self._cost(out, lang) + SWAP_COST) < least:
                        best, least = out, cost
        if len(self._seen) > 50_000:
            self._seen.clear()
        self._seen[lang, text] = best, own - least
        return best, own - least

    def document(self, text: str, lang: str | None) -> tuple[str, bool]:
        """(text restored as far as possible, was it garbled?)."""
        garbled = bool(_LOST.search(text))
        pick = [lang] if lang in self._languages else list(self._languages)
        # a run that no codec reads as UTF-8, and at home in the language, is as it should be
        odd = {r for r in set(_RUN.findall(text)) if _readings(r) or any(self._foreign(r, x) for x in pick)}
        if not odd:
            return text, garbled
        out = []
        for m in _SEGMENT.finditer(text):
            segment = m[0]
            if not segment.isascii() and not odd.isdisjoint(_RUN.findall(segment)):
                best = max((self.sentence(segment, x) for x in pick), key=lambda x: x[1], default=(segment, 0.0))[0]
                garbled |= best != segment
                segment = best
            out.append(segment)
        return "".join(out), garbled or bool(_LOST.search("".join(out)))


def _alphabet(sentences: Counter[str]) -> frozenset[str]:
    """Characters beyond ASCII that a fair share of the sentences beyond ASCII have."""
    counts: Counter[str] = Counter()
    total = 0
    for s, n in sentences.items():
        if not s.isascii():
            total += n
            for c in {c for c in s if c >= "\x80"}:
                counts[c] += n
    return frozenset(c for c, n in counts.items() if n >= max(2, HOME_SHARE * total))


def _some_sentences(text: str, most: int = SAMPLE_BYTES) -> str:
    """``text`` if it has at most ``most`` bytes, else sentences of it, picked by their hash from its whole length, up to so many."""
    if len(text) * 4 <= most or len(text.encode()) <= most:
        return text
    picked, size = [], 0
    for s in sorted((s for m in _SEGMENT.finditer(text) if (s := m[0].strip())), key=lambda s: crc32(s.encode())):
        if size + len(s.encode()) < most:
            picked.append(s)
            size += len(s.encode()) + 1
    return "\n".join(picked)


def learn_languages(rows: list[tuple[str, str]], seed_bytes: int = DICTIONARY_BYTES) -> dict[str, Language]:
    """Dictionaries and alphabets from (text, language) rows in memory; sentences that look garbled are left out."""
    sentences: dict[str, Counter[str]] = {}
    for text, lang in rows:
        sentences.setdefault(lang, Counter()).update({s for m in _SEGMENT.finditer(text) if (s := m[0]).strip() and not _LOST.search(s)})
    out = {}
    for lang, some in sentences.items():
        home = _alphabet(some)
        # Well-formed UTF-8 that gives characters at home in the language is a misreading, not text.
        clean = Counter({s: n for s, n in some.items() if s.isascii() or not any(all(c in home for c in read if c >= "\x80") for w in CODECS if _utf8_runs(w).search(s) and (read := _as_utf8(s, w)) != s)})
        home = _alphabet(clean)
        # Sentences beyond ASCII last: the end of a dictionary is the cheapest to refer to.
        pool = [s for s in clean if all(c < "\x80" or c in home for c in s)]
        plain = [s for s in pool if s.isascii()]
        rest = [s for s in pool if not s.isascii()]
        data, size = [], 0
        for s in [*rest, *plain]:
            b = s.encode()
            if size + len(b) > seed_bytes:
                continue
            data.append(b)
            size += len(b)
        out[lang] = Language(b"".join(reversed(data)) or b" " * 8, home)
    return out


#: ``_SEGMENT``, ``_LOST`` and characters beyond ASCII for the JVM.
_JVM_SEGMENT, _JVM_LOST, _JVM_BEYOND = r"""(?U)[^\n]*?(?:[.!?।…]['"”’»]?(?=\s)\s*|\n+|\z)""", r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]", r"[^\x{00}-\x{7F}]"
#: Parts of a language's sentences that are ranked side by side.
PARTS = 64


def _counted(texts: DataFrame, beyond: bool) -> DataFrame:
    """lang, s, n, chars: in how many documents each sentence stands, and its characters beyond ASCII; sentences with such, or without."""
    every = F.regexp_extract_all("text", F.lit(_JVM_SEGMENT), F.lit(0))
    wanted = F.array_distinct(F.filter(every, lambda s: (s.rlike(_JVM_BEYOND) if beyond else ~s.rlike(_JVM_BEYOND)) & s.rlike(r"(?U)\S") & ~s.rlike(_JVM_LOST)))
    counted = texts.select("lang", F.explode(wanted).alias("s")).groupBy("lang", "s").agg(F.count("*").alias("n"))
    return counted.withColumn("chars", F.array_distinct(F.regexp_extract_all("s", F.lit(_JVM_BEYOND), F.lit(0))))


def _alphabets(counted: DataFrame) -> dict[str, frozenset[str]]:
    """``_alphabet`` of each language."""
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return {}
    least = F.create_map(*(x for k, n in totals.items() for x in (F.lit(k), F.lit(max(2.0, HOME_SHARE * n)))))
    chars = counted.select("lang", "n", F.explode("chars").alias("c")).groupBy("lang", "c").agg(F.sum("n").alias("n")).filter(F.col("n") >= least[F.col("lang")])
    out: dict[str, set[str]] = {lang: set() for lang in totals}
    for r in chars.collect():
        out[r.lang].add(r.c)
    return {lang: frozenset(some) for lang, some in out.items()}


def _commonest(counted: DataFrame, most: int) -> dict[str, list[str]]:
    """Sentences of each language, some twice ``most`` bytes, long ones last.

    Sentences that differ in digits only are one form: first the commonest of each form, forms in most documents first,
    then the second of each, and so on; ties by hash.
    """
    form = Window.partitionBy("lang", "form")
    ranked = counted.select("lang", "s", "n", F.octet_length("s").alias("bytes"), F.xxhash64("s").alias("h"), F.regexp_replace("s", r"\p{Nd}+", "0").alias("form")).filter(F.col("bytes") <= most)
    ranked = ranked.withColumn("nth", F.row_number().over(form.orderBy(F.desc("n"), "h", "s"))).withColumn("n", F.sum("n").over(form)).drop("form").withColumn("part", F.pmod("h", F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):  # what is among the first of all is among the first of its part
        order = Window.partitionBy(*by).orderBy(F.col("bytes") > most // 16, "nth", F.desc("n"), "h", "s").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).filter(F.col("before") < 2 * most).drop("before")
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.bytes > most // 16, r.nth, -r.n, r.h, r.s)):
        out.setdefault(r.lang, []).append(r.s)
    return out


def learned_languages(df: DataFrame, text: str, lang: str, seed_bytes: int = DICTIONARY_BYTES) -> dict[str, Language]:
    """What :func:`learn_languages` learns, from every document: alphabets by counts over all sentences beyond ASCII.

    A dictionary is bounded by its format, so it takes the commonest forms of sentences; ASCII sentences are counted only
    in languages whose others don't fill it.  Languages are told by a label, of which there are few.
    """
    texts = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    names = [r.lang for r in texts.select("lang").distinct().collect()]
    counted = cut(_counted(texts.filter(F.col("text").rlike(_JVM_BEYOND)), True))
    homes = df.sparkSession.sparkContext.broadcast(_alphabets(counted))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # well-formed UTF-8 that gives characters at home in the language is a misreading, not text
            changed = [any(_readings(r) for r in set(_RUN.findall(s))) for s in b["s"]]
            misread = [c and any(all(c in homes.value[x] for c in read if c >= "\x80") for w in CODECS if _utf8_runs(w).search(s) and (read := _as_utf8(s, w)) != s) for s, x, c in zip(b["s"], b["lang"], changed, strict=True)]
            yield b[[not m for m in misread]]

    kept = cut(counted.mapInPandas(clean, "lang string, s string, n bigint, chars array<string>"))
    home = _alphabets(kept)
    pool = kept.limit(0)
    if home:
        at_home = F.create_map(*(x for k, some in home.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(some))).cast("array<string>"))))
        pool = kept.filter(F.size(F.array_except("chars", at_home[F.col("lang")])) == 0)
    first = _commonest(pool, seed_bytes)
    short = [x for x in names if sum(len(s.encode()) for s in first.get(x, [])) < seed_bytes]
    plain = _commonest(_counted(texts.filter(F.col("lang").isin(short)), False), seed_bytes) if short else {}
    out = {}
    for x in names:
        data, size = [], 0
        for s in [*first.get(x, []), *plain.get(x, [])]:  # the end of a dictionary is the cheapest to refer to
            b = s.encode()
            if size + len(b) <= seed_bytes:
                data.append(b)
                size += len(b)
        out[x] = Language(b"".join(reversed(data)) or b" " * 8, home.get(x, frozenset()))
    return out


def restored_text(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", languages: dict[str, Language] | None = None) -> DataFrame:
    """key, text, restored, garbled for each row with a text beyond ASCII.

    ASCII texts cannot be garbled and stay in the JVM.  A null language is tried as each known one; null and empty
    texts give no row; an unrestorable text comes out as far restored as can be told, with ``garbled`` true; repeated
    rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    languages = learned_languages(df, text, lang) if languages is None else languages
    shared = df.sparkSession.sparkContext.broadcast(languages)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for batch in batches:
            rows = [restorer.document(t, x) for t, x in zip(batch["text"], batch["lang"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "text": batch["text"], "restored": [r[0] for r in rows], "garbled": [r[1] for r in rows]})

    suspects = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("text").rlike(SUSPECT))
    return spread(suspects).mapInPandas(run, f"key {kind}, text string, restored string, garbled boolean").withColumnRenamed("key", key)


def garbled_documents(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The keys of garbled documents; see :func:`restored_text`."""
    return restored_text(df, key, text, lang).filter("garbled").select(key)
