"""Problem 1: one consistent form for text that looks ordinary but is spelled with other characters.

Script sets are resolved per word: every character stands for the scripts it belongs or extends to, those written
together with them, and those in which a letter is drawn the same way.  The intersection over a word names the
scripts in which the whole word can be spelled.  A word whose own scripts do not intersect is mixed; a word of one
script that can be spelled entirely in the script of the text around it is a whole-script confusable.  Both are
respelled; of a mixed word that no one script can spell, the letters that pass for its main script's are.  Latin
letters of phonetic notation (script g, alpha, small capitals) become the ordinary ones in words that have such; true
letters of Latin alphabets, the dotless i among them, stay.  Everything else that differs only in form (width, style, ligature, blank, hyphen, accents in pieces, invisible characters) is normalized.

Plain ASCII never reaches Python: it is its own plain form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts drawn like a Latin letter, by that letter.
LOOKALIKES = {
    "a": "аα", "c": "сⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ",
    "r": "гⲅ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝա", "x": "хχ", "y": "уү", "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬⴹꓰ", "F": "Ϝꓝ",
    "G": "ԌᏀꓖ", "H": "НΗᎻⲎꓧҺ", "I": "ІΙӀꓲ", "J": "ЈᎫꓙ", "K": "КΚᏦⲔꓗ", "L": "Ꮮꓡ", "M": "МΜᎷⲘꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢⲢꓑ", "Q": "Ԛⵕ", "R": "Ꭱꓣ",
    "S": "ЅՏᏚꓢ", "T": "ТΤᎢⲦꓔ", "U": "Սꓴ", "V": "ѴᏙⴸꓦ", "W": "ԜᏔꓪ", "X": "ХΧⲬꓫ", "Y": "УҮΥᎩⲨꓬ", "Z": "ΖᏃꓜ",
}
# Letters that pass for a Latin one within a word only, by that letter; a word of them alone is a word of its script.
WITHIN_WORDS = {"b": "вЬьβ", "e": "εєҽ", "h": "н", "k": "к", "m": "м", "n": "пηи", "o": "σө", "t": "тτ", "w": "ωшѡ", "x": "ж", "y": "γ", "z": "зζ", "j": "յ", "g": "գ", "f": "ғ", "v": "ʋ"}
# Scripts by the first word of their letters' names, where that is not the script's own name; scripts that are written together.
NAMED_OTHERWISE = {"CJK": "HAN", "CANADIAN": "CANADIAN_ABORIGINAL"}
TOGETHER = {"HAN": {"JPAN", "KORE", "HANB"}, "HIRAGANA": {"JPAN"}, "KATAKANA": {"JPAN"}, "HANGUL": {"KORE"}, "BOPOMOFO": {"HANB"}}
# Hyphens drawn like the ASCII one.
HYPHENS = "\u2010\u2011\u2012\ufe63\uff0d\u2043"
# Characters outside category Cf that show nothing.
BLANK_LETTERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u2800"

#: One or more characters that plain ASCII text does not have.
SUSPECT = r"[^\x09\x0A\x0D\x20-\x7E]"

_LATIN, _COMMON = regex.compile(r"\p{Script=Latin}"), regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")
_PHONETIC = re.compile(r"LATIN (?:LETTER SMALL CAPITAL ([A-Z])|SMALL LETTER SCRIPT ([A-Z])|SMALL LETTER (ALPHA|IOTA))")
_WIDTH_OR_STYLE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<circle>", "<small>"}
_WORD = re.compile(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*")


@lru_cache(maxsize=1 << 14)
def _script(ch: str) -> str:
    """Script of a letter, '' where it belongs to none or to all (digits, marks, punctuation, common letters)."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    if not unicodedata.category(ch).startswith("L"):
        return ""
    if _LATIN.match(ch):
        return "LATIN"
    if _COMMON.match(ch):
        return ""
    first = unicodedata.name(ch, "UNKNOWN").split(" ", 1)[0]
    return NAMED_OTHERWISE.get(first, first)


@lru_cache(maxsize=1 << 14)
def _extends_to(ch: str, script: str) -> bool:
    """Is ``script`` among the letter's script extensions?"""
    try:
        return regex.match(rf"\p{{scx={script}}}", ch) is not None
    except regex.error:
        return False


@lru_cache(maxsize=1)
def _lookalikes() -> dict[str, dict[str, str]]:
    """ch -> {script: letter of that script drawn the same way}."""
    table: dict[str, dict[str, str]] = {}
    for latin, foreign in LOOKALIKES.items():
        for f in foreign:
            table.setdefault(f, {})["LATIN"] = latin
            table.setdefault(latin, {}).setdefault(_script(f), f)
    for f, forms in list(table.items()):
        if (small := f.lower()) != f and small not in table and _script(f) == "CHEROKEE":  # drawn as small capitals
            table[small] = {"LATIN": forms["LATIN"].lower()}
    for ch, forms in list(table.items()):  # from one script to another by way of Latin
        if "LATIN" in forms:
            for script, other in table.get(forms["LATIN"], {}).items():
                if script != _script(ch):
                    forms.setdefault(script, other)
    return table


@lru_cache(maxsize=1)
def _within_words() -> dict[str, dict[str, str]]:
    """Like :func:`_lookalikes`, with the letters that pass for Latin ones in mixed words."""
    table = {ch: dict(forms) for ch, forms in _lookalikes().items()}
    for latin, foreign in WITHIN_WORDS.items():
        for f in foreign:
            table.setdefault(f, {}).setdefault("LATIN", latin)
    return table


@lru_cache(maxsize=1 << 12)
def _phonetic(ch: str) -> str | None:
    """The ASCII letter that a Latin letter of phonetic notation is drawn like: script, alpha, iota, small capitals."""
    name = unicodedata.name(ch, "")
    if m := _PHONETIC.fullmatch(name):
        return (m[1] or m[2] or {"ALPHA": "a", "IOTA": "i"}[m[3]]).lower()
    return None


@lru_cache(maxsize=1 << 16)
def _form(ch: str) -> str:
    """The plain form of one character, apart from its script."""
    if ch in "\n\t\rµ" or " " <= ch <= "~":  # the micro sign is no letter in disguise
        return ch
    category = unicodedata.category(ch)
    if category in ("Cf", "Cc") or ch in BLANK_LETTERS or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if category == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    tag = unicodedata.decomposition(ch).split(" ", 1)[0]
    if tag in _WIDTH_OR_STYLE and (category[0] in "LN" or tag in ("<wide>", "<narrow>", "<small>")):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _resolved(word: str, scripts: set[str], alike: dict[str, dict[str, str]]) -> tuple[set[str], list[tuple[str, str, set[str]]]]:
    """(scripts in which all of the word can be spelled, and each letter with its script and resolved script set).

    A letter's set has its script, the scripts written together with it, those of the word that it extends to, and
    those in which a letter is drawn like it.
    """
    rows = []
    for c in word:
        if s := _script(c):
            sets = {s} | TOGETHER.get(s, set()) | {x for x in scripts if x != s and _extends_to(c, x)} | alike.get(c, {}).keys()
            rows.append((c, s, sets))
    return set.intersection(*(x for _, _, x in rows)) if rows else set(), rows


def _respell(word: str, around: str) -> str:
    """The word in one script. ``around``: the script of the text it stands in."""
    scripts = {s for c in word if (s := _script(c))}
    if not scripts or scripts == {around} and around != "LATIN":
        return word
    if scripts == {"LATIN"}:  # phonetic letters among ordinary ones
        return "".join(_phonetic(c) or c for c in word) if any(c.isascii() and c.isalpha() for c in word) else word
    mixed = len(scripts) > 1
    alike = _within_words() if mixed else _lookalikes()
    possible, own = _resolved(word, scripts, alike)
    possible -= {x for some in TOGETHER.values() for x in some} if not mixed else set()
    count = {s: sum(x == s for _, x, _ in own) for s in possible | scripts}
    if mixed and possible - scripts and not possible & scripts:
        return word  # scripts written together
    if not possible:  # no script has all letters: those that pass for one of the word's main script are respelled
        target = max(scripts, key=lambda s: (count[s], s == around, s))
    elif not mixed:  # one script: foreign only if the text around can spell all of it
        target = around if around in possible else next(iter(scripts))
    else:
        sure = {s for c, s, _ in own if c not in alike} & possible  # a letter without a double decides, then the text around
        target = max(sure or possible, key=lambda s: (s == around, count[s], s))
    return "".join(c if not (s := _script(c)) or s == target else alike.get(c, {}).get(target, c) for c in word)


def plain_text(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null, '' stays ''."""
    if text is None or text.isascii() and text.isprintable():
        return text
    out = unicodedata.normalize("NFC", "".join(map(_form, text)))
    words = _WORD.findall(out)
    foreign = [w for w in words if not w.isascii()]
    if not foreign or all(not _script(c) or _script(c) == "LATIN" and _phonetic(c) is None for w in foreign for c in w):
        return out
    alike, votes = _lookalikes(), {}
    for w in words:
        scripts = {_script(c) for c in w} - {""}
        if len(scripts) == 1 and (s := next(iter(scripts))) and (s == "LATIN" or any(c not in alike for c in w)):
            votes[s] = votes.get(s, 0) + len(w)
    around = max(votes, key=lambda s: (votes[s], s)) if votes else "LATIN"
    return _WORD.sub(lambda m: m[0] if m[0].isascii() else _respell(m[0], around), out)


def is_disguised(text: str | None) -> bool:
    """Does some character differ from the plain one a reader takes it for?"""
    if not text:
        return False
    # Letters that NFC itself takes apart (Indic nukta letters) are written either way and are no cases.
    return plain_text(text) != "".join(unicodedata.normalize("NFC", c) if not c.isascii() else c for c in text)


_UNIFIED = T.StructType([T.StructField("plain", T.StringType()), T.StructField("disguised", T.BooleanType())])


@F.pandas_udf(_UNIFIED)
def _unify(texts: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple[str, bool]] = {}
    rows = []
    for t in texts:
        if t not in known:
            known[t] = (plain_text(t), is_disguised(t))
        rows.append(known[t])
    return pd.DataFrame(rows, columns=["plain", "disguised"])


def unify(value: Column) -> Column:
    """struct<plain, disguised> of a text column; Python sees only values with characters beyond ASCII.

    A null gives a null ``plain`` and ``disguised`` false.  Use it through :func:`unify_values`, which routes
    plain ASCII around Python.
    """
    return _unify(value)


def unify_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per (key, field) with a non-null value: key, field, value, plain, disguised.

    Whole values, no shuffle: ASCII rows stay in the JVM, the rest crosses Arrow once.  Null values give no
    row; an empty text is its own plain form; repeated rows stay repeated; an empty table gives no rows; other
    columns of ``df``, whatever their names, are not read.
    """
    long = df.select(
        F.col(key).alias("key"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"),
    ).select("key", "x.field", "x.value")
    suspect = F.col("value").rlike(SUSPECT)
    ascii_rows = long.filter(F.col("value").isNotNull() & ~suspect).select("key", "field", "value", F.col("value").alias("plain"), F.lit(False).alias("disguised"))
    other = long.filter(suspect).withColumn("u", unify(F.col("value"))).select("key", "field", "value", "u.plain", "u.disguised")
    return ascii_rows.unionByName(other).withColumnRenamed("key", key)


def disguised_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of each value with a disguised or unseen character; see :func:`unify_values`."""
    return unify_values(df, key, fields).filter("disguised").select(key, "field")


def equal_looking(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per plain form: how many values and how many different spellings it has.

    Spellings are counted before the forms meet, so a form held by a third of the rows reaches its reducer as one
    row per spelling and map task.
    """
    spelled = unify_values(df, key, fields).groupBy("plain", "value").agg(F.count("*").alias("n"))
    return spelled.groupBy("plain").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_spellings"))
