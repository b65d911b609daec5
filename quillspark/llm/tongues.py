"""Which language a text is in, by characters: a model fitted on a bounded sample of labelled documents.

Each language has a distribution over words: its words' own shares, mixed with an interpolated Markov chain over the
characters of its word types, which knows words never seen.  A text's score is the sum over its words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents sampled a language, and words taken of each, spread over its whole length (at most twice as many).
SAMPLE, SAMPLE_WORDS = 400, 300
#: Characters that a character depends on, and the weight of the shorter context in each step.
ORDER, BACK_OFF = 3, 2.0
#: Share of a word's probability that comes from the words seen.
SEEN = 0.7
#: The language asked for, and the name of what is none of the languages seen: the characters of all others together, without their words.
ENGLISH, OTHER = "en", "*"
_WORDS = re.compile(r"[\p{L}\p{M}']+")
#: A capitalized word within a sentence, or a code: names belong to no language.
_NAMES = re.compile(r"(?<=[\p{Ll}\p{N},;:%)] )\p{Lu}[\p{L}\p{M}'’]*|\p{Lu}{1,3}-?\p{N}+|\p{Lu}{2,3}-")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, names and codes left out."""
    return _WORDS.findall(_NAMES.sub(" ", text.replace("’", "'")).lower())


@dataclass
class Tongues:
    """Log-probabilities of words under each language; empty where nothing was there to learn from."""

    names: list[str]
    words: list[Counter[str]]
    chains: list[dict[str, Counter[str]]]
    _known: dict[str, np.ndarray] = field(default_factory=dict)

    def _chain(self, word: str, chain: dict[str, Counter[str]]) -> float:
        framed, total = "^" * ORDER + word + "$", 0.0
        for i in range(ORDER, len(framed)):
            p = 1 / 300
            for n in range(ORDER + 1):
                if (seen := chain.get(framed[i - n : i])) is None:
                    break
                p = (seen[framed[i]] + BACK_OFF * p) / (seen["total"] + BACK_OFF)
            total += math.log(p)
        return total

    def scores(self, word: str) -> np.ndarray:
        """Of one word under each language."""
        if (s := self._known.get(word)) is None:
            if len(self._known) > 200_000:
                self._known.clear()
            s = np.array([np.logaddexp(math.log(SEEN * c[word] / c.total()) if c[word] else -np.inf, (math.log(1 - SEEN) if c else 0.0) + self._chain(word, chain)) for c, chain in zip(self.words, self.chains, strict=True)])
            self._known[word] = s
        return s

    def english_margin(self, words: list[str]) -> float:
        """How much likelier the words are in English than in the likeliest other language, in nats; 0 without a model."""
        if not words or ENGLISH not in self.names or len(self.names) < 3:
            return 0.0
        total = np.sum([self.scores(w) for w in words], axis=0)
        at = self.names.index(ENGLISH)
        return float(total[at] - np.delete(total, at).max())


def learn(rows: list[tuple[str, str]]) -> Tongues:
    """From (text, language) rows."""
    counts: dict[str, Counter[str]] = {}
    for text, lang in sorted(rows):
        counts.setdefault(lang, Counter()).update(words_of(text))
    names = sorted(x for x in counts if counts[x])
    pooled = sum((counts[x] for x in names if x != ENGLISH), Counter())
    chains = []
    for some in [*(counts[x] for x in names), pooled]:
        chain: dict[str, Counter[str]] = {}
        for word, n in some.items():
            framed, weight = "^" * ORDER + word + "$", 1.0 + math.log(n)
            for i in range(ORDER, len(framed)):
                for k in range(ORDER + 1):
                    seen = chain.setdefault(framed[i - k : i], Counter())
                    seen[framed[i]] += weight
                    seen["total"] += weight
        chains.append(chain)
    return Tongues([*names, OTHER], [*(counts[x] for x in names), Counter()], chains)


def sampled(corpus: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Tongues:
    """Learns from about ``sample`` documents a language, chosen by the hash of their key; a bounded set at any size.

    Of a long text, words from its whole length are taken, before anything reaches the driver.
    """
    rows = corpus.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return learn([])
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    chosen = rows.filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    spread_out = F.pandas_udf(lambda texts: texts.map(_some_words), "string")
    return learn([(r[0], r[1]) for r in chosen.select(spread_out("text"), "lang").collect()])


def _some_words(text: str) -> str:
    """At most twice ``SAMPLE_WORDS`` words, at equal distances; short texts are left as they are."""
    words = text.split()
    return text if len(words) <= SAMPLE_WORDS else " ".join(words[:: len(words) // SAMPLE_WORDS])
