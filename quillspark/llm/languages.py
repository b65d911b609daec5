"""Problem 5: languages of texts and of the segments of mixed texts, with confidence.

A linear-chain conditional random field labels every word as English, Tamil or Hindi.  Features are the word, its
affixes, character n-grams, script and its entry in lexicons counted from the training texts; transitions between
neighbours are learned with them.  Training texts have a label as a whole only, so forward-backward runs twice: free,
and over the paths that agree with the text's label: English words anywhere, words that the lexicon gives to the mixed
language in that language, and not all of a mixed text English.  A sentence with a Tamil or Hindi word is a mix, one wholly in native script Tamil or
Hindi itself.  The model is fitted on a bounded sample; texts whose given label the first fit firmly contradicts are
left out of the second.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.unify import plain_text
from quillspark.tables import spread

ENGLISH, TAMIL_MIX, HINDI_MIX, TAMIL, HINDI = "english", "tamil_english", "hindi_english", "tamil", "hindi"
LABELS = (ENGLISH, TAMIL_MIX, HINDI_MIX)
# Labels that say nothing.
NO_LABEL = ("", "unknown")

#: Training texts sampled a label and source, and words up to which a text is used for training.
SAMPLE, MAX_WORDS = 1500, 60
#: Confidence of another language from which a training text counts as mislabelled.
SURE = 0.9
#: Share of its frequencies in one label from which a word belongs to that label's lexicon; mixes hold many English words.
OWN, OWN_ENGLISH = 0.85, 0.97
ROUNDS, RATE, PENALTY = 60, 0.3, 0.01
_K = len(LABELS)

_SENTENCE = re.compile(r"(?<=[?!।]|(?<!\b(?:Rs|rs|No|no|Mr|Ms|Dr))\.)\s+|\n+")
_WORD = re.compile(r"-?[\p{L}\p{M}]+(?:['’]\p{L}+)*|\p{N}[\p{N}.,]*")
_CODE = re.compile(r"\b\p{Lu}{1,3}-?\p{N}+\b")


def sentences_of(text: str) -> list[str]:
    """Sentences with a letter; others have no language."""
    return [s for s in _SENTENCE.split(text) if re.search(r"\p{L}", s)]


def _native(text: str) -> str | None:
    """tamil or hindi for the script of the native letters, if there are any."""
    tamil, hindi = len(re.findall(r"\p{IsTamil}", text)), len(re.findall(r"\p{IsDevanagari}", text))
    return None if not tamil and not hindi else TAMIL if tamil >= hindi else HINDI


def _features(word: str) -> list[str]:
    """Of a word in lower case; a hyphen before it tells a suffix."""
    if word[0].isdigit():
        return ["digits"]
    if script := _native(word):
        return [script, f"{script} word", f"w {word}"]
    bare = word.lstrip("-")
    out = [f"w {word}", "suffix" if word != bare else "word", f"length {min(len(bare), 9)}"]
    out += [f"p {bare[:n]}" for n in (2, 3) if len(bare) > n]
    out += [f"s {bare[-n:]}" for n in (2, 3, 4) if len(bare) > n]
    framed = f"<{bare}>"
    return out + [f"g {framed[i : i + 3]}" for i in range(len(framed) - 2)]


def _marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, allowed: np.ndarray | None = None, mixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: marginals (B, T, K) and expected moves (K, K).

    ``allowed``: the labels that each word may have.  ``mixed``: sequences that are not all English, for which that one
    path is taken out.
    """
    t = scores.shape[1]
    top = scores.max(axis=2, keepdims=True)
    psi = np.exp(scores - top) + 1e-12
    if allowed is not None:
        psi = psi * allowed
    step = np.exp(moves)
    inside = np.arange(t)[None, :] < lengths[:, None]
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    norm = psi[:, 0].sum(axis=1, keepdims=True)
    alpha[:, 0] = psi[:, 0] / norm
    log_total = np.log(norm[:, 0])
    for i in range(1, t):
        a = (alpha[:, i - 1] @ step) * psi[:, i]
        norm = a.sum(axis=1, keepdims=True)
        alpha[:, i] = np.where(inside[:, i, None], a / norm, alpha[:, i - 1])
        log_total += np.where(inside[:, i], np.log(norm[:, 0]), 0.0)
    for i in range(t - 2, -1, -1):
        c = (psi[:, i + 1] * beta[:, i + 1]) @ step.T
        beta[:, i] = np.where(inside[:, i + 1, None], c / c.sum(axis=1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    english = np.zeros(len(scores))
    if mixed is not None:
        path = np.where(inside, scores[:, :, 0] - top[:, :, 0], 0.0).sum(axis=1) + (lengths - 1) * moves[0, 0]
        english = np.where(mixed, np.exp(np.minimum(path - log_total, -1e-3)), 0.0)
        gamma = np.maximum(0.0, gamma - english[:, None, None] * np.eye(_K)[0]) / (1 - english)[:, None, None]
    x, y = alpha[:, :-1][inside[:, 1:]], (psi * beta)[:, 1:][inside[:, 1:]]
    weight = np.broadcast_to((1 / (1 - english))[:, None], inside[:, 1:].shape)[inside[:, 1:]]
    expected = step * ((x * (weight / ((x @ step) * y).sum(axis=1))[:, None]).T @ y)
    expected[0, 0] -= ((lengths - 1) * english / (1 - english)).sum()
    return gamma, expected


def _log_total(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, labels: list[int]) -> np.ndarray:
    """Logarithm of the total weight of the paths through ``labels`` alone."""
    s, m = scores[:, :, labels], moves[np.ix_(labels, labels)]
    a = s[:, 0]
    for i in range(1, s.shape[1]):
        x = a[:, :, None] + m[None]
        top = x.max(axis=1)
        a = np.where((i < lengths)[:, None], np.log(np.exp(x - top[:, None]).sum(axis=1)) + top + s[:, i], a)
    top = a.max(axis=1)
    return np.log(np.exp(a - top[:, None]).sum(axis=1)) + top


def _posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(B, K): probability that all words are English, that some are Tamil and none Hindi, that some are Hindi and none Tamil."""
    every = _log_total(scores, lengths, moves, list(range(_K)))
    english, *mixes = (np.exp(np.minimum(0.0, _log_total(scores, lengths, moves, labels) - every)) for labels in ([0], [0, 1], [0, 2]))
    return np.stack([english, *(np.maximum(0.0, x - english) for x in mixes)], axis=1)


def _words(sentence: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(sentence)]


@dataclass
class Tagger:
    """Weights of word features, lexicon entries and moves."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, str]

    def __post_init__(self) -> None:
        self._known: dict[str, np.ndarray] = {}

    def _score(self, word: str) -> np.ndarray:
        if (s := self._known.get(word)) is None:
            at = [i for f in _with_lexicon(word, self.lexicon) if (i := self.index.get(f)) is not None]
            s = self._known[word] = self.weights[at].sum(axis=0) if at else np.zeros(_K)
            if len(self._known) > 200_000:
                self._known.clear()
        return s

    def sentences(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(sentence, language, confidence) of each sentence of each text.

        The confidence is the model's posterior of the language: the share of all paths that has words of it, and
        English ones, but none of the other; of a sentence wholly in one native script, which leaves no choice, 1.
        """
        out: list[list[tuple[str, str, float]]] = [[] for _ in texts]
        work = []
        for k, text in enumerate(texts):
            for sentence in sentences_of(text):
                if words := _words(sentence):
                    work.append((len(words), len(work), k, sentence, words))
        found: list[tuple[str, float] | None] = [None] * len(work)
        work.sort(key=lambda x: x[0])
        start = 0
        while start < len(work):  # blocks of like length, of a bounded number of cells
            stop = start + 1
            while stop < len(work) and (stop - start) * work[stop][0] < 60_000:
                stop += 1
            some = work[start:stop]
            start = stop
            scores = np.zeros((len(some), some[-1][0], _K))
            for row, x in enumerate(some):
                scores[row, : x[0]] = [self._score(w) for w in x[4]]
            lengths = np.array([x[0] for x in some])
            gamma, _ = _marginals(scores, lengths, self.moves)
            sure = _posteriors(scores, lengths, self.moves)
            for row, x in enumerate(some):
                english = sum(self.lexicon.get(w) == f"lexicon {ENGLISH}" for w in x[4])
                language = _language(x[3], gamma[row, : x[0]], english)
                found[x[1]] = language, float(sure[row, LABELS.index(language)]) if language in LABELS else 1.0
        for _, place, k, sentence, _ in sorted(work, key=lambda x: x[1]):
            out[k].append((sentence, *found[place]))
        return out

    def segments(self, texts: list[str]) -> list[list[tuple[str, float, str]]]:
        """(language, confidence, text) of each longest run of sentences in one language."""
        out = []
        for parts in self.sentences(texts):
            runs: list[tuple[str, list[float], list[str]]] = []
            for sentence, language, sure in parts:
                if not runs or runs[-1][0] != language:
                    runs.append((language, [], []))
                runs[-1][1].append(sure)
                runs[-1][2].append(sentence)
            out.append([(language, float(np.mean(sure)), " ".join(s)) for language, sure, s in runs])
        return out


def _language(sentence: str, gamma: np.ndarray, english: int) -> str:
    """Language of a sentence, from the marginals of its words.

    ``english``: its words that only English texts have.  They outweigh fewer words of another language, such as an
    abbreviation that looks like one; the confidence, which is the posterior of the language, is low then.
    """
    script = _native(sentence)
    if script and not re.search(r"\p{IsLatin}", _CODE.sub(" ", sentence)):
        return script
    most, total = gamma.max(axis=0), gamma.sum(axis=0)
    mix = 1 if script == TAMIL else 2 if script == HINDI else 1 + int(total[2] > total[1])
    share = total[mix] / (total[mix] + english) if english else 1.0
    if script is None and (most[1:].max() < 0.5 or share < 0.45):
        return ENGLISH
    return LABELS[mix]


def _with_lexicon(word: str, lexicon: dict[str, str]) -> list[str]:
    entry = lexicon.get(word)
    return [*_features(word), entry] if entry else _features(word)


def _lexicon(texts: list[tuple[list[list[str]], int]]) -> dict[str, str]:
    """Words that nearly all their occurrences have in one label."""
    counts = [Counter(), Counter(), Counter()]
    for sentences, label in texts:
        for s in sentences:
            counts[label].update(s)
    totals = [max(1, sum(c.values())) for c in counts]
    out = {}
    for w in set().union(*counts):
        share = np.array([c[w] / n for c, n in zip(counts, totals, strict=True)])
        if sum(c[w] for c in counts) >= 4 and share.max() >= (OWN_ENGLISH if share.argmax() == 0 else OWN) * share.sum():
            out[w] = f"lexicon {LABELS[int(share.argmax())]}"
        elif share.min() > 0:
            out[w] = "lexicon common"
    return out


def _allowed(word: str, label: int, lexicon: dict[str, str]) -> list[float]:
    """Labels that a word of a text with ``label`` may have."""
    own = 1 if (script := _native(word)) == TAMIL else 2 if script == HINDI else None
    if own is None and label and lexicon.get(word) == f"lexicon {LABELS[label]}":
        own = label
    return [float(k == own) if own is not None else float(k in (0, label)) for k in range(_K)]


def _fit(texts: list[tuple[list[list[str]], int]]) -> Tagger:
    """Full-batch training by Adam on the penalized conditional likelihood."""
    sequences = [(s, label) for sentences, label in texts for s in sentences]
    lexicon = _lexicon(texts)
    types: dict[str, int] = {}
    for s, _ in sequences:
        for w in s:
            types.setdefault(w, len(types))
    features = [_with_lexicon(w, lexicon) for w in types]
    frequent = Counter(f for fs in features for f in fs)
    index: dict[str, int] = {}
    rows, cols = [], []
    for r, fs in enumerate(features):
        for f in fs:
            if frequent[f] > 1 or f[:2] == "w ":
                rows.append(r)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    # padded arrays in blocks of like length
    sequences.sort(key=lambda x: len(x[0]))
    blocks = []
    for a in range(0, len(sequences), 2048):
        some = sequences[a : a + 2048]
        lengths = np.array([len(s) for s, _ in some])
        ids = np.zeros((len(some), lengths.max()), dtype=np.int64)
        for r, (s, _) in enumerate(some):
            ids[r, : len(s)] = [types[w] for w in s]
        allowed = np.ones((*ids.shape, _K))
        for r, (s, label) in enumerate(some):
            allowed[r, : len(s)] = [_allowed(w, label, lexicon) for w in s]
        blocks.append((ids, allowed, np.array([label > 0 for _, label in some]), lengths, np.arange(lengths.max())[None, :] < lengths[:, None]))
    weights, moves = np.zeros((len(index), _K)), np.zeros((_K, _K))
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, ROUNDS + 1):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * (step - 1) / ROUNDS))
        scores = np.stack([np.bincount(rows, weights[cols, k], minlength=len(types)) for k in range(_K)], axis=1)
        of_types, of_moves = np.zeros_like(scores), np.zeros_like(moves)
        for ids, allowed, mixed, lengths, inside in blocks:
            free, of_free = _marginals(scores[ids], lengths, moves)
            told, of_told = _marginals(scores[ids], lengths, moves, allowed, mixed)
            flat, difference = ids[inside], (told - free)[inside]
            for k in range(_K):
                of_types[:, k] += np.bincount(flat, difference[:, k], minlength=len(types))
            of_moves += of_told - of_free
        grads = [np.stack([np.bincount(cols, of_types[rows, k], minlength=len(index)) for k in range(_K)], axis=1) - PENALTY * weights, of_moves - PENALTY * moves]
        for p, (x, g) in enumerate(zip((weights, moves), grads, strict=True)):
            m[p] = 0.9 * m[p] + 0.1 * g
            v[p] = 0.99 * v[p] + 0.01 * g * g
            x += rate * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.99**step)) + 1e-8)
    return Tagger(index, weights, moves, lexicon)


def train(rows: list[tuple[str, str]]) -> Tagger:
    """Fits on (text, label) rows, then again without the texts of which a sentence contradicts the label."""
    seen: dict[tuple[str, str], None] = {}
    for text, label in rows:
        if label in LABELS and text:
            seen.setdefault((plain_text(text), label))
    texts, labels, plain = [], [], []
    for text, label in seen:
        sentences = [w for s in sentences_of(text) if (w := _words(s))]
        if sentences and sum(map(len, sentences)) <= MAX_WORDS:
            texts.append((sentences, LABELS.index(label)))
            labels.append(label)
            plain.append(text)
    if not texts:
        return Tagger({}, np.zeros((0, _K)), np.zeros((_K, _K)), {})
    first = _fit(texts)
    keep = [k for k, parts in enumerate(first.sentences(plain)) if all(p[1] == labels[k] or p[2] < SURE for p in parts)]
    return _fit([texts[k] for k in keep]) if keep else first


def training_rows(runs: DataFrame, questions: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """A sample of labelled texts bounded by ``sample``: of the runs by label, of the questions by column; texts of many words are left out.

    So many characters hold more than ``MAX_WORDS`` words that the fit would leave the text out.
    """
    long = questions.select(F.coalesce(F.col("question_id").cast("string"), F.lit("")).alias("k"), F.explode(F.array(*(F.struct(F.col(c).alias("text"), F.lit(c).alias("label")) for c in LABELS))).alias("x")).select("k", "x.text", "x.label", F.lit("question").alias("source"))
    rows = long.unionByName(runs.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), F.col("original_query").alias("text"), F.col("language").alias("label"), F.lit("run").alias("source"))).filter(F.col("label").isin(*LABELS) & F.col("text").isNotNull() & (F.length("text") <= 20 * MAX_WORDS))
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("source", "label").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(x for (s, y), n in counts.items() for x in (F.lit(f"{s} {y}"), F.lit(min(1.0, sample / n)))))
    chosen = rows.filter(F.pmod(F.xxhash64("k", "source"), F.lit(1_000_003)) < share[F.concat_ws(" ", "source", "label")] * 1_000_003)
    return [(r[1], r[2]) for r in sorted(chosen.select("k", "text", "label").collect())]


def _of_text(segments: list[tuple[str, float, str]]) -> tuple[str, float]:
    """Language of most of a text's letters, with its confidence."""
    size: Counter[str] = Counter()
    sure: Counter[str] = Counter()
    for language, confidence, segment in segments:
        n = len(re.findall(r"\p{L}", segment))
        size[language] += n
        sure[language] += n * confidence
    most = max(size, key=lambda x: size[x])
    return most, sure[most] / size.total()


def text_segments(df: DataFrame, key: str, text: str, tagger: Tagger, label: str | None = None, whole: bool = False) -> DataFrame:
    """key, label, segment_no, language, confidence, segment, n_segments: the segments of every text.

    With ``whole`` also text_language and text_confidence, the text's own.

    ``label`` is carried along, null if there is none.  Null, empty and letterless texts have no segments; repeated
    rows stay repeated; texts of any length are labelled whole; an empty table gives no rows; other columns are not
    read.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distinct = {t: k for k, t in enumerate(dict.fromkeys(batch["text"]))}
            found = shared.value.segments([plain_text(t) for t in distinct])
            texts_ = [_of_text(x) if whole and x else () for x in found]
            rows = [
                (k, y, no, language, sure, s, len(found[distinct[t]]), *texts_[distinct[t]])
                for k, t, y in zip(batch["key"], batch["text"], batch["label"], strict=True)
                for no, (language, sure, s) in enumerate(found[distinct[t]])
            ]
            yield pd.DataFrame(rows, columns=["key", "label", "segment_no", "language", "confidence", "segment", "n_segments", *own])

    own = ["text_language", "text_confidence"] if whole else []
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None)).cast("string").alias("label")).filter(F.col("text").isNotNull())
    return spread(texts).mapInPandas(run, f"key {kind}, label string, segment_no int, language string, confidence double, segment string, n_segments int" + (", text_language string, text_confidence double" if whole else "")).withColumnRenamed("key", key)


def _asked(questions: DataFrame) -> DataFrame:
    """Each question once, whatever its repeats."""
    return questions.filter(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.min("tamil_english").alias("tamil_english"))


def all_segments(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """source_table, row_key, text_language, text_confidence, segment_no, language, confidence, segment, n_segments.

    Every segment of every run's query and, once each, of every question's Tamil-English text.  A text has the language
    of most of its letters' segments, the first one's of equals, and these segments' mean confidence by length times
    their share of the text.
    """
    tagger = train(training_rows(runs, questions))
    out = None
    for name, df, key, text in (("experiment_results", runs, "id", "original_query"), ("query_records", _asked(questions), "question_id", "tamil_english")):
        part = text_segments(df, key, text, tagger, whole=True).select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("row_key"), "text_language", "text_confidence", "segment_no", "language", "confidence", "segment", "n_segments")
        out = part if out is None else out.unionByName(part)
    return out


def mislabelled(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """source_table, row_key, segment_no, language: one row a segment of each text whose language isn't as labelled.

    Runs are compared with their label; questions, once each whatever their repeats, with Tamil-English.
    """
    tagger = train(training_rows(runs, questions))
    label = F.lower(F.btrim(F.coalesce("label", F.lit(""))))
    of_runs = text_segments(runs, "id", "original_query", tagger, "language").filter(label.isin(*NO_LABEL) | (F.col("n_segments") > 1) | (label != F.col("language")))
    of_questions = text_segments(_asked(questions), "question_id", "tamil_english", tagger).filter((F.col("n_segments") > 1) | (F.col("language") != TAMIL_MIX))
    return of_runs.select(F.lit("experiment_results").alias("source_table"), F.col("id").cast("string").alias("row_key"), "segment_no", "language").unionByName(
        of_questions.select(F.lit("query_records").alias("source_table"), F.col("question_id").cast("string").alias("row_key"), "segment_no", "language")
    )
