import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import leakage
from quillspark.llm.leakage import LeakFinder, contains, leaks, winnowed, words_of

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ran", "lim", "tok")]
DOCS = "doc_id bigint, text string, item_id bigint, passage string, doc string"
ITEMS = "item_id bigint, passage string, doc_id bigint, text string, block int"


def _passage(rng, n=40):
    words = [rng.choice(WORDS) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 10]).capitalize() for i in range(0, n, 10)) + "."


def _finds(passage, text):
    return LeakFinder([(1, passage)]).find([text])[0] == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=60))
def test_every_window_has_its_least_hash(hashes):
    h = np.array(hashes, dtype=np.uint64)
    kept = set(winnowed(h, 3).tolist())
    assert all(min(h[i : i + 3].tolist()) in kept for i in range(max(0, len(h) - 2)))


def test_planted_spans_with_changes_are_found():
    rng = random.Random(5)
    for _ in range(60):
        passage, filler = _passage(rng), " ".join(rng.choice(WORDS) for _ in range(80))
        words = words_of(passage)
        start = rng.randint(0, len(words) - 15)
        span = words[start : start + 15]
        for _ in range(3):
            k = rng.randrange(1, len(span) - 1)
            kind = rng.choice(["change", "drop", "add"])
            span = span[:k] + (["xxx"] if kind == "change" else [] if kind == "drop" else ["yyy", span[k]]) + span[k + 1 :]
        if len(span) >= 14:
            assert _finds(passage, filler + " " + " ".join(span) + " " + filler)


def test_what_is_no_leak():
    rng = random.Random(6)
    passage = _passage(rng)
    words = words_of(passage)
    assert not _finds(passage, " ".join(words[:12]))
    assert not _finds(passage, " ".join(w if i % 3 else "zzz" for i, w in enumerate(words)))
    assert not _finds(passage, " ".join(sorted(words)))
    assert not _finds(passage, _passage(rng, 200))


def test_layout_markup_and_foreign_sentences_do_not_matter():
    rng = random.Random(7)
    passage = _passage(rng)
    sentences = passage.split(". ")
    assert _finds(passage, passage.upper().replace(" ", "\n  "))
    assert _finds(passage, "".join(f"<p><b>{s}</b></p>\n" for s in sentences))
    assert _finds(passage, " An own sentence of quite another kind stands here. ".join(sentences[:2]))


def test_changes_and_foreign_sentences_together_are_found():
    foreign = ["An own sentence of quite another kind stands here", "Here follow other words that nobody has asked for"]
    rng = random.Random(9)
    for changed in ([3, 9, 12], [2, 5, 10], [4, 6, 11], [1, 6, 13]):
        words = rng.sample(WORDS, 16)
        passage = f"{' '.join(words[:8])}. {' '.join(words[8:])}."
        there = [w if k not in changed else "zzz" for k, w in enumerate(words)]
        for between in (foreign[:1], foreign):
            text = ". ".join([" ".join(there[:8]), *between, " ".join(there[8:])]) + "."
            assert _finds(passage, text)
            assert not _finds(passage, text.replace(words[7], "zzz"))
    # words added inside a sentence of the document stay changes
    words = rng.sample(WORDS, 16)
    there = [w if k not in (3, 9, 12) else "zzz" for k, w in enumerate(words)]
    assert not _finds(f"{' '.join(words[:8])}. {' '.join(words[8:])}.", f"So. {' '.join(there[:8])} yyy {' '.join(there[8:])}. Then.")


def test_frame_cases_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    passages = [_passage(rng) for _ in range(12)]
    items = [(i, p, 0, "x", 0) for i, p in enumerate(passages)] + [(0, passages[0], 0, "y", 1), (90, None, 0, "x", 0), (91, "", 0, "x", 0), (None, passages[1], 0, "x", 0)]
    docs = [(1, passages[3], 0, "x", "d"), (1, passages[3], 0, "x", "d"), (2, None, 0, "x", "d"), (3, "", 0, "x", "d"), (4, ("plain words go on " * 20_000) + passages[5], 0, "x", "d"), (5, passages[0] + passages[1], 0, "x", "d")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    expect = [(1, 3), (1, 3), (4, 5), (5, 0), (5, 1)]
    assert sorted(tuple(r) for r in leaks(d, i).collect()) == expect
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 1000)
    assert sorted(tuple(r) for r in leaks(d, i).collect()) == expect
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [3, 4, 9])
def test_runs_share_a_fingerprint(shared):
    rng = random.Random(shared)
    run = rng.sample(WORDS, shared)
    grams = lambda words: set(winnowed(leakage._kgrams(leakage._ids(words), leakage.K), leakage.WINDOW).tolist())
    for _ in range(50):
        a = rng.sample(WORDS, 20) + run + rng.sample(WORDS, 20)
        b = rng.sample(WORDS, 20) + run + rng.sample(WORDS, 20)
        assert grams(a) & grams(b)


def test_alignments_against_every_way(monkeypatch):
    """Fewest changes by plain recursion over every start and end."""
    rng = random.Random(12)

    def brute(doc, passage):
        for a in range(len(passage) - 14):
            for j0 in (j for j, w in enumerate(doc) if w == passage[a]):
                best = {j0: 0}
                for i in range(a + 1, len(passage)):
                    grown = {}
                    for j, c in best.items():
                        for k in range(j + 1, min(len(doc), j + 8)):  # k - j - 1 words added
                            cost = c + (k - j - 1) + (doc[k] != passage[i])
                            if doc[k] == passage[i] and i - a + 1 >= 15 and cost <= 0.2 * (i - a + 1) + 1e-9:
                                return True
                            grown[k] = min(grown.get(k, 99), cost)
                        grown[j] = min(grown.get(j, 99), c + 1)  # the passage's word dropped
                    best = {k: c for k, c in grown.items() if c <= 0.2 * len(passage)}
        return False

    yes = 0
    for _ in range(150):
        words = rng.sample(WORDS, 22)
        doc = [w for x in words for w in rng.choices([[x], ["zzz"], [], [x, "yyy"]], [8, 1, 1, 1])[0]]
        expect = brute(doc, words)
        yes += expect
        assert _finds(" ".join(words), " ".join(doc)) <= expect
        item = leakage._Item(1, " ".join(words))
        ids = leakage._ids(doc)
        assert contains([(ids, np.ones(len(doc), bool), item)], [list(range(8))])[0] == expect
    assert 20 < yes < 130


def test_long_passages_and_rare_pairs():
    rng = random.Random(13)
    passage = _passage(rng, 700)
    words = words_of(passage)
    assert _finds(passage, " ".join(words[500:520])) and not _finds(passage, " ".join(words[500:512]))
    common = [f"of the fee for {a} in {b} is due" for a, b in zip(WORDS, WORDS[1:], strict=False)][:60]
    items = [(k, " ".join(common[k : k + 3])) for k in range(50)]
    finder = LeakFinder(items)
    found = finder.find([p for _, p in items])
    assert all(k in some for (k, _), some in zip(items, found, strict=True))


def test_foreign_text_of_any_length_between_changed_sentences():
    rng = random.Random(14)
    for _ in range(40):
        words = rng.sample(WORDS, 24)
        passage = ". ".join(" ".join(words[k : k + 6]) for k in range(0, 24, 6)) + "."
        part = [w if k not in (2, 8, 13) else "zzz" for k, w in enumerate(words[:15])]
        foreign = lambda: " ".join("q" + rng.choice(WORDS) for _ in range(rng.randint(5, 300)))
        text = ". ".join([foreign(), " ".join(part[:6]), foreign(), " ".join(part[6:12]), foreign(), " ".join(part[12:]), foreign()]) + "."
        assert _finds(passage, text)
        assert not _finds(passage, text.replace(words[10], "yyy"))
