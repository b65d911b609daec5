import random

import numpy as np
import pytest

from quillspark.llm.languages import ENGLISH, HINDI, HINDI_MIX, TAMIL, TAMIL_MIX, _marginals, all_segments, mislabelled, sentences_of, text_segments, train

THINGS = ["gold loan", "family plan", "library card", "home loan", "bus pass", "hostel room"]
PATTERNS = {
    ENGLISH: ["How long does the {} take?", "What is the fee for the {}?", "Can I cancel the {} midway?", "Where should I complain about the {}?"],
    TAMIL_MIX: ["{}-ku enna documents kudukanum?", "{} vara evlo naal aagum?", "Ennoda {} yen reject aachu?", "{} renew pannanuma?"],
    HINDI_MIX: ["{} ke liye kya karna padega?", "Mera {} kab tak taiyar hoga?", "{} kitne ka hai?", "{} mein address kaise badlein?"],
}
RUNS = "id bigint, original_query string, language string, segment_no int, label string"
ASKED = "question_id string, english string, tamil_english string, hindi_english string, language string"


def _rows(n=40, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(p).format(rng.choice(THINGS)), label) for label, p in PATTERNS.items() for _ in range(n)]


@pytest.fixture(scope="module")
def tagger():
    noisy = [(t, ENGLISH if k % 25 == 0 else y) for k, (t, y) in enumerate(_rows())]
    return train(noisy)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gamma, expected = _marginals(scores, np.array([4]), moves)
    total, brute, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(scores[0, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, y in enumerate(path):
            brute[i, y] += w
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += w
    assert np.allclose(gamma[0], brute / total, atol=1e-6) and np.allclose(expected, pairs / total, atol=1e-6)


def test_held_out_accuracy(tagger):
    rows = _rows(60, 2)
    got = tagger.segments([t for t, _ in rows])
    assert np.mean([len(s) == 1 and s[0][0] == y for s, (_, y) in zip(got, rows, strict=True)]) >= 0.97


def test_segments_of_mixed_text(tagger):
    text = "How long does the gold loan take? bus pass kitne ka hai? Mera bus pass kab tak taiyar hoga?\nகடன் அட்டை எப்போது கிடைக்கும்? ऋण कार्ड कब मिलेगा?"
    found = tagger.segments([text])[0]
    assert [s[0] for s in found] == [ENGLISH, HINDI_MIX, TAMIL, HINDI]
    assert all(0.3 <= s[1] <= 1 for s in found)
    assert tagger.segments(["home loan-ல documents kudukanum?"])[0][0][0] == TAMIL_MIX
    assert tagger.segments(["", "12 ?!"]) == [[], []]
    assert sentences_of("Pay Rs. 5 now. Then go") == ["Pay Rs. 5 now.", "Then go"]


def test_frame_cases(spark, tagger):
    rows = [(i, t, y, 0, "x") for i, (t, y) in enumerate(_rows())]
    n = len(rows)
    rows += [(n, "What is the fee for the bus pass?", None, 0, "x"), (n + 1, "bus pass kitne ka hai?", ENGLISH, 0, "x"), (n + 2, None, None, 0, "x"), (n + 3, "", "unknown", 0, "x"), (n + 4, "What is the fee for the bus pass? " * 5000, ENGLISH, 0, "x")]
    asked = [(f"q{i}", *(PATTERNS[y][0].format("bus pass") for y in (ENGLISH, TAMIL_MIX, HINDI_MIX)), "x") for i in range(20)]
    asked += [("bad", "a", "ऋण कार्ड कब मिलेगा?", "b", "x"), ("bad", "a", "ऋण कार्ड कब मिलेगा?", "b", "x"), (None, "a", "b", "c", "x"), ("null", "a", None, "c", "x")]
    found = sorted(tuple(r) for r in mislabelled(spark.createDataFrame(rows, RUNS), spark.createDataFrame(asked, ASKED)).collect())
    assert found == [("experiment_results", str(n), 0, ENGLISH), ("experiment_results", str(n + 1), 0, HINDI_MIX), ("query_records", "bad", 0, HINDI)]
    assert mislabelled(spark.createDataFrame([], RUNS), spark.createDataFrame([], ASKED)).count() == 0
    assert text_segments(spark.createDataFrame(rows[:1] * 2, RUNS), "id", "original_query", tagger).count() == 2


def test_every_text_of_both_tables_has_its_language_and_confidence(spark):
    runs = [(i, t, y, 0, "x") for i, (t, y) in enumerate(_rows())]
    n = len(runs)
    runs += [(n, "How long does the gold loan take? What is the fee for the bus pass? Mera bus pass kab tak taiyar hoga?", ENGLISH, 0, "x"), (n + 1, None, ENGLISH, 0, "x")]
    asked = [(f"q{i}", *(PATTERNS[y][0].format("bus pass") for y in (ENGLISH, TAMIL_MIX, HINDI_MIX)), "x") for i in range(20)]
    asked += [("bad", "a", "ऋण कार्ड कब मिलेगा?", "b", "x"), ("bad", "a", "ऋण कार्ड कब मिलेगा?", "b", "x")]
    got = all_segments(spark.createDataFrame(runs, RUNS), spark.createDataFrame(asked, ASKED)).collect()
    assert {r.row_key: r.text_language for r in got if r.source_table == "query_records"} == {f"q{i}": TAMIL_MIX for i in range(20)} | {"bad": HINDI}
    assert {r.row_key for r in got if r.source_table == "experiment_results"} == {str(i) for i in range(n + 1)}
    assert len(got) == n + 2 + 21 and all(0 < r.text_confidence <= 1 for r in got)
    mixed = [r for r in got if r.source_table == "experiment_results" and r.row_key == str(n)]
    assert sorted((r.segment_no, r.language) for r in mixed) == [(0, ENGLISH), (1, HINDI_MIX)] and {r.text_language for r in mixed} == {ENGLISH}
