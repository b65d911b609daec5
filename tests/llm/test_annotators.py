import random

import pytest

from quillspark.llm import annotators
from quillspark.llm.annotators import DECISIONS, consensus, disputed, krippendorff, reliability, review_labels

LABELS = "item string, who string, decision string, score int, kind string, label string"


def _labels(spark, rows):
    return spark.createDataFrame(rows, "item string, who string, decision string, score int")


def test_recovers_planted_classes_and_bad_annotators(spark):
    rng = random.Random(3)
    truth = {f"i{k}": rng.choice(DECISIONS) for k in range(300)}
    turned = dict(zip(DECISIONS, DECISIONS[1:] + DECISIONS[:1], strict=True))
    rows = []
    for item, t in truth.items():
        for who in rng.sample(["good1", "good2", "good3", "fair", "noise", "turned"], 4):
            right = rng.random() < {"fair": 0.7}.get(who, 0.95)
            d = rng.choice(DECISIONS) if who == "noise" else turned[t] if who == "turned" else t if right else rng.choice(DECISIONS)
            rows.append((item, who, d, None))
    fit = consensus(_labels(spark, rows))
    got = {r["item"]: r.verdict for r in fit.items.collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 285
    rel = {r.reviewer: r for r in reliability(fit).collect()}
    assert {w for w, r in rel.items() if r.unreliable} == {"noise", "turned"}
    assert all(r.low <= r.reliability <= r.high for r in rel.values())


def test_krippendorff_by_hand(spark):
    rows = [("a", "x", "ACCEPT", 1), ("a", "y", "ACCEPT", 1), ("b", "x", "ACCEPT", 2), ("b", "y", "REJECT", 2), ("c", "x", "REJECT", 3), ("c", "y", "REJECT", 3), ("d", "x", "REVISE", None)]
    alpha = {r.kind: r.alpha for r in krippendorff(_labels(spark, rows)).collect()}
    # coincidences: 2 differ of 6; expected 2*3*3/5 of 6
    assert alpha["decision"] == pytest.approx(1 - (2 / 6) / (2 * 3 * 3 / 5 / 6))
    assert alpha["score"] == pytest.approx(1.0)


def test_sheet_cases(spark):
    cols = ["question_id", "language_variant"] + [f"reviewer_{n}_{c}" for n in (1, 2) for c in ("id", "decision", "semantic_preservation_1to5")] + ["item", "who"]
    schema = ", ".join(f"{c} string" for c in cols)
    row = ("q", "v", " rev-1 ", "Reject.", "1/5", "REV-2", "rejected", " one", "i", "w")
    rows = [row, row, (None, "v", "a", "ACCEPT", "5", None, None, None, None, None), ("q2", "v", "", None, "N/A", None, "PENDING", "9", None, None)]
    labels = review_labels(spark.createDataFrame(rows, schema))
    assert sorted((r["item"], r.who, r.decision, r.score) for r in labels.collect()) == [("q|v", "REV-1", "REJECT", 1), ("q|v", "REV-2", "REJECT", 1)]
    assert [tuple(r) for r in disputed(spark.createDataFrame(rows, schema)).collect()] == [("item", "q|v", "REJECT")]
    assert disputed(spark.createDataFrame([], schema)).count() == 0


def test_joins_give_the_same_fit(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"i{k}", f"w{rng.randrange(6)}", rng.choice(DECISIONS) if rng.random() < 0.4 else DECISIONS[k % 3], rng.choice([None, 1, 3, 5])) for k in range(120) for _ in range(4)]
    one = consensus(_labels(spark, rows))
    monkeypatch.setattr(annotators, "SMALL_ANNOTATORS", 0)
    monkeypatch.setattr(annotators, "ROUNDS", one.rounds)
    two = consensus(_labels(spark, rows))
    assert one.converged and one.rounds > 2
    a, b = ({r["item"]: (r.verdict, r.p_revise, r.n_decisions) for r in f.items.collect()} for f in (one, two))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-3) and a[k][2] == b[k][2] for k in a)
    assert {(r.reviewer, r.unreliable) for r in reliability(one).collect()} == {(r.reviewer, r.unreliable) for r in reliability(two).collect()}


def test_few_decisions_that_tell_nothing_are_flagged(spark):
    rng = random.Random(6)
    kinds = ["ACCEPT"] * 6 + ["REVISE"] * 3 + ["REJECT"]
    rows = [(f"i{k}", f"good{g}", kinds[k % 10], None) for k in range(200) for g in range(3)]
    rows += [(f"i{k}", "contrary", "REVISE", None) for k in range(0, 50, 10)]  # five items that are to be accepted
    rows += [(f"i{k}", "always", "ACCEPT", None) for k in range(20)]
    rows += [(f"i{k}", "random", rng.choice(DECISIONS), None) for k in range(100, 130)]
    rows += [(f"i{k}", "fair", kinds[k % 10] if k % 3 else rng.choice(DECISIONS), None) for k in range(150, 190)]
    got = {r.reviewer: r.unreliable for r in reliability(consensus(_labels(spark, rows))).collect()}
    assert {w for w, bad in got.items() if bad} == {"contrary", "always", "random"}
