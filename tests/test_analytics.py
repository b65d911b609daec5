import math
from itertools import product

import pytest

from quillspark.functions.stats import benjamini_hochberg, wilcoxon_p
from quillspark.operators import analytics as an

SCHEMA = "id bigint, experiment_id string, question_id string, language string, mitigation_enabled boolean, faithfulness_score double, hallucination_flag boolean, generated_answer string, retrieved_context string, recall_at_1 double, recall_at_3 double, recall_at_5 double"


def _row(i, q="Q1", lang="english", mit=False, score=0.9, flag=False, answer="a", context="c", exp="e"):
    return (i, exp, q, lang, mit, score, flag, answer, context, 1.0, 1.0, None)


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_validation_cascade(spark):
    rows = [
        _row(1), _row(2), _row(3, q="Q2", score=1.5), _row(4, q="Q2"), _row(5, q=""), _row(6, lang=None), _row(7, mit=None), _row(8, score=None), _row(9, flag=None), _row(10, answer=""), _row(11, context=None),
        _row(12, q="Q3", score=math.nan), _row(13, q="Q4", exp=None), _row(14, q="Q5", score=None), _row(15, q="Q5"),
    ]
    got = {r.id: r.exclusion_reason for r in an.validate_records(_frame(spark, rows)).collect()}
    bounds = "invalid faithfulness score outside [0.0, 1.0]"
    assert got == {
        1: None, 2: "duplicate record", 3: bounds, 4: "duplicate record", 5: "missing question_id", 6: "missing language", 7: "missing mitigation condition", 8: "missing faithfulness score",
        9: "missing hallucination flag", 10: "missing answer", 11: "missing retrieved context", 12: None, 13: None, 14: "missing faithfulness score", 15: None,
    }
    assert sum(r.n for r in an.exclusion_reasons(_frame(spark, rows)).collect()) == len(rows)
    assert an.validate_records(_frame(spark, [])).count() == 0


def test_condition_stats(spark):
    valid = an.valid_records(_frame(spark, [_row(1, score=0.8), _row(2, q="Q2", score=0.4, flag=True), _row(3, q="Q3", lang="tamil_english", score=0.5), _row(4, q="Q4", lang="klingon")]))
    got = {r.condition: r for r in an.condition_stats(valid).collect()}
    assert len(got) == 6
    e = got["english_baseline"]
    assert (e.n, e.mean, e.median, e.hallucination_rate, e.min, e.max) == (2, 0.6, 0.6, 0.5, 0.4, 0.8) and e.std == pytest.approx(0.2828)
    assert got["tamil_english_baseline"].std == 0.0 and got["hindi_english_mitigated"].n == 0 and got["hindi_english_mitigated"].mean is None
    r = {x.condition: x for x in an.recall_stats(valid).collect()}["english_baseline"]
    assert (r.mean_recall_at_1, r.mean_recall_at_5, r.n_with_recall) == (1.0, None, 2)
    assert an.dashboard_overview(valid).first().status == "ok" and an.dashboard_overview(valid.limit(0)).first().status == "empty"
    assert an.dashboard_filter(valid, hallucination=True).count() == 1
    assert an.chart_data(an.condition_stats(valid)).first().mean["english_baseline"] == 0.6


def test_pairs_and_status_ladder(spark):
    rows = [_row(1, "Q1", score=0.9), _row(2, "Q1", "tamil_english", score=0.7), _row(3, "Q2", score=0.8), _row(4, "Q2", "tamil_english", score=0.6), _row(5, "Q3", score=0.5)]
    rows += [_row(6, "Q1", "hindi_english", score=0.9), _row(7, "Q2", "hindi_english", score=0.8), _row(8, "Q1", score=0.95, exp="later"), _row(9, "Q1", "hindi_english", score=0.95, exp="later")]
    scores = an.last_scores(an.valid_records(_frame(spark, rows)))
    diffs = an.paired_diffs(scores)
    got = {(r.cond1, r.cond2): r for r in an.paired_comparisons(diffs).collect()}
    t = got["english_baseline", "tamil_english_baseline"]
    assert (t.n, t.status, t.statistic) == (2, "TESTED", 0.0) and t.mean_diff == pytest.approx(0.225) and t.p_value == 0.5 and not t.significant
    assert got["english_baseline", "hindi_english_baseline"].status == "NOT TESTABLE"
    assert got["tamil_english_mitigated", "english_baseline"].status == "INSUFFICIENT DATA" and got["tamil_english_mitigated", "english_baseline"].mean_diff is None
    lost = {(r.question_id, r.cond1, r.cond2, r.missing) for r in an.missing_pairs(scores).collect()}
    assert ("Q3", "english_baseline", "tamil_english_baseline", "missing_cond2") in lost and ("Q1", "tamil_english_mitigated", "english_baseline", "missing_cond1") in lost


def test_criterion_boundary(spark):
    stats = lambda e, t: spark.createDataFrame([("english_baseline", e), ("tamil_english_mitigated", t), ("hindi_english_mitigated", None)], "condition string, mean double")
    status = lambda e, t: {r.condition: r.status for r in an.success_criterion(stats(e, t)).collect()}
    assert status(0.8, 0.7) == {"tamil_english_mitigated": "NOT MET", "hindi_english_mitigated": "INSUFFICIENT DATA"}
    assert status(1.0, 0.9)["tamil_english_mitigated"] == "MET" and status(None, 0.9)["tamil_english_mitigated"] == "INSUFFICIENT DATA"


def test_exact_p_against_all_signs():
    for n in (1, 3, 6, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert wilcoxon_p(w, n, 0, True) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / len(sums)))
    assert wilcoxon_p(0, 0, 0, False) == 1.0
    assert wilcoxon_p(100.0, 30, 0, False) == pytest.approx(wilcoxon_p(100, 30, 0, True), abs=0.01)


def test_rank_sums_with_ties(spark):
    diffs = spark.createDataFrame([("q", "a", "b", d) for d in (0.1, -0.1, 0.2, 0.0, 0.30000000000000004, -0.3)], "question_id string, cond1 string, cond2 string, diff double")
    r = an.rank_sums(diffs).first()
    assert (r.n_nonzero, r.w_plus, r.w_minus, r.tie_term) == (5, 1.5 + 3 + 4.5, 1.5 + 4.5, 12)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p_value double")
    assert {r.k: r.q_value for r in benjamini_hochberg(df).collect()} == {1: pytest.approx(0.03), 2: pytest.approx(0.04), 3: pytest.approx(0.04), 4: None}
