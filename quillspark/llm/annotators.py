"""Problem 2: consensus, agreement and annotator reliability from labels that disagree.

A mean-field variational confusion model.  Every item has a true class; every annotator has, for each kind of label
they give (a decision, a score), one row of label probabilities per class.  Class shares and rows have Dirichlet
priors.  Each round scores the items with the expected logarithms of the rows (digamma of the counts), then counts
labels by annotator with the items' class probabilities: a group-by of the items' labels, made once, and one of the
labels' counts each round.  Rounds end by the variational bound.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.tables import cut

DECISIONS = ("ACCEPT", "REVISE", "REJECT")
# Other spellings of the decisions and scores.
SPELLINGS = {"ACCEPT": "ACCEPT", "ACCEPTED": "ACCEPT", "REVISE": "REVISE", "REVISED": "REVISE", "REJECT": "REJECT", "REJECTED": "REJECT"}
NUMBER_WORDS = ("ONE", "TWO", "THREE", "FOUR", "FIVE")

#: Dirichlet priors of an annotator's rows: a decision is likelier right than wrong, a score falls from ACCEPT to REJECT.
DECISION_PRIOR = ((3.0, 1.0, 1.0), (1.0, 3.0, 1.0), (1.0, 1.0, 3.0))
SCORE_PRIOR = ((0.5, 0.5, 1.0, 2.0, 2.0), (0.5, 1.0, 2.0, 1.0, 0.5), (2.0, 2.0, 1.0, 0.5, 0.5))
#: Rounds at most, and the relative growth of the bound at which they end.
ROUNDS, TOLERANCE = 200, 1e-6
#: Rows of (annotator, kind, label) up to which they are held in memory and broadcast (24 bytes each); more are joined.
SMALL_ANNOTATORS = 500_000
#: An annotator under this informedness tells next to nothing; so many decisions it takes to say so, and so many expected items for a class to count.
UNINFORMED, MIN_DECISIONS, SEEN = 0.25, 5, 0.75

_K = range(len(DECISIONS))


def usable_decision(raw: Column) -> Column:
    """ACCEPT, REVISE or REJECT in any spelling; null for anything else."""
    key = F.regexp_replace(F.upper(raw), "[^A-Z]", "")
    return F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv))[F.coalesce(key, F.lit(""))]


def usable_score(raw: Column) -> Column:
    """1 to 5 from '4', ' 4', '4.0', '4/5', 'four'; null for anything else."""
    key = F.upper(F.btrim(raw))
    words = F.coalesce(*(F.when(key == w, F.lit(k + 1)) for k, w in enumerate(NUMBER_WORDS)))
    return F.coalesce(words, F.try_element_at(F.array(*(F.lit(k) for k in range(1, 6))), F.regexp_extract(F.coalesce(key, F.lit("")), r"^([1-5])(?:\.0+)?(?:\s*/\s*5)?$", 1).try_cast("int")))


def annotator_id(raw: Column) -> Column:
    """Upper case without blanks; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(raw), r"\s+", ""), F.lit(""))


def review_labels(sheet: DataFrame) -> DataFrame:
    """(item, who, decision, score) of a review sheet; exact repeats of a row count once.

    Rows without question or variant are dropped; a label without an annotator counts as one by ''.  Repeats are told by
    128 bits of hashes over all columns, so that only labels are shuffled, not comments and queries.
    """
    item = F.concat("question_id", F.lit("|"), "language_variant")
    labels = [
        F.struct(
            F.coalesce(annotator_id(F.col(f"reviewer_{n}_id")), F.lit("")).alias("who"),
            usable_decision(F.col(f"reviewer_{n}_decision")).alias("decision"),
            usable_score(F.col(f"reviewer_{n}_semantic_preservation_1to5")).alias("score"),
        )
        for n in (1, 2)
    ]
    whole = [F.struct(F.xxhash64(*sheet.columns).alias("a"), F.xxhash64(F.lit(1), *sheet.columns).alias("b")).alias("row")]
    rows = sheet.select(item.alias("item"), F.filter(F.array(*labels), lambda x: x["decision"].isNotNull() | x["score"].isNotNull()).alias("labels"), *whole)
    return rows.filter("item is not null and size(labels) > 0").distinct().select("item", F.explode("labels").alias("x")).select("item", "x.*")


@dataclass
class Consensus:
    """``items``: item, verdict, confidence, p_accept, p_revise, p_reject, n_decisions.  ``counts``: who, kind, label, n0, n1, n2.

    ``rounds`` it took; ``converged`` is false where ``ROUNDS`` came first.
    """

    items: DataFrame
    counts: DataFrame
    rounds: int
    converged: bool


def _long(labels: DataFrame) -> DataFrame:
    """item, who, kind, label, times: equal labels of an annotator for an item are one row."""
    code = F.create_map(*(x for k, d in enumerate(DECISIONS) for x in (F.lit(d), F.lit(k))))
    kinds = F.array(F.struct(F.lit("decision").alias("kind"), code[F.col("decision")].alias("label")), F.struct(F.lit("score").alias("kind"), (F.col("score") - 1).alias("label")))
    rows = labels.select("item", "who", F.explode(kinds).alias("x")).select("item", "who", "x.kind", "x.label").filter("label is not null")
    return rows.groupBy("item", "who", "kind", "label").agg(F.count("*").cast("int").alias("times"))


def consensus(labels: DataFrame) -> Consensus:
    """Fits the model to labels (item, who, decision, score).

    Items without a usable decision have no verdict and are left out; null labels say nothing; equal labels of an
    annotator for an item count as often as they are given; ties between classes go to the first of ACCEPT, REVISE,
    REJECT; an empty table gives empty results; other columns are not read.  Rounds end when the variational bound
    hardly grows; not to reach that within ``ROUNDS`` warns.
    """
    long = cut(_long(labels))
    annotators = cut(long.select("who", "kind", "label").distinct())
    n = annotators.count()
    fit = _by_items(long, annotators, n) if n <= SMALL_ANNOTATORS else _by_joins(long)
    if not fit.converged:
        warnings.warn(f"the labels' model did not converge in {ROUNDS} rounds", stacklevel=2)
    return fit


# --- annotators' rows fit into memory: one row an item, one narrow pass a round -----------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """Six steps of the recurrence, then the asymptotic series (error under 1e-9 for x > 0)."""
    y = x + 6.0
    f = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240)))) - sum(1.0 / (x + i) for i in range(6))


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass
class _Rows:
    """The annotators' rows in memory: per code its row (annotator and kind) and prior; the expected logarithms of a round."""

    row: np.ndarray
    prior: np.ndarray
    log_theta: np.ndarray
    log_share: np.ndarray

    def update(self, counts: np.ndarray, shares: np.ndarray) -> float:
        """M-step from expected counts; the divergence of the new Dirichlets from their priors."""
        posterior = self.prior + counts
        self.log_theta, far = self._dirichlets(posterior)
        total = 1.0 + shares
        self.log_share = digamma(total) - digamma(total.sum(keepdims=True))
        ends = _log_gamma(total.sum()) - _log_gamma(total).sum() - _log_gamma(np.array(float(len(total))))
        return far + float(ends + (shares * self.log_share).sum())

    def _dirichlets(self, posterior: np.ndarray) -> tuple[np.ndarray, float]:
        rows = int(self.row.max(initial=-1)) + 1
        by_row = lambda x: np.stack([np.bincount(self.row, x[:, k], minlength=rows) for k in _K], axis=1)
        # labels that an annotator never gave are a rest of the row's prior
        rest = self.full - by_row(self.prior)
        sums = by_row(posterior) + rest
        logs = digamma(posterior) - digamma(sums)[self.row]
        prior_sums = by_row(self.prior) + rest
        far = (_log_gamma(sums) - _log_gamma(prior_sums)).sum() - (_log_gamma(posterior) - _log_gamma(self.prior)).sum() + ((posterior - self.prior) * logs).sum()
        return logs, float(far)

    full: np.ndarray | float = 0.0


def _coded(annotators: pd.DataFrame) -> _Rows:
    """Codes are the rows of ``annotators`` (who, kind, label) in order."""
    keys = annotators["who"] + "\0" + annotators["kind"]
    row = np.unique(keys, return_inverse=True)[1] if len(keys) else np.empty(0, np.int64)
    prior = np.array([[(DECISION_PRIOR if kind == "decision" else SCORE_PRIOR)[k][label] for k in _K] for kind, label in zip(annotators["kind"], annotators["label"], strict=True)]).reshape(-1, len(_K))
    full = np.zeros((int(row.max(initial=-1)) + 1, len(_K)))
    for r, kind in zip(row, annotators["kind"], strict=True):
        full[r] = [sum((DECISION_PRIOR if kind == "decision" else SCORE_PRIOR)[k]) for k in _K]
    out = _Rows(row, prior, np.zeros_like(prior), np.zeros(len(_K)), full)
    out.update(np.zeros_like(prior), np.zeros(len(_K)))
    out.log_share = np.zeros(len(_K))
    return out


def _posteriors(codes: pa.ListArray, times: pa.ListArray, log_theta: np.ndarray, log_share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class probabilities and log normalizer of each item; code, times and item of each label)."""
    code, time = codes.flatten().to_numpy(), times.flatten().to_numpy()
    sizes = pc.list_value_length(codes).to_numpy()
    item = np.repeat(np.arange(len(sizes)), sizes)
    score = np.stack([np.bincount(item, log_theta[code, k] * time, minlength=len(sizes)) + log_share[k] for k in _K], axis=1)
    top = score.max(axis=1, keepdims=True)
    q = np.exp(score - top)
    total = q.sum(axis=1, keepdims=True)
    return q / total, (np.log(total) + top)[:, 0], code, time, item


def _by_items(long: DataFrame, annotators: DataFrame, n: int) -> Consensus:
    """One row an item with its labels as codes: a round is one pass without a shuffle but of a row a code and task.

    ``annotators`` has ``n`` rows, at most ``SMALL_ANNOTATORS``: they are held by the driver and broadcast.
    """
    spark = long.sparkSession
    known = annotators.toPandas().sort_values(["who", "kind", "label"]).reset_index(drop=True)
    rows = _coded(known)
    code = spark.createDataFrame(known.assign(code=np.arange(n, dtype=np.int32)), "who string, kind string, label int, code int")
    decided = F.sum(F.when(F.col("kind") == "decision", F.col("times")).otherwise(0))
    coded = long.join(F.broadcast(code), ["who", "kind", "label"])
    items = cut(coded.groupBy("item").agg(F.collect_list(F.struct("code", "times")).alias("x"), decided.cast("bigint").alias("n_decisions")).filter("n_decisions > 0").select("item", "n_decisions", F.col("x.code").alias("codes"), F.col("x.times").alias("times")))

    def expect(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_theta, log_share = shared.value
            sums, bound, shares = np.zeros_like(log_theta), 0.0, np.zeros(len(_K))
            for batch in batches:
                q, log_total, code, times, item = _posteriors(batch.column(0), batch.column(1), log_theta, log_share)
                bound += log_total.sum()
                shares += q.sum(axis=0)
                for k in _K:
                    sums[:, k] += np.bincount(code, q[item, k] * times, minlength=len(sums))
            some = np.flatnonzero(sums.any(axis=1))
            yield pa.record_batch([pa.array([*some, -1], pa.int32()), *(pa.array([*sums[some, k], shares[k]], pa.float64()) for k in _K), pa.array([*np.zeros(len(some)), bound], pa.float64())], ["code", "n0", "n1", "n2", "bound"])

        return run

    before, rounds, converged = -math.inf, 0, n == 0
    counts = np.zeros_like(rows.prior)
    far = 0.0
    while rounds < ROUNDS and not converged:
        rounds += 1
        shared = spark.sparkContext.broadcast((rows.log_theta, rows.log_share))
        parts = items.select("codes", "times").mapInArrow(expect(shared), "code int, n0 double, n1 double, n2 double, bound double")
        sums = parts.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n2", "bound"))).toPandas().set_index("code")
        shared.unpersist()
        if -1 not in sums.index or sums.loc[-1, ["n0", "n1", "n2"]].sum() == 0:
            break
        bound = sums.loc[-1, "bound"] - far
        counts = sums.drop(-1).reindex(range(n), fill_value=0.0)[["n0", "n1", "n2"]].to_numpy()
        far = rows.update(counts, sums.loc[-1, ["n0", "n1", "n2"]].to_numpy(dtype=float))
        converged = abs(bound - before) <= TOLERANCE * abs(bound)
        before = bound
    final = spark.sparkContext.broadcast((rows.log_theta, rows.log_share))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _posteriors(batch.column(2), batch.column(3), *final.value)[0]
            best = pa.array(np.array(DECISIONS, dtype=object)[q.argmax(axis=1)].tolist() if len(q) else [], pa.string())
            yield pa.record_batch([batch.column(0), best, pa.array(q.max(axis=1, initial=0)), *(pa.array(q[:, k]) for k in _K), batch.column(1)], ["item", "verdict", "confidence", "p_accept", "p_revise", "p_reject", "n_decisions"])

    judged = items.select("item", "n_decisions", "codes", "times").mapInArrow(decide, "item string, verdict string, confidence double, p_accept double, p_revise double, p_reject double, n_decisions bigint")
    told = spark.createDataFrame(known.assign(n0=counts[:, 0], n1=counts[:, 1], n2=counts[:, 2]), "who string, kind string, label int, n0 double, n1 double, n2 double")
    return Consensus(judged, told, rounds, converged or rounds == 0)


# --- annotators without bound: the same rounds by joins --------------------------------------------------------------


def _by_joins(long: DataFrame) -> Consensus:
    """The rounds as joins and group-bys, for annotators in any number; nothing but totals reaches the driver."""
    of_item = Window.partitionBy("item")
    decided = F.sum(F.when(F.col("kind") == "decision", F.col("times"))).over(of_item)
    base = cut(long.withColumn("decided", decided).filter("decided > 0").withColumn("share", 1.0 / F.count("*").over(of_item)))
    theta = base.select("who", "kind", "label").distinct().select("who", "kind", "label", *((_digamma(_prior(k)) - _digamma(_row_prior(k))).alias(f"e{k}") for k in _K))
    log_share, before, converged, rounds = [0.0, 0.0, 0.0], -math.inf, False, 0
    while rounds < ROUNDS and not converged:
        rounds += 1
        scored = _scored(base, theta, log_share)
        counts = cut(scored.groupBy("who", "kind", "label").agg(*(F.sum(F.col(f"q{k}") * F.col("times")).alias(f"n{k}") for k in _K), *(F.sum(F.col(f"q{k}") * F.col("share")).alias(f"c{k}") for k in _K), F.sum(F.col("log_total") * F.col("share")).alias("fit")))
        *seen, fit = (x or 0.0 for x in counts.agg(*(F.sum(f"c{k}") for k in _K), F.sum("fit")).first())
        totals = np.array([1.0 + x for x in seen])
        log_share = (digamma(totals) - digamma(totals.sum(keepdims=True))).tolist()
        at = Window.partitionBy("who", "kind")
        theta = counts.select("who", "kind", "label", *((_digamma(F.col(f"n{k}") + _prior(k)) - _digamma(F.sum(f"n{k}").over(at) + _row_prior(k))).alias(f"e{k}") for k in _K))
        converged = not fit or abs(fit - before) <= TOLERANCE * abs(fit)
        before = fit
    best = F.greatest("q0", "q1", "q2")
    items = _scored(base, theta, log_share).groupBy("item").agg(*(F.first(f"q{k}").alias(f"q{k}") for k in _K), F.first("decided").alias("n_decisions"))
    items = items.select(
        "item", F.when(F.col("q0") == best, DECISIONS[0]).when(F.col("q1") == best, DECISIONS[1]).otherwise(DECISIONS[2]).alias("verdict"), best.alias("confidence"),
        F.col("q0").alias("p_accept"), F.col("q1").alias("p_revise"), F.col("q2").alias("p_reject"), "n_decisions",
    )
    return Consensus(items, counts, rounds, converged)


def _digamma(x: Column) -> Column:
    """:func:`digamma` of a column."""
    y = x + 6.0
    f = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240))))
    return reduce(lambda acc, i: acc - 1.0 / (x + float(i)), range(6), series)


def _prior(k: int) -> Column:
    """Of the row for class k, at column ``label``, by column ``kind``."""
    pick = lambda row: F.array(*(F.lit(v) for v in row))[F.col("label")]
    return F.when(F.col("kind") == "decision", pick(DECISION_PRIOR[k])).otherwise(pick(SCORE_PRIOR[k]))


def _row_prior(k: int) -> Column:
    return F.when(F.col("kind") == "decision", F.lit(sum(DECISION_PRIOR[k]))).otherwise(F.lit(sum(SCORE_PRIOR[k])))


def _scored(base: DataFrame, theta: DataFrame, log_share: list[float]) -> DataFrame:
    """``base`` with the class probabilities q0, q1, q2 of each row's item and their log normalizer."""
    of_item = Window.partitionBy("item")
    joined = base.join(theta, ["who", "kind", "label"])
    s = joined.select("*", *((F.sum(F.col(f"e{k}") * F.col("times")).over(of_item) + log_share[k]).alias(f"s{k}") for k in _K))
    s = s.withColumn("top", F.greatest("s0", "s1", "s2"))
    s = s.select("*", *(F.exp(F.col(f"s{k}") - F.col("top")).alias(f"x{k}") for k in _K))
    total = F.col("x0") + F.col("x1") + F.col("x2")
    return s.select("item", "who", "kind", "label", "times", "share", "decided", (F.log(total) + F.col("top")).alias("log_total"), *((F.col(f"x{k}") / total).alias(f"q{k}") for k in _K))


def reliability(fit: Consensus) -> DataFrame:
    """Per annotator: n_decisions, reliability, its 95 % posterior interval, informedness, unreliable.

    Reliability is the mean, over the classes that the annotator's items have, of the posterior share of right
    decisions under a flat prior of one decision; its interval is the normal approximation of that mean of Beta
    posteriors.  Informedness is the mean over these classes of how much likelier the annotator says a class of its own
    items than of others: 0 for whoever decides without regard to the items, whatever decisions they favour, below 0
    for whoever contradicts them, 1 for whoever is always right.  Where all items have one class, it is the share of
    right decisions above chance.
    """
    d = fit.counts.filter("kind = 'decision' and who <> ''")
    said = lambda label, k: F.sum(F.when(F.col("label") == label, F.col(f"n{k}")).otherwise(0.0))
    g = d.groupBy("who").agg(*(F.sum(f"n{k}").alias(f"r{k}") for k in _K), *(said(y, k).alias(f"s{y}{k}") for y in _K for k in _K))
    n, chance = F.col("r0") + F.col("r1") + F.col("r2"), 1 / len(DECISIONS)
    seen = [F.col(f"r{k}") >= SEEN for k in _K]
    number = sum((F.when(s, 1.0).otherwise(0.0) for s in seen), F.lit(0.0))
    over = lambda parts: F.try_divide(sum((F.when(s, p).otherwise(0.0) for s, p in zip(seen, parts, strict=True)), F.lit(0.0)), number)
    right = [(F.col(f"s{k}{k}") + chance) / (F.col(f"r{k}") + 1.0) for k in _K]
    wrong = [(sum((F.col(f"s{k}{j}") for j in _K if j != k), F.lit(0.0)) + chance) / (n - F.col(f"r{k}") + 1.0) for k in _K]
    mean = over(right)
    spread = F.sqrt(F.try_divide(over([p * (1 - p) / (F.col(f"r{k}") + 2.0) for k, p in enumerate(right)]), number))
    informed = F.when(number > 1, over([p - w for p, w in zip(right, wrong, strict=True)])).otherwise((mean - chance) / (1 - chance))
    count = F.round(n).cast("bigint")
    return g.select(
        F.col("who").alias("reviewer"), count.alias("n_decisions"), mean.alias("reliability"), F.greatest(F.lit(0.0), mean - 1.96 * spread).alias("low"), F.least(F.lit(1.0), mean + 1.96 * spread).alias("high"),
        informed.alias("informedness"), F.coalesce((count >= MIN_DECISIONS) & (informed < UNINFORMED), F.lit(False)).alias("unreliable"),
    )


def krippendorff(labels: DataFrame) -> DataFrame:
    """One row a kind: kind, alpha, n_items, n_labels.  Decisions are nominal, scores an interval scale.

    Items with one label of a kind can't disagree and are left out; alpha is null where nothing could disagree.
    """
    long = labels.select("item", F.explode(F.array(F.struct(F.lit("decision").alias("kind"), F.array_position(F.array(*map(F.lit, DECISIONS)), F.col("decision")).alias("v")), F.struct(F.lit("score").alias("kind"), F.col("score").cast("bigint").alias("v")))).alias("x")).select("item", "x.*").filter("v is not null and v > 0")
    values = range(1, 6)
    per_item = long.groupBy("kind", "item").agg(F.count("*").alias("m"), *(F.count_if(F.col("v") == v).alias(f"v{v}") for v in values)).filter("m > 1")
    far = lambda a, b: F.when(F.col("kind") == "decision", F.lit(1.0)).otherwise(F.lit(float((a - b) ** 2)))
    pairs = [(a, b) for a in values for b in values if a < b]
    seen = sum((2.0 * F.col(f"v{a}") * F.col(f"v{b}") * far(a, b) for a, b in pairs), F.lit(0.0)) / (F.col("m") - 1)
    total = per_item.withColumn("seen", seen).groupBy("kind").agg(F.sum("seen").alias("seen"), F.sum("m").alias("m"), F.count("*").alias("n_items"), *(F.sum(f"v{v}").alias(f"v{v}") for v in values))
    expected = sum((2.0 * F.col(f"v{a}") * F.col(f"v{b}") * far(a, b) for a, b in pairs), F.lit(0.0)) / (F.col("m") - 1)
    return total.select("kind", (1.0 - F.try_divide(F.col("seen"), expected)).alias("alpha"), "n_items", F.col("m").alias("n_labels"))


def disputed(sheet: DataFrame) -> DataFrame:
    """(subject_kind, subject_key, verdict): items to be revised or rejected, and unreliable reviewers."""
    fit = consensus(review_labels(sheet))
    items = fit.items.filter(F.col("verdict") != DECISIONS[0]).select(F.lit("item").alias("subject_kind"), F.col("item").alias("subject_key"), "verdict")
    reviewers = reliability(fit).filter("unreliable").select(F.lit("reviewer").alias("subject_kind"), F.col("reviewer").alias("subject_key"), F.lit("unreliable").alias("verdict"))
    return items.unionByName(reviewers)
