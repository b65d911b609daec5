"""Exact top-k by inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.tables import cut, spread

#: Queries held by a task at once; more are scored block by block, each against every row.
BLOCK = 20_000


#: Queries and rows of a matrix product: bound the memory of a task whatever the block, and stay within the processor's cache.
SLICE, ROWS = 512, 1024
#: Rows whose greatest score is asked first: where it is below a query's floor, none of them is looked at.
GROUP = 32


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors as doubles) for each length; vectors that are not finite in single precision are left out."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        some = flat[offsets[places][:, None] + np.arange(n)].reshape(len(places), n)
        fine = (np.abs(some) < 3e38).all(axis=1)
        yield int(n), places[fine], some[fine]


class _Best:
    """The k greatest scores of each query so far, ties by key."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.places = k, np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        self._pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> int:
        self._pending.append((rows, scores, places))
        return sum(len(p[0]) for p in self._pending)

    def merge(self, names: list[pa.Array]) -> None:
        """Takes in what was added; ``names``: the keys of the places."""
        if not self._pending:
            return
        rows, scores, places = (np.concatenate(x) for x in zip(*self._pending, strict=True))
        self._pending = []
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.k), rows])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        places = np.concatenate([self.places[touched].ravel(), places])
        rows, scores, places = (x[places >= 0] for x in (rows, scores, places))
        order = np.lexsort((-scores, rows))
        rows, scores, places = rows[order], scores[order], places[order]
        same = (rows[1:] == rows[:-1]) & (scores[1:] == scores[:-1])
        if same.any():  # keys are asked of ties only
            tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
            by_key = np.zeros(len(rows), dtype=np.int64)
            which, back = np.unique(places[tied], return_inverse=True)
            keys = pa.chunked_array(names).take(pa.array(which)).to_pylist()
            rank = {key: i for i, key in enumerate(sorted(set(keys)))}
            by_key[tied] = np.array([rank[key] for key in keys])[back]
            order = np.lexsort((by_key, -scores, rows))
            rows, scores, places = rows[order], scores[order], places[order]
        at = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = at < self.k
        self.scores[rows[keep], at[keep]], self.places[rows[keep], at[keep]] = scores[keep], places[keep]


def _near(s: np.ndarray, floor: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, query) of a block's scores that may be among the k best; ``floor``: the k-th best score so far of each query."""
    if np.isneginf(floor).any():
        if len(s) > k:
            floor = np.maximum(floor, np.partition(s, -k, axis=0)[-k])
        return np.nonzero((s >= floor - slack) & np.isfinite(s))  # the k-th's ties and all that may be as good
    whole, low = len(s) // GROUP * GROUP, floor - slack
    peaks = s[:whole].reshape(-1, GROUP, s.shape[1]).max(axis=1)
    group, query = np.nonzero(~(peaks < low))
    rows = group[:, None] * GROUP + np.arange(GROUP)
    some = s[rows, query[:, None]]
    at, within = np.nonzero((some >= low[query][:, None]) & np.isfinite(some))
    row, column = np.nonzero((s[whole:] >= low) & np.isfinite(s[whole:]))
    return np.concatenate([rows[at, within], row + whole]), np.concatenate([query[at], column])


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "id", vector: str = "embedding", block: int = BLOCK, without_self: bool = False) -> DataFrame:
    """query_key, key, score, rank: the k rows of the corpus with the greatest inner product, ties by key.

    Queries are the small side: their number is checked and they are broadcast in blocks of at most ``block``; each block
    meets every row of the corpus in matrix products, and a task keeps k rows a query, so what is
    shuffled grows with queries x tasks, not with pairs.  Products are taken in single precision; whatever may be among
    the best so far within its error is scored again in double precision.  Several blocks run one after the other, each written before
    the next is broadcast.  Null vectors match nothing, others only vectors of their own length; fewer than k rows give
    fewer hits; ``without_self`` says that queries are rows of the corpus and leaves out each one's own row, by key.
    """
    spark = corpus.sparkSession
    q_kind, c_kind = queries.schema[query_key].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    asked = queries.filter(F.col(vector).isNotNull() & F.col(query_key).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v"))
    n = asked.count()
    blocks = max(1, math.ceil(n / block))
    if blocks > 1:
        asked = cut(asked.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks))))
    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).alias("c"), F.col(vector).alias("v"))
    out = None
    for b in range(blocks):
        some = (asked.filter(F.col("b") == b) if blocks > 1 else asked).select("q", "v").toArrow().combine_chunks()
        ids, column = (some[c].combine_chunks() for c in ("q", "v"))
        of_length = {n: (ids.take(pa.array(at)), q) for n, at, q in _matrices(column)}
        shared = spark.sparkContext.broadcast(of_length)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, _Best] = {}
            places = {n: {key: i for i, key in enumerate(ids.to_pylist())} for n, (ids, _) in shared.value.items()} if without_self else {}
            names: list[pa.Array] = []
            seen = 0
            for batch in batches:
                names.append(batch.column("c"))
                for n, here, vectors in _matrices(batch.column("v")):
                    if n not in shared.value or not len(here):
                        continue
                    q = shared.value[n][1]
                    mine = best.setdefault(n, _Best(len(q), k))
                    singles = vectors.astype(np.float32)
                    # twice the error bound of an inner product in single precision
                    slack = np.linalg.norm(q, axis=1) * np.linalg.norm(vectors, axis=1).max() * (n + 4) * 2.4e-7
                    own = np.array([places[n].get(c, -1) for c in names[-1].take(pa.array(here)).to_pylist()]) if without_self else np.empty(0)
                    for lo in range(0, len(q), SLICE):
                        asked_here = q[lo : lo + SLICE].astype(np.float32).T
                        for first in range(0, len(here), ROWS):
                            s = singles[first : first + ROWS] @ asked_here
                            if without_self:
                                of = own[first : first + ROWS]
                                itself = np.flatnonzero((of >= lo) & (of < lo + s.shape[1]))
                                s[itself, of[itself] - lo] = -np.inf
                            floor = mine.scores[lo : lo + SLICE, -1]
                            cold = np.isneginf(floor).any()
                            row, at = _near(s, floor, slack[lo : lo + SLICE], k)
                            for i in range(0, len(row), 1 << 14):
                                r, a = row[i : i + (1 << 14)] + first, at[i : i + (1 << 14)] + lo
                                if mine.add(a, np.einsum("ij,ij->i", q[a], vectors[r]), here[r] + seen) >= 1 << 14:
                                    mine.merge(names)
                            if cold:
                                mine.merge(names)
                        mine.merge(names)
                seen += len(batch)
            for n, mine in best.items():
                row, at = np.nonzero(mine.places >= 0)
                yield pa.RecordBatch.from_arrays([shared.value[n][0].take(pa.array(row)), pa.chunked_array(names).take(pa.array(mine.places[row, at])).combine_chunks(), pa.array(mine.scores[row, at])], ["q", "c", "score"])

        part = spread(rows).mapInArrow(score, f"q {q_kind}, c {c_kind}, score double")
        if blocks > 1:
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("c").alias(key), "score", "rank")
