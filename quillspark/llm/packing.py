"""Problem 6: filling containers of fixed capacity with texts measured in tokens.

Best-fit decreasing: texts from long to short, each into the open container with the least room that still holds it.
A segment tree over remaining capacities finds that container in logarithmic time.  Texts are packed in groups of a
bounded number of items, by a hash, so any number of groups runs side by side; the items of the containers that each
group leaves badly filled are taken out and packed once more across groups.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import cut, spread

CAPACITY = 2048
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer takes text apart before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed by one task, and the most bytes of a vocabulary that are broadcast.
GROUP, VOCABULARY_BYTES = 20_000, 64 << 20
#: A container under this share is packed again with those of other groups.
WELL_FILLED = 0.98


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):  # noqa: ANN202
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class RoomIndex:
    """Segment tree over remaining capacities 0..capacity; each leaf holds the open containers with that room."""

    def __init__(self, capacity: int) -> None:
        self._base = 1 << capacity.bit_length()
        self._any = bytearray(2 * self._base)
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, container: int) -> None:
        self._open[room].append(container)
        i = self._base + room
        while i and not self._any[i]:
            self._any[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, container) of the tightest container that holds ``size``, removed; None if none does."""
        if size >= len(self._open):
            return None
        i = self._base + size
        if not self._any[i]:
            while i & 1 or not self._any[i + 1]:  # up to the next subtree on the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self._base:
                i = 2 * i if self._any[2 * i] else 2 * i + 1
        room = i - self._base
        container = self._open[room].pop()
        if not self._open[room]:
            self._any[i] = 0
            while i > 1 and not self._any[i ^ 1]:
                i >>= 1
                self._any[i] = 0
        return room, container


def best_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Container of each item; items must be at most ``capacity``."""
    rooms, out, n = RoomIndex(capacity), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        if (found := rooms.take(size)) is None:
            found = capacity, n
            n += 1
        out[k] = found[1]
        rooms.add(found[0] - size, found[1])
    return out


def token_items(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """key, part, token_start, token_end: one item a text, several for a text of more than ``capacity`` tokens."""
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        ranks = f.read(VOCABULARY_BYTES + 1)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {VOCABULARY_BYTES} bytes: {vocabulary}")
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                n = len(encode(t)) if t else 0
                rows += [(k, p, a, min(n, a + capacity)) for p, a in enumerate(range(0, max(n, 1), capacity))]
            yield pd.DataFrame(rows, columns=["key", "part", "token_start", "token_end"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(run, f"key {kind}, part int, token_start bigint, token_end bigint")


def _packed(items: DataFrame, count: int, capacity: int) -> DataFrame:
    """``items`` (row, size) packed in groups by the hash of their row number: row, size, grp, bin."""
    groups = max(1, math.ceil(count / GROUP))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        rows["bin"] = best_fit_decreasing(rows["size"].tolist(), capacity)
        return rows[["row", "size", "grp", "bin"]]

    return items.select("row", "size", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp")).groupBy("grp").applyInPandas(pack, "row bigint, size bigint, grp bigint, bin bigint")


def containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """key, part, token_start, token_end, container: the place of every text, or of each part of an oversized one.

    A text is split only if it alone exceeds ``capacity``, into full parts and a rest.  Null and empty texts are items
    of no tokens; equal and null keys are items of their own; ties in size go by the order of the rows; an empty table
    gives no rows; other columns are not read.
    """
    if capacity <= 0:
        raise ValueError(f"capacity must be positive: {capacity}")
    made = token_items(df, key, text, capacity, tokenizers, vocabulary, pattern).withColumn("size", F.col("token_end") - F.col("token_start"))
    items = cut(made.withColumn("row", F.monotonically_increasing_id()))  # written: numbers stay as they are
    placed = lambda rows, mark: rows.select("row", F.concat(F.lit(mark), F.col("grp"), F.lit("-"), F.col("bin")).alias("container"))
    n = items.count()
    first = _packed(items, n, capacity)
    if n <= GROUP:  # one group: nothing to mend across groups
        places = placed(first, "g")
    else:
        first = cut(first)
        loose = first.groupBy("grp", "bin").agg(F.sum("size").alias("held")).filter(F.col("held") < WELL_FILLED * capacity).select("grp", "bin")
        again = cut(first.join(loose, ["grp", "bin"], "left_semi").select("row", "size"))
        places = placed(first.join(loose, ["grp", "bin"], "left_anti"), "g").unionByName(placed(_packed(again, again.count(), capacity), "r"))
    return items.join(places, "row").select(F.col("key").alias(key), "part", "token_start", "token_end", "container")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible for so many tokens, the unused share."""
    used = packed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return used.agg(F.count("*").alias("containers"), total.alias("tokens"), F.ceil(total / capacity).alias("fewest"), F.round(1 - F.try_divide(total, F.count("*") * F.lit(capacity)), 6).alias("unused_share"))
