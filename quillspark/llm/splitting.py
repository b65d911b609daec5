"""Problem 4: splitting texts over a size limit at natural boundaries, with a given overlap.

Every place of a text has a boundary strength: paragraph break, line break, end of sentence, of clause, of word, none.
A sparse table answers "strongest boundary in this range, the last of equals" in constant time, so each cut takes one
query over the permissible lengths, whatever they are; the next piece starts ``overlap`` before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 500, 100
# Boundary strengths after a character.
NONE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
# Characters that close a clause or a sentence, in the scripts met here.
CLAUSE_MARKS, SENTENCE_MARKS, CLOSERS = ",;:–—،、", ".!?।॥。？！…", "\"'”’)]}»"
#: Characters indexed at once, and how far back the mark before a boundary may stand.
BLOCK, LOOK_BACK = 1 << 16, 8
#: Pieces handed on at once.
ROWS = 2000
#: Chunks of a document, by their index, that are ordered together; characters of a text that are stored together, and parts up to which the JVM cuts a text.
BUCKET, PART, JVM_PARTS = 512, 8192, 16

_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


def _codes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut after each character; only a blank or line break can end a piece well."""
    codes = _codes(text)
    n = len(codes)
    blank, line = np.isin(codes, _BLANKS), codes == 10
    out = np.where(blank, WORD, NONE).astype(np.int8)
    if not n:
        return out
    # the mark before a run of blanks decides, closing quotes and brackets skipped
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(blank | np.isin(codes, _codes(CLOSERS)), -1, at))
    mark = codes[np.maximum(last, 0)]
    near = at - last <= 4
    out[blank & near & np.isin(mark, _codes(CLAUSE_MARKS)) & (last >= 0)] = CLAUSE
    out[blank & near & np.isin(mark, _codes(SENTENCE_MARKS)) & (last >= 0)] = SENTENCE
    out[line] = LINE
    out[line & np.concatenate(([False], line[:-1]))] = PARAGRAPH
    return out


class RangeMax:
    """Sparse table over strengths: position of the greatest value in a range, the last of equals."""

    def __init__(self, strengths: np.ndarray, longest: int) -> None:
        n = len(strengths)
        kind = np.int32 if (PARAGRAPH + 1) * (n + 1) < 1 << 31 else np.int64
        keys = strengths.astype(kind) * kind(n + 1) + np.arange(n, dtype=kind)
        self._n, self._rows = n + 1, [keys]
        width = 1
        while 2 * width <= min(longest, n):
            row = self._rows[-1]
            self._rows.append(np.maximum(row[: len(row) - width], row[width:]))
            width *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest place in lo..hi-1, which must not be empty."""
        k = min((hi - lo).bit_length() - 1, len(self._rows) - 1)
        row = self._rows[k]
        strength, at = divmod(int(max(row[lo], row[hi - (1 << k)])), self._n)
        return strength, at


class Splitter:
    """The index over a text's boundaries, of one block of the text at a time: its memory doesn't grow with the text."""

    def __init__(self, text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> None:
        self.text, self.limit, self.overlap = text, limit, overlap
        self._block = max(block, 2 * limit)
        self._from = self._until = 0

    def strongest(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest boundary in lo..hi-1, at most ``limit`` places; the last of equals."""
        if not self._from <= lo < hi <= self._until:
            self._from, self._until = lo, min(len(self.text), lo + self._block)
            before = max(0, lo - LOOK_BACK)
            self._table = RangeMax(boundary_strengths(self.text[before : self._until])[lo - before :], self.limit)
        strength, at = self._table.query(lo - self._from, hi - self._from)
        return strength, at + self._from

    def cut(self, start: int) -> int:
        """End of the piece that begins at ``start``."""
        if len(self.text) - start <= self.limit:
            return len(self.text)
        strength, at = self.strongest(start + self.overlap, start + self.limit)
        return at + 1 if strength > NONE else start + self.limit

    def permits(self, start: int, end: int, until: int | None = None) -> bool:
        """May a piece that begins at ``start`` end at ``end``, short of the text's end: at a boundary, or anywhere if its window has none?

        ``until``: where the text that ``start`` belongs to ends, if that is before the end of all text.
        """
        lo, hi = start + self.overlap, min(start + self.limit, len(self.text) if until is None else until)
        return lo >= hi or self.strongest(lo, hi)[0] == NONE or self.strongest(end - 1, end)[0] > NONE

    def __iter__(self) -> Iterator[tuple[int, int, str]]:
        """(start, end, stripped text) of the pieces, one after the other; '' has none."""
        start, n = 0, len(self.text)
        while n:
            end = self.cut(start)
            yield start, end, self.text[start:end].strip()
            if end == n:
                return
            start = end - self.overlap


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of the pieces of ``text``; '' has none."""
    return list(Splitter(text, limit, overlap))


def _check(limit: int, overlap: int) -> None:
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError(f"limit must be positive and overlap in [0, limit): {limit}, {overlap}")


def _latest(docs: DataFrame, key: str, text: str, stamp: str | None) -> DataFrame:
    """One row a document: the text ingested last, of several the greatest."""
    newest = F.max(F.struct(F.col(stamp) if stamp else F.lit(0), F.coalesce(text, F.lit("")).alias("text")))
    return docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("document")).agg(newest.alias("x")).select("document", "x.text")


def split_documents(docs: DataFrame, key: str = "document_id", text: str = "text", stamp: str | None = "ingestion_timestamp", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, chunk_text, char_start, char_end: the pieces of every document's whole text.

    A document ingested several times is cut once, in its latest text; rows without a key are dropped; null and empty
    texts have no pieces; of a text of any length, one block is indexed and ``ROWS`` pieces are held at a time; an empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    _check(limit, overlap)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = ((d, i, piece, a, b) for d, t in zip(batch["document"], batch["text"], strict=True) for i, (a, b, piece) in enumerate(Splitter(t, limit, overlap)))
            while some := list(islice(made, ROWS)):
                yield pd.DataFrame(some, columns=["document", "chunk_index", "chunk_text", "char_start", "char_end"])

    return _latest(docs, key, text, stamp).mapInPandas(run, f"document {kind}, chunk_index int, chunk_text string, char_start int, char_end int").withColumnRenamed("document", key)


def _parts(texts: DataFrame, limit: int) -> DataFrame:
    """document, part, n, piece: every text in parts of ``PART`` characters, each with ``limit`` more; n is the text's length.

    Texts of few parts are cut in the JVM, whose ``substring`` counts from the text's beginning; longer ones in Python.
    """
    kind = texts.schema["document"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = ((d, k, len(t), t[k * PART : (k + 1) * PART + limit]) for d, t in zip(batch["document"], batch["text"], strict=True) for k in range(-(-len(t) // PART)))
            while some := list(islice(cut, ROWS // 8)):
                yield pd.DataFrame(some, columns=["document", "part", "n", "piece"])

    size = F.length("text")
    one = texts.filter(size <= PART).select("document", F.lit(0).alias("part"), size.alias("n"), F.col("text").alias("piece"))
    few = texts.filter((size > PART) & (size <= JVM_PARTS * PART)).select("document", "text", size.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / PART).cast("int"))).alias("part"))
    few = few.select("document", "part", "n", F.substring("text", F.col("part") * PART + 1, F.lit(PART + limit)).alias("piece"))
    return one.unionByName(few).unionByName(texts.filter(size > JVM_PARTS * PART).mapInPandas(run, f"document {kind}, part int, n int, piece string"))


def audit_chunks(chunks: DataFrame, docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """document_id, chunk_index of each stored chunk that isn't a valid piece; index -1 for a document without chunks.

    The end of a chunk is held against the splitter's index over the boundaries of its permissible range.  Texts are
    shuffled once, in parts; a chunk meets the part in which it begins and takes its own 500 characters from it.
    Exact repeats of a chunk count once; a chunk with a null, or of an unknown document, is not valid; several chunks
    of one index follow each other by their start; rows without a document id are dropped; empty tables give no
    rows, or -1 for every document; other columns are not read.
    """
    _check(limit, overlap)
    stored = chunks.filter("document_id is not null").select("document_id", "chunk_index", "chunk_text", "char_start", "char_end").distinct()
    stored = stored.withColumn("bucket", F.floor(F.coalesce("chunk_index", F.lit(0)) / BUCKET))
    # Long documents are spread over buckets; a bucket needs no more of the others than the end before it.
    inside = Window.partitionBy("document_id", "bucket").orderBy(F.col("chunk_index").asc_nulls_first(), F.col("char_start").asc_nulls_first(), F.col("char_end").asc_nulls_first(), F.col("chunk_text").asc_nulls_first())
    ordered = stored.withColumn("rank", F.row_number().over(inside)).withColumn("previous", F.lag("char_end").over(inside)).withColumn("following", F.lead("bucket").over(inside))
    at = Window.partitionBy("document_id").orderBy("bucket")
    ends = ordered.filter("following is null").select("document_id", "bucket", "char_end")
    edges = ends.select("document_id", "bucket", F.lag("char_end").over(at).alias("before"), F.lag("bucket").over(at).isNull().alias("first"), F.lead("bucket").over(at).isNull().alias("last"))
    opens, closes = (F.col("rank") == 1) & F.col("first"), F.col("following").isNull() & F.col("last")
    rows = ordered.join(edges, ["document_id", "bucket"]).withColumn("previous", F.when(F.col("rank") == 1, F.col("before")).otherwise(F.col("previous")))
    rows = rows.select("document_id", "chunk_index", "chunk_text", "char_start", "char_end", "previous", opens.alias("opens"), closes.alias("closes"), F.floor(F.coalesce("char_start", F.lit(-1)) / PART).cast("int").alias("part"))

    texts = _latest(docs, "document_id", "text", "ingestion_timestamp")
    parts = _parts(texts, limit).withColumnRenamed("document", "document_id")
    own = F.substring("piece", F.col("char_start") - F.col("part") * PART + 1, F.lit(limit))
    met = rows.join(parts, ["document_id", "part"], "left").select("document_id", "chunk_index", "chunk_text", "char_start", "char_end", "previous", "opens", "closes", "n", own.alias("own"))

    def in_place(text: str | None, a: float, b: float, own_text: str | None, n: float, previous: float, opens: bool, closes: bool) -> bool:
        if text is None or own_text is None or a != a or b != b:
            return False
        a, b = int(a), int(b)
        if not (0 <= a < b <= n and b - a <= limit and len(text) <= limit and text == own_text[: b - a].strip()):
            return False
        return a == (0 if opens else previous - overlap) and (not closes or b == n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart = "x" * LOOK_BACK
        for batch in batches:
            columns = (batch[c] for c in ("chunk_text", "char_start", "char_end", "own", "n", "previous", "opens", "closes"))
            good = [known and in_place(*row) for known, row in zip(batch["chunk_index"].notna(), zip(*columns, strict=True), strict=True)]
            # one index over the own texts of all chunks of the batch
            asked = [k for k, (fine, b, n) in enumerate(zip(good, batch["char_end"], batch["n"], strict=True)) if fine and b != n]
            texts = batch["own"].to_numpy()[asked]
            splitter, at = Splitter(apart.join(texts), limit, overlap), 0
            for k, text, size in zip(asked, texts, (batch["char_end"] - batch["char_start"]).to_numpy()[asked], strict=True):
                good[k] = splitter.permits(at, at + int(size), at + len(text))
                at += len(text) + LOOK_BACK
            out = batch.loc[[not fine for fine in good], ["document_id", "chunk_index"]]
            yield out.assign(chunk_index=out["chunk_index"].astype("Int32"))

    kind = docs.schema["document_id"].dataType.simpleString()
    bare = texts.select(F.col("document").alias("document_id")).join(stored.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(-1).alias("chunk_index"))
    return met.mapInPandas(run, f"document_id {kind}, chunk_index int").unionByName(bare)
