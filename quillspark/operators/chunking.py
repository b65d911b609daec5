"""Overlapping chunks cut at the first kind of boundary that a window has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import spread

# Boundaries in order of preference; of each kind the last in the window counts.
BOUNDARIES = ("\n\n", "\n", ". ", "? ", "! ", "। ", " ")


def check_sizes(size: int, overlap: int) -> None:
    """Sizes that can't make progress raise."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"size must be positive and overlap in [0, size): {size}, {overlap}")


def cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive chunks of a stripped text."""
    start = 0
    while text:
        end = start + size
        if end >= len(text):
            yield start, len(text)
            return
        found = ((at + len(b)) for b in BOUNDARIES if (at := text.rfind(b, start + overlap, end)) >= 0)
        end = next(found, end)
        yield start, end
        start = end - overlap


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Chunks of every document, with the document's metadata overlaid by what tells the source.

    Null and blank texts have none; offsets are of the unstripped piece in the stripped text; a document stored several
    times is chunked once a row.
    """
    check_sizes(size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["document_id"], batch["text"], strict=True):
                whole = (text or "").strip()
                pieces = [(a, b, p) for a, b in cuts(whole, size, overlap) if (p := whole[a:b].strip())]
                rows.append([dict(chunk_id=f"{doc}_c{i}", chunk_index=i, chunk_text=p, char_start=a, char_end=b) for i, (a, b, p) in enumerate(pieces)])
            yield batch.drop(columns="text").assign(chunks=rows)

    carried = F.map_filter(F.create_map(*(x for c in ("title", "filename", "source", "document_type") for x in (F.lit(c), F.col(c)))), lambda _, v: v.isNotNull())
    rows = docs.select("document_id", "text", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), carried.alias("carried"))
    made = spread(rows).mapInPandas(run, "document_id string, metadata map<string,string>, carried map<string,string>, chunks array<struct<chunk_id string, chunk_index int, chunk_text string, char_start int, char_end int>>")
    one = made.select("document_id", "metadata", "carried", F.explode("chunks").alias("c")).select("document_id", "metadata", "carried", "c.*")
    over = F.map_concat("carried", F.create_map(F.lit("chunk_size_chars"), F.length("chunk_text").cast("string")))
    kept = F.map_filter("metadata", lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return one.select("chunk_id", "document_id", "chunk_index", "chunk_text", "char_start", "char_end", F.map_concat(kept, over).alias("metadata"))
