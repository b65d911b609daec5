"""Vector functions and the offline embedding."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    """Unit vector as doubles; a zero vector stays zero."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-10)))


@lru_cache(maxsize=1 << 17)
def _grams(word: str) -> np.ndarray:
    """Hashes of a word and its character trigrams."""
    framed = f"<{word}>"
    return np.array([crc32(g.encode()) for g in (framed, *(framed[i : i + 3] for i in range(len(framed) - 2)))], dtype=np.int64)


def hashed_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Unit vectors of hashed words and character trigrams, one a row; '' gives zeros.  A word is hashed once, not once a text."""
    words = [[_grams(w) for w in t.lower().split()] for t in texts]
    sizes = [sum(map(len, some)) for some in words]
    hashes = np.concatenate([g for some in words for g in some]) if sum(sizes) else np.empty(0, np.int64)
    cells = np.repeat(np.arange(len(texts)), sizes) * dim + hashes % dim
    out = np.bincount(cells, np.where(hashes & 0x80000000, 1.0, -1.0), minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


#: A provider of embeddings: texts and dimension to one unit vector a row.
Encode = Callable[[list[str], int], np.ndarray]


def text_prefix(model: str, of_query: bool) -> str:
    """What a model of the e5 family wants before a text; '' for others."""
    return ("query: " if of_query else "passage: ") if "e5" in model.lower() else ""


def embedder(dim: int, prefix: str = "", encode: Encode = hashed_vectors) -> Callable[[Column], Column]:
    """An Arrow function from text to unit vectors; ``encode`` is the provider, ``prefix`` what a model wants before the text."""

    @F.pandas_udf(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode([prefix + (t or "") for t in texts], dim)), index=texts.index)

    return embed
