"""Embedders by name: columns where SQL can say it, Arrow-batched functions otherwise."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_vector


def keyword_embedder(vocabulary: list[str]):
    return lambda text: count_vector(text, vocabulary)


def hash_embedder(dimensions: int = 256):
    """A unit vector drawn from a generator that the text's hash seeds: equal texts, equal vectors."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")).standard_normal(dimensions)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return pd.Series(out)

    return lambda text: F.pandas_udf(embed, "array<float>")(text)


EMBEDDERS = {"keyword": keyword_embedder, "hash": hash_embedder}


def build_embedder(name: str, *args):
    if name not in EMBEDDERS:
        raise ValueError(f"no such embedder: {name}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name](*args)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def blend(a: Column, b: Column, weight: float) -> Column:
    return unit(F.zip_with(a, b, lambda x, y: x.cast("double") * weight + y.cast("double") * (1 - weight)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
