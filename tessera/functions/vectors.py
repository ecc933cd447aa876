"""Vector arithmetic on array<double> columns, and text encoders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def valid(v: Column) -> Column:
    """Not null, not empty, and no null or NaN in it."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def hashed_ngrams(dim: int = DIM, n: int = 3) -> Callable[[pd.Series], pd.Series]:
    """The default encoder: signed hashed character n-grams, L2-normalised. Deterministic; stands in for a sentence model."""

    def encode(texts: pd.Series) -> pd.Series:
        import math
        import zlib

        def one(text: str | None) -> list[float]:
            out = [0.0] * dim
            padded = f"  {text or ''}  "
            for i in range(len(padded) - n + 1):
                h = zlib.crc32(padded[i : i + n].encode())
                out[h % dim] += 1.0 if h >> 31 else -1.0
            size = math.sqrt(sum(x * x for x in out))
            return [x / size for x in out] if size else out

        return texts.map(one)

    return encode


def encoder_udf(encode: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """encode as an Arrow-batched column function."""

    def batch(s: pd.Series) -> pd.Series:
        return encode(s)

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<double>")
