"""Rates as fractions and times as ticks."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fraction_udf(limit: int = 100_000):
    """double -> struct<num, den>: the closest fraction with a denominator up to ``limit``. For dimension tables."""

    @F.pandas_udf(T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]))
    def nearest(values: pd.Series) -> pd.DataFrame:
        found = [None if v is None or v != v else Fraction(float(v)).limit_denominator(limit) for v in values]
        return pd.DataFrame({"num": pd.array([None if f is None else f.numerator for f in found], "Int64"), "den": pd.array([None if f is None else f.denominator for f in found], "Int64")})

    return nearest


def rescale(ticks: str, from_num: str, from_den: str, to_num: str, to_den: str) -> Column:
    """Ticks of one time base in another, truncated. SQL expressions in; exact in decimals."""
    wide = lambda c: f"cast({c} as decimal(12,0))"
    return F.expr(f"cast({ticks} as decimal(19,0)) * {wide(from_num)} * {wide(to_den)} div ({wide(from_den)} * {wide(to_num)})")
