"""Colours of classified points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Red, green, blue of labels 0 to 9.
COLORS = (
    (255, 20, 147),
    (0, 191, 255),
    (0, 255, 127),
    (138, 43, 226),
    (255, 140, 0),
    (192, 0, 0),
    (34, 139, 34),
    (139, 69, 19),
    (0, 0, 128),
    (218, 165, 32),
)


def _channel(k: int) -> Column:
    return F.get(F.array(*(F.lit(float(c[k])) for c in COLORS)), F.col("label"))


def color_by_class(df: DataFrame) -> DataFrame:
    """df(label, ...) plus r, g, b; null for labels without a colour."""
    return df.withColumns({n: _channel(k) for k, n in enumerate("rgb")})


def color_by_probability(df: DataFrame) -> DataFrame:
    """df(label, prob, ...) plus r, g, b: from white to the label's colour with the probability of the own label."""
    return df.withColumns({n: 255.0 - (255.0 - _channel(k)) * F.col("prob") for k, n in enumerate("rgb")})
