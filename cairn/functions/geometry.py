"""Geometry as column expressions, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Upper triangle of a 3 x 3 matrix, in row order.
UPPER = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def squared_norm(dx: Column, dy: Column, dz: Column) -> Column:
    return dx * dx + dy * dy + dz * dz


def chebyshev(dx: Column, dy: Column, dz: Column) -> Column:
    return F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))


def ball_volume_cm3(radius: float) -> float:
    """Of a ball whose radius is in metres."""
    return 100.0**3 * 4.0 / 3.0 * math.pi * radius**3


def clean(column: Column) -> Column:
    """NaN and null to 0, infinities to the largest double of their sign."""
    top = 1.7976931348623157e308
    value = F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))
    return F.when(value == float("inf"), F.lit(top)).when(value == float("-inf"), F.lit(-top)).otherwise(value)


def with_eigenvalues(df: DataFrame, cov: dict[str, str], n: str, out: tuple[str, str, str]) -> DataFrame:
    """Adds the eigenvalues, largest first and scaled to sum 1, of the symmetric matrix in the columns cov["xx"] ...

    Trigonometric closed form. Fewer than two points or a zero trace: zeros. An isotropic matrix: a third each.
    """
    c = {k: F.col(v) for k, v in cov.items()}
    trace = c["xx"] + c["yy"] + c["zz"]
    df = df.withColumns({"_tr": trace, "_q": trace / F.lit(3.0)})
    q = F.col("_q")
    dev = {k: c[k] - q for k in ("xx", "yy", "zz")}
    p2 = dev["xx"] * dev["xx"] + dev["yy"] * dev["yy"] + dev["zz"] * dev["zz"] + 2.0 * (c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"])
    df = df.withColumn("_p", F.sqrt(p2 / 6.0))
    det = (
        dev["xx"] * (dev["yy"] * dev["zz"] - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * dev["zz"] - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - dev["yy"] * c["xz"])
    )
    p = F.col("_p")
    df = df.withColumn("_r", F.when(p > 0, F.least(F.greatest(det / (2.0 * p * p * p), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0))
    df = df.withColumn("_phi", F.acos("_r") / 3.0)
    top, low = q + 2.0 * p * F.cos("_phi"), q + 2.0 * p * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0)
    defined = (F.col(n) >= 2) & (F.col("_tr") > 0)
    share = lambda v: F.when(defined, F.when(p > 0, v / F.col("_tr")).otherwise(1.0 / 3.0)).otherwise(0.0) + 0.0
    df = df.withColumns({out[0]: share(top), out[1]: share(F.col("_tr") - top - low), out[2]: share(low)})
    return df.drop("_tr", "_q", "_p", "_r", "_phi")
