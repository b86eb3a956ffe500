"""Point clouds: a DataFrame of id, x, y, z (doubles) and whatever else its rows carry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class PointCloud:
    """A cloud and the corner that was taken off its coordinates (zero if none was)."""

    df: DataFrame
    corner: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @classmethod
    def of(cls, df: DataFrame, id: str, x: Column, y: Column, z: Column, *extra: Column) -> PointCloud:
        """A cloud from any table with a unique id column and three coordinate expressions."""
        named = [c.cast("double").alias(n) for c, n in zip((x, y, z), XYZ)]
        return cls(df.select(F.col(id).cast("long").alias("id"), *named, *extra))

    def validate(self) -> PointCloud:
        """Raises ValueError if a coordinate is null or not finite, or an id null or repeated."""
        bad = F.lit(False)
        for c in XYZ:
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        row = self.df.agg(F.count_if(bad | F.col("id").isNull()).alias("bad"), F.count("id").alias("n")).first()
        if row["bad"]:
            raise ValueError(f"{row['bad']} points without an id or finite coordinates")
        if self.df.select("id").distinct().count() != row["n"]:
            raise ValueError("ids repeat")
        return self

    def recenter(self, how: str = "first", threshold: float | None = None) -> PointCloud:
        """Subtracts the point of the smallest id ("first") or the centroid; only if its norm is above the threshold."""
        if how == "first":
            row = self.df.agg(*(F.min_by(c, "id").alias(c) for c in XYZ)).first()
        elif how == "centroid":
            row = self.df.agg(*(F.avg(c).alias(c) for c in XYZ)).first()
        else:
            raise ValueError(f"unknown way to recenter: {how}")
        if row["x"] is None or threshold is not None and sum(v * v for v in row) ** 0.5 <= threshold:
            return self
        moved = self.df.withColumns({c: F.col(c) - F.lit(row[c]) for c in XYZ})
        return PointCloud(moved, tuple(a + b for a, b in zip(self.corner, row)))

    def restore(self) -> DataFrame:
        """The rows at their original coordinates."""
        return self.df.withColumns({c: F.col(c) + F.lit(v) for c, v in zip(XYZ, self.corner)})

    def bounding_box(self, by: list[str] | None = None) -> DataFrame:
        """One row of min_x .. max_z (for each value of `by`, if given)."""
        return (self.df.groupBy(*by) if by else self.df).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ))

    def take(self, positions: DataFrame, original_coordinates: bool = True) -> DataFrame:
        """Rows in the order of positions(pos, id); an id asked for twice comes twice."""
        rows = self.restore() if original_coordinates else self.df
        return positions.select("pos", "id").join(rows, "id")
