"""Voxel grids: addresses, unique voxels, first points, population curves."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.cloud import XYZ


def axis_index(column: Column, low: float, edge: float, ties: str = "up") -> Column:
    """Voxel index on one axis of a grid whose first voxel is centred on the smallest coordinate. ties: where a point just
    between two voxels goes, "up" or to the one of "even" index."""
    if ties == "even":
        return F.rint((column - F.lit(low)) / F.lit(edge)).cast("long")
    return F.floor((column - F.lit(low - edge / 2)) / F.lit(edge)).cast("long")


@dataclass(frozen=True)
class VoxelGrid:
    """A grid of cubes around a cloud; addresses pack the axis indices into one long, the first axis lowest."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    edge: float
    axes: tuple[str, ...] = XYZ

    @classmethod
    def fit(cls, df: DataFrame, edge: float, axes: tuple[str, ...] = XYZ) -> VoxelGrid:
        """The grid of a cloud of at least two points in two or three dimensions; one aggregate."""
        if len(axes) not in (2, 3):
            raise ValueError("two or three dimensions are needed")
        row = df.agg(F.count("*").alias("n"), *(f(c).cast("double").alias(f"{k}{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in axes)).first()
        if row["n"] < 2:
            raise ValueError("at least two points are needed")
        grid = cls(tuple(row[f"lo{c}"] for c in axes), tuple(row[f"hi{c}"] for c in axes), edge, tuple(axes))
        if sum(grid.widths) > 63:
            raise ValueError("the edge is too small: addresses would exceed 63 bits")
        return grid

    @property
    def min_corner(self) -> tuple[float, ...]:
        return tuple(v - self.edge / 2 for v in self.low)

    @property
    def max_corner(self) -> tuple[float, ...]:
        return tuple(v + self.edge / 2 for v in self.high)

    @property
    def widths(self) -> tuple[int, ...]:
        """Bits for each axis; a flat axis has one."""
        return tuple(max(1, math.ceil(math.log2((b - a) / self.edge))) for a, b in zip(self.min_corner, self.max_corner))

    @property
    def shifts(self) -> tuple[int, ...]:
        return tuple(itertools.accumulate((0, *self.widths[:-1])))

    @property
    def masks(self) -> tuple[int, ...]:
        return tuple(((1 << w) - 1) << s for w, s in zip(self.widths, self.shifts))

    def check_bounds(self, df: DataFrame) -> DataFrame:
        """df, or ValueError if a point lies outside the grid."""
        out = F.lit(False)
        for c, a, b in zip(self.axes, self.min_corner, self.max_corner):
            out = out | (F.col(c) < a) | (F.col(c) > b) | F.col(c).isNull()
        if df.where(out).limit(1).count():
            raise ValueError("points lie outside the grid")
        return df

    def index(self, axis: int) -> Column:
        return axis_index(F.col(self.axes[axis]), self.low[axis], self.edge)

    def address(self) -> Column:
        out = self.index(0)
        for d in range(1, len(self.axes)):
            out = out.bitwiseOR(F.shiftleft(self.index(d), self.shifts[d]))
        return out

    def centers(self, address: Column) -> list[Column]:
        """Voxel centres of an address."""
        indices = [F.shiftright(address.bitwiseAND(F.lit(m)), s) for m, s in zip(self.masks, self.shifts)]
        return [(i * F.lit(self.edge) + F.lit(c + self.edge / 2)).alias(a) for i, c, a in zip(indices, self.min_corner, self.axes)]


def with_cells(df: DataFrame, edge: float, low: tuple[float, float, float], ties: str = "up") -> DataFrame:
    return df.withColumns({f"i{c}": axis_index(F.col(c), v, edge, ties) for c, v in zip(XYZ, low)})


def corner_of(df: DataFrame) -> tuple[float, float, float] | None:
    row = df.agg(*(F.min(c).cast("double").alias(c) for c in XYZ)).first()
    return None if row["x"] is None else tuple(row)


def unique_voxels(df: DataFrame, edge: float, low: tuple[float, float, float] | None = None, ties: str = "up") -> DataFrame:
    """Centres (x, y, z) of the voxels that hold a point; partial distinct before the only shuffle. low: the cloud's
    smallest coordinates, where they are known already."""
    low = low or corner_of(df)
    if low is None:
        return df.select(*XYZ)
    cells = with_cells(df.select(*XYZ), edge, low, ties).select("ix", "iy", "iz").distinct()
    return cells.select(*((F.lit(v) + F.col(f"i{c}") * F.lit(edge)).alias(c) for c, v in zip(XYZ, low)))


def first_points(df: DataFrame, edge: float) -> DataFrame:
    """The point of the smallest id in each voxel: id, x, y, z."""
    low = corner_of(df)
    if low is None:
        return df.select("id", *XYZ)
    cells = with_cells(df.select("id", *XYZ), edge, low)
    return cells.groupBy("ix", "iy", "iz").agg(F.min("id").alias("id"), *(F.min_by(c, "id").alias(c) for c in XYZ)).select("id", *XYZ)


def population_curve(df: DataFrame, edges: list[float]) -> DataFrame:
    """(edge, voxels, points, percent) for each edge; every point is exploded once an edge and pre-aggregated."""
    low = corner_of(df)
    if low is None:
        return df.sparkSession.createDataFrame([], "edge double, voxels long, points long, percent double")
    each = df.select(*XYZ).withColumn("edge", F.explode(F.array(*(F.lit(float(e)) for e in edges))))
    cell = {f"i{c}": F.floor((F.col(c) - (F.lit(v) - F.col("edge") / 2)) / F.col("edge")).cast("long") for c, v in zip(XYZ, low)}
    cells = each.withColumns(cell).groupBy("edge", "ix", "iy", "iz").agg(F.count("*").alias("n"))
    out = cells.groupBy("edge").agg(F.count("*").alias("voxels"), F.sum("n").cast("long").alias("points"))
    return out.withColumn("percent", F.col("voxels") / F.col("points") * 100.0)


def neighbor_offsets(dims: int = 3, facing: bool = False) -> list[tuple[int, ...]]:
    """Offsets of the 8 or 26 voxels around one, or of the 4 or 6 that share a face."""
    around = [o for o in itertools.product((-1, 0, 1), repeat=dims) if any(o)]
    return [o for o in around if sum(map(abs, o)) == 1] if facing else around


def voxel_neighbors(cells: DataFrame, facing: bool = False) -> DataFrame:
    """cells(ix, iy, iz) -> each with the occupied cells next to it: (ix, iy, iz, jx, jy, jz)."""
    steps = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(o, XYZ))) for o in neighbor_offsets(3, facing)))
    cells = cells.select("ix", "iy", "iz").distinct()
    near = cells.withColumn("o", F.explode(steps)).select("ix", "iy", "iz", *((F.col(f"i{c}") + F.col(f"o.{c}")).alias(f"j{c}") for c in XYZ))
    return near.join(cells.select(*(F.col(f"i{c}").alias(f"j{c}") for c in XYZ)), ["jx", "jy", "jz"], "left_semi").select("ix", "iy", "iz", "jx", "jy", "jz")
