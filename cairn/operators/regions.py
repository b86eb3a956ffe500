"""Boxes, balls, octants, octree leaves and batches."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.cloud import XYZ
from cairn.functions.geometry import chebyshev, squared_norm
from cairn.plans.materialize import materialize, ranked


def in_box(low: tuple, high: tuple, buffer: float = 0.0, bounds: str = "closed") -> Column:
    """Whether a point lies in a box grown by buffer; bounds: closed, open or half (upper faces left out, for tilings).

    Plain comparisons on columns, which reach the Parquet reader."""
    out = F.lit(True)
    for c, a, b in zip(XYZ, low, high):
        a, b = a - buffer, b + buffer
        if bounds == "closed":
            out = out & (F.col(c) >= a) & (F.col(c) <= b)
        elif bounds == "open":
            out = out & (F.col(c) > a) & (F.col(c) < b)
        elif bounds == "half":
            out = out & (F.col(c) >= a) & (F.col(c) < b)
        else:
            raise ValueError(f"unknown bounds: {bounds}")
    return out


def nested_regions(query: DataFrame, search: DataFrame, buffer: float, low: tuple, high: tuple) -> tuple[DataFrame, DataFrame]:
    """The query points in a box and the search points in the box grown by buffer, both closed; either may be empty."""
    if buffer < 0:
        raise ValueError("the buffer must not be negative")
    return query.where(in_box(low, high)), search.where(in_box(low, high, buffer))


def ball_query(points: DataFrame, center: tuple, radius: float, metric: str = "euclid") -> DataFrame:
    """Points at a distance strictly below radius."""
    d = [F.col(c) - F.lit(float(v)) for c, v in zip(XYZ, center)]
    if metric == "euclid":
        near = squared_norm(*d) < radius * radius
    elif metric == "cheby":
        near = chebyshev(*d) < radius
    else:
        raise ValueError(f"unknown metric: {metric}")
    return points.where(in_box(tuple(v - radius for v in center), tuple(v + radius for v in center)) & near)


def partition_query(points: DataFrame, center: tuple, radius: float, buffer: float, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cubes of radius and radius + buffer around a centre, kept to the ids of members if given."""
    kept = points if members is None else points.join(members.select("id"), "id", "left_semi")
    return ball_query(kept, center, radius, "cheby"), ball_query(kept, center, radius + buffer, "cheby")


def octants(query: DataFrame, search: DataFrame, low: tuple, edge: float, buffer: float) -> tuple[DataFrame, DataFrame]:
    """Query points with the octant (0 to 7, x first) of the cube of edge 2 * edge at low that they lie in, and search
    points once for each octant whose buffered box holds them."""
    inside = in_box(low, tuple(v + 2 * edge for v in low))
    bit = lambda c, v: F.least(F.floor((F.col(c) - F.lit(v)) / F.lit(edge)), F.lit(1))
    octant = (bit("x", low[0]) * 4 + bit("y", low[1]) * 2 + bit("z", low[2])).cast("int")
    boxes = []
    for n, o in enumerate(itertools.product((0, 1), repeat=3)):
        a = tuple(v + k * edge for v, k in zip(low, o))
        boxes.append(F.when(in_box(a, tuple(v + edge for v in a), buffer), F.lit(n)))
    near = F.filter(F.array(*boxes), lambda x: x.isNotNull())
    return query.where(inside).withColumn("octant", octant), search.withColumn("octant", F.explode(near))


@dataclass(frozen=True)
class OctreeRoot:
    """The cube around a cloud's mean that an octree divides: its lowest corner and half of its edge."""

    low: tuple[float, float, float]
    radius: float

    @classmethod
    def of(cls, points: DataFrame) -> OctreeRoot | None:
        """None if there are no points."""
        row = points.agg(*(F.avg(c).alias(c) for c in XYZ)).first()
        if row["x"] is None:
            return None
        far = points.agg(*(F.max(F.abs(F.col(c) - F.lit(row[c]))).alias(c) for c in XYZ)).first()
        radius = max(far) * (1 + 1e-9) + 1e-12
        return cls(tuple(row[c] - radius for c in XYZ), radius)

    def index(self, column: Column, axis: int, level: Column) -> Column:
        return F.floor((column - F.lit(self.low[axis])) / (F.lit(2 * self.radius) / F.pow(F.lit(2.0), level))).cast("long")


def _levels(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def _buffered(points: DataFrame, root: OctreeRoot, buffer: float, last: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(level, ix, iy, iz, carried columns): each point once for each cell whose box, grown by buffer, holds it."""
    out = points.select(*carry, *XYZ, _levels(1, last).alias("level"))
    top = F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
    for axis, c in enumerate(XYZ):
        a, b = (root.index(F.col(c) + F.lit(d), axis, F.col("level")) for d in (-buffer, buffer))
        out = out.withColumns({"_a": F.greatest(a, F.lit(0).cast("long")), "_b": F.least(b, top)}).where("_a <= _b")
        out = out.withColumn(f"i{c}", F.explode(F.sequence("_a", "_b")))
    return out.select("level", "ix", "iy", "iz", *carry)


def octree_leaves(
    points: DataFrame, max_points: int, min_points: int = 1, max_level: int = 10, search: DataFrame | None = None, buffer: float = 0.0, min_radius: float | None = None,
    root: OctreeRoot | None = None,
) -> DataFrame:
    """Leaves (level, ix, iy, iz, n) of the octree around the mean: a cell is split while its population exceeds
    max_points, it is above max_level and half its radius (half its edge) is at least min_radius, if that is given. The
    root is always split; leaves of fewer than min_points points are left out.

    The population is the cell's own points, n; with a search cloud, the search points in the cell's box grown by buffer,
    which then is a column too. One aggregate counts the cells of all levels, combined before the shuffle.
    """
    columns = ["level", "ix", "iy", "iz", "n", *(["population"] if search is not None else [])]
    root = root or OctreeRoot.of(points)
    if root is None:
        return points.sparkSession.createDataFrame([], ", ".join(f"{c} {'int' if c == 'level' else 'long'}" for c in columns))
    cells = points.select(*(F.floor((F.col(c) - F.lit(v)) / F.lit(2 * root.radius / 2**max_level)).cast("long").alias(f"i{c}") for c, v in zip(XYZ, root.low)))
    every = cells.groupBy("ix", "iy", "iz").agg(F.count("*").alias("n")).select("n", "ix", "iy", "iz", _levels(1, max_level).alias("level"))
    above = {f"i{c}": F.expr(f"shiftright(i{c}, {max_level} - level)") for c in XYZ}
    counts = every.withColumns(above).groupBy("level", "ix", "iy", "iz").agg(F.sum("n").cast("long").alias("n"))
    if search is None:
        counts = counts.withColumn("population", F.col("n"))
    else:
        around = _buffered(search, root, buffer, max_level).groupBy("level", "ix", "iy", "iz").agg(F.count("*").alias("population"))
        counts = counts.join(around, ["level", "ix", "iy", "iz"], "left").withColumn("population", F.coalesce("population", F.lit(0)).cast("long"))
    whole = (F.col("population") <= max_points) | (F.col("level") == max_level)
    if min_radius is not None:
        whole = whole | (F.lit(root.radius) / F.pow(F.lit(2.0), F.col("level")) / 2 < min_radius)
    counts = materialize(counts.withColumn("whole", whole))
    parent = counts.select((F.col("level") + 1).alias("level"), F.col("ix").alias("px"), F.col("iy").alias("py"), F.col("iz").alias("pz"), F.col("whole").alias("done"))
    child = counts.withColumns({f"p{c}": F.shiftright(f"i{c}", 1) for c in XYZ}).join(parent, ["level", "px", "py", "pz"], "left")
    return child.where(F.col("whole") & ~F.coalesce("done", F.lit(False)) & (F.col("n") >= min_points)).select(*columns)


def partition_rows(query: DataFrame, search: DataFrame, leaves: DataFrame, root: OctreeRoot, buffer: float) -> tuple[DataFrame, DataFrame]:
    """The query points with the leaf (level, ix, iy, iz) that holds them, and the search points once for each leaf whose
    box, grown by buffer, holds them; points of no leaf go. Equi-joins on the cell, for all levels that leaves have."""
    if buffer < 0:
        raise ValueError("the buffer must not be negative")
    key = ["level", "ix", "iy", "iz"]
    last = leaves.agg(F.max("level")).first()[0] or 0
    leaves = leaves.select(*key)
    if not last:
        return (query.crossJoin(leaves.limit(0)), search.crossJoin(leaves.limit(0)))  # both empty
    own = query.select("*", _levels(1, last).alias("level"))
    own = own.withColumns({f"i{c}": root.index(F.col(c), axis, F.col("level")) for axis, c in enumerate(XYZ)})
    near = _buffered(search.withColumn("_row", F.struct(*search.columns)), root, buffer, last, ("_row",))
    return own.join(leaves, key).select(*query.columns, *key), near.join(leaves, key).select("_row.*", *key)


def rigid_edge(points: DataFrame, max_points: int, start: float, shrink: float = 0.95, min_edge: float = 0.0) -> float:
    """The edge of cubes that hold at most max_points points each: from start on, the edge shrinks by shrink to the power
    of the fullest cube's excess (population over max_points). ValueError if it would fall below min_edge.

    Each try is one aggregate, combined before the shuffle; coincident points beyond max_points can't be parted, so a
    min_edge above zero ends the search for them.
    """
    edge, least = start, min_edge or start * 1e-9
    while True:
        fullest = rigid_leaves(points, edge).agg(F.max("n")).first()[0] or 0
        if fullest <= max_points:
            return edge
        edge *= shrink ** min(fullest / max_points, 20.0)
        if edge < least:
            raise ValueError(f"cubes of edge {least} still hold more than {max_points} points")


def rigid_leaves(points: DataFrame, edge: float, min_points: int = 1) -> DataFrame:
    """Occupied cubes (ix, iy, iz, n) of one edge with at least min_points."""
    cells = points.select(*(F.floor(F.col(c) / F.lit(edge)).cast("long").alias(f"i{c}") for c in XYZ))
    return cells.groupBy("ix", "iy", "iz").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)


def region_population(query: DataFrame, search: DataFrame, low: tuple, high: tuple, buffer: float, max_population: int) -> DataFrame:
    """One row: query points in the box, search points in the buffered box, and whether these fit one partition."""
    if buffer < 0:
        raise ValueError("the buffer must not be negative")
    q = query.agg(F.count_if(in_box(low, high)).alias("query_population"))
    s = search.agg(F.count_if(in_box(low, high, buffer)).alias("search_population"))
    return q.crossJoin(F.broadcast(s)).withColumn("fits", F.col("search_population") <= max_population)


def batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """df with its batch number: runs of `size` rows in the given order, the last one shorter."""
    if size < 1:
        raise ValueError("a batch takes at least one row")
    return ranked(df, [], order, "_r").withColumn("batch", F.floor(F.col("_r") / size).cast("long")).drop("_r")


def every_kth(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The rows of ranks 0, k, 2k, ... in the given order."""
    return ranked(df, [], order, "_r").where(F.col("_r") % k == 0).drop("_r")
