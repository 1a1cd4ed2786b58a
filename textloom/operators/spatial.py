"""Joins by position: enclosing intervals, points in rectangles, overlaps.

Each is an equi-join on buckets or grid cells with the exact predicate left over, so no pair of far-apart rows is ever formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a coordinate on the curve, and rectangles of a row group of a stored grid.
CURVE_BITS, GROUP_BYTES = 16, 1 << 20


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, point_id: str, span_id: str, width: int = 64) -> DataFrame:
    """The smallest span [first, past) around each point, the first of equals; spans: key, first, past, span_id."""
    buckets = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("past") - 1) / width)))
    wide = spans.where("first < past").select(key, "first", "past", span_id, buckets.alias("__b"))
    met = points.withColumn("__b", F.floor(F.col(at) / width)).join(wide, [key, "__b"]).where((F.col("first") <= F.col(at)) & (F.col(at) < F.col("past")))
    best = met.groupBy(point_id).agg(F.min(F.struct((F.col("past") - F.col("first")).alias("size"), F.col(span_id).alias("id"))).alias("best"))
    return best.select(point_id, F.col("best.id").alias(span_id))


def cells(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float, across: int, down: int) -> tuple[Column, Column]:
    """Columns and rows of the grid cells that a rectangle covers, as arrays."""

    def span(a: Column, b: Column, size: float, n: int) -> Column:
        low = F.least(F.greatest(F.floor(a / size * n), F.lit(0)), F.lit(n - 1))
        high = F.least(F.greatest(F.floor(b / size * n), F.lit(0)), F.lit(n - 1))
        return F.sequence(low, high)

    return span(x0, x1, width, across), span(y0, y1, height, down)


def resolution(rects: DataFrame, width: float, height: float) -> int:
    """Cells across a grid of as many cells as there are rectangles, whatever the world's shape, but none smaller than rectangles are on
    average: in a world that gets taller with its rectangles, finer ones would put each of them in more cells the more there are."""
    n, w, h = rects.agg(F.count("*"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first()
    side = max(w or 0.0, h or 0.0, width / 4096)
    return max(1, min(int(math.sqrt(n * width / height)), int(width / side)))


def grid(rects: DataFrame, width: float, height: float, across: int = 64, first: bool = False) -> DataFrame:
    """rects (x0, y0, x1, y1, ...) once for each grid cell they cover, with the cell's cx, cy; first: and those of their first cell."""
    down = max(1, round(across * height / width))
    xs, ys = cells(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), width, height, across, down)
    own = rects.withColumns({"cx0": F.get(xs, F.lit(0)), "cy0": F.get(ys, F.lit(0))}) if first else rects
    return own.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def at_points(points: DataFrame, rects: DataFrame, width: float, height: float, across: int | None = None) -> DataFrame:
    """Points (x, y, ...) with each rectangle around them, half open; through a grid as fine as the rectangles are many."""
    across = across or resolution(rects, width, height)
    down = max(1, round(across * height / width))
    placed = points.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    placed = placed.withColumn("cx", F.floor(F.col("x") / width * across)).withColumn("cy", F.floor(F.col("y") / height * down))
    met = placed.join(grid(rects, width, height, across), ["cx", "cy"])
    return met.where("x0 <= x AND x < x1 AND y0 <= y AND y < y1").drop("cx", "cy")


def _overlap_resolution(rects: DataFrame, width: float, height: float) -> int:
    """Cells across a grid for pairs: as fine as the rectangles are many, but no finer than they are large on average, else each is
    in so many cells that its copies outgrow the table."""
    n, w, h = rects.agg(F.count("*"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first()
    side = max(w or 0.0, (h or 0.0) * width / height, width / 4096)
    return max(1, min(math.isqrt(n), int(width / side)))


def overlaps(rects: DataFrame, group: str, name: str, width: float, height: float, slack: float = 1e-6, across: int | None = None) -> DataFrame:
    """Pairs (a, b) of rectangles of one group that overlap by more than slack: only those that share a cell are compared, and a pair
    is found in one cell alone, the first that both cover, so no pairs are made twice and dropped.

    The sides are merged, never broadcast: a cell's rows are many more than the size of the scan lets Spark expect.
    """
    across = across or _overlap_resolution(rects, width, height)
    own = rects.select(group, name, "x0", "y0", "x1", "y1")
    one = grid(own, width, height, across, first=True)
    two = one.select(F.col(group), "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in (name, "x0", "y0", "x1", "y1", "cx0", "cy0")))
    met = one.join(two.hint("merge"), [group, "cx", "cy"]).where(F.col(name) < F.col(f"b_{name}"))
    met = met.where((F.col("cx") == F.greatest("cx0", "b_cx0")) & (F.col("cy") == F.greatest("cy0", "b_cy0")))
    met = met.where((F.col("x0") < F.col("b_x1") - slack) & (F.col("b_x0") < F.col("x1") - slack) & (F.col("y0") < F.col("b_y1") - slack) & (F.col("b_y0") < F.col("y1") - slack))
    return met.select(F.col(name).alias("a"), F.col(f"b_{name}").alias("b"))


def outside(children: DataFrame, parents: DataFrame, key: str, slack: float = 1e-6) -> DataFrame:
    """Children that stick out of their parent's rectangle; parents: key, x0, y0, x1, y1."""
    around = parents.select(key, *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")))
    met = children.join(around, key)
    inside = (F.col("x0") >= F.col("p_x0") - slack) & (F.col("y0") >= F.col("p_y0") - slack) & (F.col("x1") <= F.col("p_x1") + slack) & (F.col("y1") <= F.col("p_y1") + slack)
    return met.where(~inside).drop("p_x0", "p_y0", "p_x1", "p_y1")


def _spread(bits: Column) -> Column:
    """The bits of a number of CURVE_BITS bits, with a gap behind each."""
    out = bits.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def curve(x: Column, y: Column, width: float, height: float) -> Column:
    """The place of a point on a curve that fills the world: bits of both coordinates in turn, so near places are near points."""
    most = (1 << CURVE_BITS) - 1
    fixed = [F.least(F.greatest(F.floor(c / size * (most + 1)), F.lit(0)), F.lit(most)) for c, size in ((x, width), (y, height))]
    return _spread(fixed[0]).bitwiseOR(F.shiftleft(_spread(fixed[1]), 1))


def store(rects: DataFrame, path: str, width: float, height: float, group_bytes: int = GROUP_BYTES) -> None:
    """Writes rectangles (x0, y0, x1, y1, ...) clustered along the curve of their middles, in small row groups: the least and largest
    coordinates of a group say whether a view or a point can be in it."""
    spot = curve((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, width, height)
    dealt = rects.withColumn("__spot", spot).repartitionByRange("__spot").sortWithinPartitions("__spot").drop("__spot")
    dealt.write.mode("overwrite").option("parquet.block.size", str(group_bytes)).option("parquet.block.size.row.check.min", "100").parquet(path)


def in_view(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Stored rectangles that meet a view; edges that only touch don't count. The comparisons reach the scan's row groups."""
    return spark.read.parquet(path).where((F.col("x1") > x0) & (F.col("x0") < x1) & (F.col("y1") > y0) & (F.col("y0") < y1))


def around(spark: SparkSession, path: str, x: float, y: float) -> DataFrame:
    """Stored rectangles around a point, half open, likewise."""
    return spark.read.parquet(path).where((F.col("x0") <= x) & (F.col("x1") > x) & (F.col("y0") <= y) & (F.col("y1") > y))
