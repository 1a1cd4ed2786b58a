"""Queries through cameras: points and boxes on the screen and back, zoom limits, the height to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.operators import order, spatial
from textloom.operators.camera import FIELD, clamped, focus_height, zoom_limits
from textloom.plans.layout import FLOW, flow_boxes
from textloom.plans.registry import query
from textloom.plans.view import FLAT, POINTS, SCENE, TILTED, points, scene
from textloom.session import cut
from textloom.sources import corpora

FAR = 50.0  # a zoom at which lines are high

#: The tilted camera in SQL by vectors: the eye and three axes, the upward one as a cross product.
CAMERA = f"""
c0 AS (SELECT radians({TILTED.tilt}) AS th, radians({TILTED.yaw}) AS ph, tan(radians({FIELD}) / 2) AS tn, {TILTED.cx}::DOUBLE AS cx, {TILTED.cy}::DOUBLE AS cy, {TILTED.focus}::DOUBLE AS cz, {TILTED.zoom}::DOUBLE AS zoom, {TILTED.width}::DOUBLE AS vw, {TILTED.height}::DOUBLE AS vh, {TILTED.top}::DOUBLE AS top),
c1 AS (SELECT *, vh / (2 * zoom * tn) AS dist, -sin(th) * sin(ph) AS fx, -sin(th) * cos(ph) AS fy, -cos(th) AS fz, cos(ph) AS rx, -sin(ph) AS ry, 0.0::DOUBLE AS rz FROM c0),
cam AS (SELECT *, cx - dist * fx AS ex, cy - dist * fy AS ey, cz - dist * fz AS ez, fy * rz - fz * ry AS ux, fz * rx - fx * rz AS uy, fx * ry - fy * rx AS uz, greatest(0.02 * dist, 0.05) AS near FROM c1)
"""


def _seen(x: str, y: str, z: str) -> tuple[str, str, str]:
    """Screen x, screen y and w of a world point, in SQL over cam."""
    along = lambda a: f"(({x} - ex) * {a}x + ({y} - ey) * {a}y + ({z} - ez) * {a}z)"
    w = along("f")
    return f"(({along('r')} / (tn * vw / vh) / {w} + 1) / 2 * vw)", f"((1 - {along('u')} / tn / {w}) / 2 * vh + top)", w


_PX, _PY, _PW = _seen("x", "y", "z")


@query(f"""
WITH {CAMERA}, {POINTS}, p AS (SELECT *, (event_id % 40)::DOUBLE AS z FROM points)
SELECT event_id, round((x - cx) * zoom + vw / 2, 4) AS flat_x, round((y - cy) * zoom + top + vh / 2, 4) AS flat_y, round({_PX}, 4) AS x, round({_PY}, 4) AS y FROM p, cam
""")
def f_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen points of world points at heights of their own, for the flat and the tilted camera."""
    z = (F.col("event_id") % 40).cast("double")
    flat, tilted = FLAT.project(F.col("x"), F.col("y")), TILTED.project(F.col("x"), F.col("y"), z)
    return points(spark, sf_dir).select("event_id", *(F.round(c, 4).alias(n) for c, n in zip((*flat, *tilted), ("flat_x", "flat_y", "x", "y"), strict=True)))


SCREEN = "screen AS (SELECT event_id, (event_id * 41 % 1280 + 0.5)::DOUBLE AS sx, (event_id * 67 % 720 + 24.25)::DOUBLE AS sy FROM events)"


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return corpora.table(spark, sf_dir, "events").select("event_id", (e * 41 % 1280 + 0.5).cast("double").alias("sx"), (e * 67 % 720 + 24.25).cast("double").alias("sy"))


@query(f"""
WITH {CAMERA}, {SCREEN}, n AS (SELECT event_id, sx, sy, (2 * sx / vw - 1) * tn * vw / vh AS nx, (1 - 2 * (sy - top) / vh) * tn AS ny FROM screen, cam),
d AS (SELECT *, fx + nx * rx + ny * ux AS dx, fy + nx * ry + ny * uy AS dy, fz + nx * rz + ny * uz AS dz FROM n, cam),
t AS (SELECT *, (5.0 - ez) / dz AS t, (cz - ez) / dz AS tf FROM d)
SELECT event_id, round(CASE WHEN t >= near THEN ex + t * dx END, 4) AS x, round(CASE WHEN t >= near THEN ey + t * dy END, 4) AS y,
  round(CASE WHEN tf >= near THEN ex + tf * dx ELSE cx + (sx - vw / 2) * 50 / zoom END, 4) AS under_x, round(CASE WHEN tf >= near THEN ey + tf * dy ELSE cy - 50 * vh / zoom END, 4) AS under_y FROM t
""")
def f_unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World points under screen points at height 5, and at the focus' height with a way out above the horizon."""
    x, y = TILTED.unproject(F.col("sx"), F.col("sy"), F.lit(5.0))
    ux, uy = TILTED.under(F.col("sx"), F.col("sy"))
    return screen(spark, sf_dir).select("event_id", *(F.round(c, 4).alias(n) for c, n in ((x, "x"), (y, "y"), (ux, "under_x"), (uy, "under_y"))))


_CORNERS = [_seen(x, y, "z") for x in ("x0", "x1") for y in ("y0", "y1")]


@query(f"""
WITH {CAMERA}, {FLOW}, b AS (SELECT *, (file_id % 40)::DOUBLE AS z FROM flow), s AS (SELECT file_id, {" AND ".join(f"{c[2]} > 1e-6" for c in _CORNERS)} AS front, [{", ".join(c[0] for c in _CORNERS)}] AS xs, [{", ".join(c[1] for c in _CORNERS)}] AS ys FROM b, cam)
SELECT file_id, round(CASE WHEN front THEN list_min(xs) END, 4) AS left_, round(CASE WHEN front THEN list_min(ys) END, 4) AS top_, round(CASE WHEN front THEN list_max(xs) END, 4) AS right_, round(CASE WHEN front THEN list_max(ys) END, 4) AS bottom FROM s
""")
def f_screen_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all files on the screen of the tilted camera; null where one is behind it."""
    box = TILTED.screen_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), (F.col("file_id") % 40).cast("double"))
    rows = flow_boxes(spark, sf_dir).select("file_id", box.alias("b"))
    return rows.select("file_id", *(F.round(f"b.{c}", 4).alias(n) for c, n in (("x0", "left_"), ("y0", "top_"), ("x1", "right_"), ("y1", "bottom"))))


@query(f"""
WITH {CAMERA}, {FLOW}, q AS (SELECT unnest([0.0, cz, cz + 90.0]) AS z FROM cam), s AS (SELECT z, sx, sy FROM q, (VALUES (-1.0, -1.0), (-1.0, 1.0), (1.0, -1.0), (1.0, 1.0)) AS v(sx, sy)),
d AS (SELECT z, fx + sx * tn * vw / vh * rx + sy * tn * ux AS dx, fy + sx * tn * vw / vh * ry + sy * tn * uy AS dy, fz + sx * tn * vw / vh * rz + sy * tn * uz AS dz FROM s, cam),
p AS (SELECT CASE WHEN (z - ez) / dz >= near THEN ex + (z - ez) / dz * dx END AS px, CASE WHEN (z - ez) / dz >= near THEN ey + (z - ez) / dz * dy END AS py FROM d, cam),
v AS (SELECT min(coalesce(px, cx - 4800)) AS a, min(coalesce(py, cy - 4800)) AS b, max(coalesce(px, cx + 4800)) AS c, max(coalesce(py, cy + 4800)) AS d FROM p, cam)
SELECT file_id FROM flow, v WHERE x1 > greatest(a, -4800) AND y1 > greatest(b, -4800) AND x0 < least(c, 1600 + 4800) AND y0 < least(d, 900 + 4800)
""")
def v_in_tilted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the world rectangle that the tilted camera has in view."""
    from textloom.operators import view

    return flow_boxes(spark, sf_dir).where(view.visible(*TILTED.view(Y.world()))).select("file_id")


@query(f"""
WITH {SCENE}, {POINTS}, h AS (SELECT doc_id, 10.0 + 90 * sqrt(w / max(w) OVER ()) AS top FROM (SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS w FROM documents)),
med AS (SELECT quantile_cont(pitch, 0.5) AS median FROM scene),
met AS (SELECT event_id, file_id, pitch, top FROM points LEFT JOIN scene ON x0 <= x AND x < x1 AND y0 <= y AND y < y1 LEFT JOIN h ON doc_id = file_id),
r AS (SELECT *, coalesce(pitch, median) AS ref FROM met, med)
SELECT event_id, round(ref, 6) AS ref_pitch, round(400 / ref, 6) AS most, round(least(greatest((event_id % 60) * 10.0, 0.94 * 720 / 900 / 2), 400 / ref), 6)::DOUBLE AS zoom, round(CASE WHEN top IS NULL THEN 12.0 ELSE top * least(pitch * {FAR} / 2, 1) END, 6)::DOUBLE AS focus FROM r
""")
def f_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With each point at the middle of the view: the pitch of the file there or the median one, the largest zoom, a zoom
    within the limits, and the height to look at."""
    from textloom.operators import view

    w, h = Y.world()
    placed = cut(scene(spark, sf_dir))
    weights = corpora.prose(spark, sf_dir).select("file_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("weight"), F.lit(2).alias("depth"))
    tops = view.heights(weights).select("file_id", (F.col("base") + F.col("height")).alias("top"))
    met = spatial.at_points(points(spark, sf_dir), placed, w, h).select("event_id", "file_id", "pitch").join(tops, "file_id")
    (median,) = order.quantiles(placed, "pitch", [0.5])
    rows = points(spark, sf_dir).select("event_id").join(met, "event_id", "left")
    pitch = F.coalesce("pitch", F.lit(median))
    fit = FLAT.fitted((w, h)).zoom
    zoom = clamped((F.col("event_id") % 60 * 10).cast("double"), fit, pitch)
    return rows.select("event_id", F.round(pitch, 6).alias("ref_pitch"), F.round(zoom_limits(fit, pitch)[1], 6).alias("most"), F.round(zoom, 6).alias("zoom"), F.round(focus_height(F.col("top"), F.col("pitch"), FAR, TILTED.focus), 6).alias("focus"))
