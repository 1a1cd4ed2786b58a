"""Trees from paths: directories, pre-order, roll-ups, hues, crumbs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lines import ranked
from textloom.session import cut, settings


def parent_path(path: Column) -> Column:
    """The directory of a path; the root is the empty path."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/+$", "")


def ancestors(path: Column) -> Column:
    """All directories above a file, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def tree_key(path: Column) -> Column:
    """Sorts files of a tree in pre-order: a directory's files before its directories, names in code-point order."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda name, i: F.struct((i < F.size(parts) - 1).alias("inner"), name.alias("name")))


def directories(files: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """path, depth, files and the sums of values of every directory, the root included; files: path, values."""
    above = files.select(F.explode(ancestors(F.col("path"))).alias("dir"), *values)
    sums = above.groupBy("dir").agg(F.count("*").alias("files"), *(F.sum(v).alias(v) for v in values))
    return sums.select(F.col("dir").alias("path"), F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), "files", *values)


def pre_order(paths: DataFrame) -> DataFrame:
    """path with its number in pre-order."""
    return ranked(paths.select("path"), [tree_key(F.col("path"))], "file_no").select("path", F.col("file_no").cast("long").alias("file_no"))


def hues(dirs: DataFrame, count: int = 12) -> DataFrame:
    """path and hue of every directory: that of its ancestor below the root, whose children count from 1; the root has 0."""
    top = dirs.where("depth = 1").select(F.col("path").alias("top"), (F.row_number().over(Window.orderBy("path")) % count).alias("hue"))
    own = dirs.withColumn("top", F.element_at(F.split("path", "/"), 1))
    return own.join(F.broadcast(top), "top", "left").select("path", F.when(F.col("depth") == 0, 0).otherwise(F.col("hue")).alias("hue"))


def walked(dirs: DataFrame, most: int = 1000) -> DataFrame:
    """id, depth, path, crumb of every directory that the roots lead to, from dirs: id, parent (null for a root), label.

    For trees that have ids and no paths: a recursive query that goes down a level a round, ``most`` levels at most (more are an
    error). Roots are left out of paths and crumbs.
    """
    spark = dirs.sparkSession
    # stored inside, as the limits are looked up when the query runs: levels, and no limit on rows
    with settings(spark, spark__sql__cteRecursionLevelLimit=str(most), spark__sql__cteRecursionRowLimit="-1"):
        return cut(
            spark.sql(
                """
                WITH RECURSIVE walk AS (
                  SELECT id, 0 AS depth, '' AS path, '' AS crumb FROM {dirs} WHERE parent IS NULL
                  UNION ALL
                  SELECT d.id, w.depth + 1, concat(w.path, if(w.depth > 0, '/', ''), d.label), concat(w.crumb, if(w.depth > 0, ' › ', ''), d.label)
                  FROM walk w JOIN {dirs} d ON d.parent = w.id)
                SELECT * FROM walk
                """,
                dirs=dirs,
            )
        )


def crumb(path: Column) -> Column:
    """The directories down to a path, joined for display."""
    return F.array_join(F.split(path, "/"), " › ")


def tags(dirs: DataFrame, share: float = 0.85) -> DataFrame:
    """path and tag of every directory that draws one: its name behind those of the directories just above it that draw none.

    dirs: path, parent, depth, w, h, pad. A directory draws none if its inner box is filled by exactly one child directory, to
    that share at least. The root draws none and hands nothing down.
    """
    kids = dirs.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("kids"), F.max(F.col("w") * F.col("h")).alias("area"))
    inner = F.greatest(F.col("w") - 2 * F.col("pad"), F.lit(0)) * F.greatest(F.col("h") - 2 * F.col("pad"), F.lit(0))
    hidden = dirs.join(kids, "path").where((F.col("depth") > 0) & (F.col("kids") == 1) & (F.col("area") >= share * inner)).select("path", F.lit(True).alias("hidden"))
    own = dirs.where("depth > 0")
    above = own.select("path", F.posexplode(F.concat(F.slice(ancestors(F.col("path")), 2, 1 << 20), F.array("path"))).alias("level", "above"))
    marked = above.join(hidden.withColumnRenamed("path", "above"), "above", "left")
    names = marked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("level", F.element_at(F.split("above", "/"), -1).alias("name"), F.coalesce("hidden", F.lit(False)).alias("hidden")))).alias("names"))
    none = F.array().cast("array<string>")
    handed = F.aggregate(F.slice("names", F.lit(1), F.size("names") - 1), none, lambda kept, n: F.when(n["hidden"], F.concat(kept, F.array(n["name"]))).otherwise(none))
    return names.join(hidden, "path", "left_anti").select("path", F.array_join(F.concat(handed, F.array(F.element_at("names", -1)["name"])), " · ").alias("tag"))


def by_depth(dirs: DataFrame) -> DataFrame:
    """place of every directory, from 1: shallow ones first, those of a depth by path. A window for each depth and one over depths."""
    inside = dirs.withColumn("__k", F.row_number().over(Window.partitionBy("depth").orderBy("path")))
    sizes = dirs.groupBy("depth").agg(F.count("*").alias("n"))
    before = sizes.select("depth", F.coalesce(F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "depth").withColumn("place", F.col("__before") + F.col("__k")).drop("__before", "__k")
