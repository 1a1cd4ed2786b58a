"""Sessions, and the package on the executors."""

from __future__ import annotations

import contextlib
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "textloom", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, ANSI arithmetic, adaptive plans."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; functions that run in Python there import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # else it came from an archive that was shipped already
        archive = os.path.join(tempfile.mkdtemp(), "textloom.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        out.write(path, os.path.join("textloom", os.path.relpath(path, here)))
        context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


class Steps:
    """The stored steps of an operator that runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, list[str]()

    def done(self, result: DataFrame) -> DataFrame:
        """The result; steps that it doesn't read are deleted now."""
        used = set(_stored(result))
        gone, self.paths = [p for p in self.paths if p not in used], [p for p in self.paths if p in used]
        jvm = self.spark.sparkContext._jvm
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return result


def _stored(df: DataFrame) -> Iterator[str]:
    """The checkpoints that a plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        if leaves.apply(k).nodeName() == "LogicalRDD" and (file := leaves.apply(k).rdd().getCheckpointFile()).isDefined():
            yield file.get()


_RUNNING: list[Steps] = []


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[Steps]:
    """Plans made inside drop their shuffle files as soon as they have run, not when the driver collects its garbage, and
    ``Steps.done`` deletes the stored steps that the result doesn't read; Spark itself keeps them all unless told otherwise when it
    starts. What a result inside another operator reads is left to that operator.

    For operators that store each step with ``cut``: a stored step needs no shuffle files of the steps before it.
    """
    steps = Steps(spark)
    _RUNNING.append(steps)
    try:
        with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            yield steps
    finally:
        _RUNNING.pop()
        if _RUNNING:
            _RUNNING[-1].paths += steps.paths


def thin(df: DataFrame, by: int = 8) -> DataFrame:
    """A stored table in fewer partitions: for tables that hold a small part of the rows that they were made from."""
    return df.coalesce(max(8, df._jdf.rdd().getNumPartitions() // by))


def sweep(spark: SparkSession) -> None:
    """Collects the garbage of finished steps here and in the driver's JVM, so that Spark's cleaner can drop what they left:
    broadcasts, checkpoint files and plans. Spark does so by itself every half hour, which is late for a loop of steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that the context was given. Only where there is none and all runs on one machine, as
    in tests, is it one below the warehouse; on a cluster that may be a folder that other machines don't see."""
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that is written and read again."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back, so that losing an executor loses nothing."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    if _RUNNING:
        _RUNNING[-1].paths += _stored(out)
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session (dots as two underscores) for plans that run inside; what was there before comes back."""
    named = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
