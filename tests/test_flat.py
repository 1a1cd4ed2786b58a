import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import export as X
from textloom.sources import flat


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/v.bin"
    rows = spark.range(1000).select("id", (F.col("id") * 0.5).alias("x"), F.array((F.col("id") % 7).cast("double"), F.lit(2.0)).alias("xy"), (F.col("id") % 250).alias("b")).repartition(7)
    texts = spark.createDataFrame([(0, "a/é"), (1, None), (2, ""), (3, "日x"), (4, "last")], "id long, t string")
    parts = [flat.slices(rows, "id", {"x": ("x", "float64"), "xy": ("xy", "float32"), "b": ("b", "uint8"), "wide": ("id", "uint64")}), flat.text_slices(texts, "id", "s_t", "t")]
    laid = flat.write(flat.together(parts), path, {"empty": ("int32", 0), "none": ("float64", 4)})
    assert [e.name for e in laid] == ["b", "empty", "none", "s_t", "s_t_off", "wide", "x", "xy"]
    data = (tmp_path / "v.bin").read_bytes()
    assert len(data) % X.ALIGN == 0 and not (tmp_path / "v.bin.open").exists()
    back = X.unbundle(data)  # the reader of one process
    assert back["x"].tolist() == [i * 0.5 for i in range(1000)] and back["xy"].tolist() == [[i % 7, 2.0] for i in range(1000)]
    assert back["b"].dtype == np.uint8 and back["wide"].dtype == np.uint64 and back["empty"].shape == (0,) and back["none"].shape == (0, 4)
    text, off = back["s_t"].tobytes(), back["s_t_off"].tolist()
    assert [text[a:b].decode("cp1252") for a, b in zip(off, off[1:])] == ["a/é", "", "", "?x", "last"]
    for name in ("x", "b", "xy", "empty"):
        read = flat.read(spark, path, name, 600)
        got = sorted(map(tuple, read.collect()))
        assert got == list(enumerate(back[name].reshape(-1).tolist()))
        assert read.rdd.getNumPartitions() == max(1, -(-back[name].nbytes // (600 // back[name].itemsize * back[name].itemsize)))


def test_same_bytes_as_the_bundle(spark, tmp_path):
    arrays = {"b": np.arange(70, dtype=np.uint16), "a": np.arange(6, dtype=np.float32)}
    parts = [flat.slices(spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "id long, v double").repartition(3), "id", {n: ("v", a.dtype.name)}) for n, a in arrays.items()]
    flat.write(flat.together(parts), f"{tmp_path}/v.bin")
    assert (tmp_path / "v.bin").read_bytes() == X.bundle(arrays)


def test_wrong_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"nope" + bytes(100))
    with pytest.raises(ValueError):
        flat.entries(f"{tmp_path}/x.bin")
    with pytest.raises(ValueError):
        flat.local("s3://bucket/x")
    one = flat.slices(spark.createDataFrame([(0, 1.0)], "id long, v double"), "id", {"a": ("v", "float32")})
    two = flat.slices(spark.createDataFrame([(0, 1.0)], "id long, v double"), "id", {"a": ("v", "float64")})
    with pytest.raises(ValueError):
        flat.write(one.unionByName(two), f"{tmp_path}/y.bin")


def test_failed_write_leaves_no_file(spark, tmp_path):
    good = flat.slices(spark.createDataFrame([(0, 1.0)], "id long, v double"), "id", {"a": ("v", "float32")})
    bad = good.select("name", "kind", "width", F.when(F.spark_partition_id() >= 0, F.lit(-(1 << 40))).alias("first"), "data")
    with pytest.raises(Exception):
        flat.write(bad, f"{tmp_path}/z.bin")
    assert not (tmp_path / "z.bin").exists() and not (tmp_path / "z.bin.open").exists()
