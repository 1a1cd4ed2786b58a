import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import export as X


def test_bundle_round_trip():
    arrays = {"b": np.arange(7, dtype=np.uint16), "a": np.array([[1.5, 2.5]], np.float32), "empty": np.zeros(0, np.uint8), "c": np.array([3], np.int32)}
    data = X.bundle(arrays)
    assert len(data) % X.ALIGN == 0 and data[:4] == X.MAGIC
    back = X.unbundle(data)
    assert list(back) == sorted(arrays)
    for k, v in arrays.items():
        assert back[k].dtype == v.dtype and np.array_equal(back[k], v)
    with pytest.raises(ValueError):
        X.unbundle(b"nope" + data[4:])


def test_bundle_files(spark, tmp_path):
    X.write_bundle(spark, f"file://{tmp_path}/v.bin", {"x": np.arange(3, dtype=np.float64)})
    assert X.read_bundle(spark, f"file://{tmp_path}/v.bin")["x"].tolist() == [0, 1, 2]


def test_deltas_round_trip(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.1, 0.35, 2.0]), (1, [5.0]), (2, [])], "r int, xs array<double>")
    done = rows.crossJoin(X.delta_scale(rows)).withColumn("d", X.deltas(F.col("xs"), F.col("scale"))).withColumn("back", X.undone(F.col("d"), F.col("scale")))
    for r in done.where("r < 2").collect():
        assert r.scale == 8192 and all(abs(a - b) <= 0.5 / 8192 for a, b in zip(r.xs, r.back, strict=True))


def test_coarse_scale(spark):
    rows = spark.createDataFrame([(0, [0.0, 100.0])], "r int, xs array<double>")
    assert X.delta_scale(rows).first().scale == 512


def test_tables_strings_and_scheme(spark, tmp_path):
    files = spark.createDataFrame([(1, "b/é", 2.5, "x"), (0, "a", 1.5, "y"), (2, "日", 0.5, "z")], "file_id long, path string, weight double, other string")
    got = X.tables({"file": files}, {"file": ["file_id"]}, {"file_path": "strings", "file_weight": "float32"}) | X.scheme({"items": ["#ff8000", "000102"]})
    path = f"file://{tmp_path}/viewer.bin.gz"
    X.write_bundle(spark, path, got)
    back = X.read_bundle(spark, path)
    assert list(back) == ["file_path", "file_path_off", "file_weight", "scheme_items"]
    text, off = back["file_path"].tobytes(), back["file_path_off"].tolist()
    assert [text[a:b].decode("cp1252") for a, b in zip(off, off[1:])] == ["a", "b/é", "?"] and back["file_weight"].tolist() == [1.5, 2.5, 0.5]
    assert back["scheme_items"].tolist() == [[255, 128, 0], [0, 1, 2]]
