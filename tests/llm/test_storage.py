"""What operators leave in the shared folder, and in the session."""

import os
import random
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from textloom.llm import collocations, embedding_dedup, exact_dedup, near_dedup, vector_codes
from textloom.session import _stored


def left(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = urlparse(folder.get()).path if folder.isDefined() else None
    return {f"{at}/{n}" for n in os.listdir(at)} if at and os.path.isdir(at) else set()


def reads(df):
    return {urlparse(p).path for p in _stored(df)}


OPERATORS = {"near": near_dedup.classes, "near rows": near_dedup.keep_one, "exact": exact_dedup.groups, "exact rows": exact_dedup.keep_one, "phrases": lambda d: collocations.collocations(d, 2)}


@pytest.mark.parametrize("name", OPERATORS)
def test_only_what_a_result_reads_is_left(spark, stored, prose, name):
    r = random.Random(1)
    docs = stored([(i, prose(60, r.randrange(12)), "a") for i in range(40)])
    before, settings = left(spark), dict(spark.conf.getAll)
    result = OPERATORS[name](docs)
    assert left(spark) - before == reads(result) - before
    assert result.count() > 0
    changed = {k for k, v in dict(spark.conf.getAll).items() if settings.get(k) != v} - {"spark.sql.execution.arrow.maxRecordsPerBatch"}
    assert not changed


def test_vectors_leave_nothing_else(spark, tmp_path):
    r = random.Random(2)
    spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/v")
    table = spark.read.parquet(f"{tmp_path}/v")
    for operator in (vector_codes.codes, embedding_dedup.links):
        before = left(spark)
        result = operator(table)
        assert left(spark) - before == reads(result) and result.count() == 300


def test_the_pipeline_leaves_what_its_rows_read(spark, small):
    before = left(spark)
    result = corpus_pipeline.run(spark, small)
    assert left(spark) - before == reads(result) and 0 < len(reads(result)) <= 3
    assert result.count() > 0
