"""The data source of named frames and arrays."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.sources import store as st


@pytest.fixture
def entries(spark, tmp_path):
    return st.Entries(spark, str(tmp_path / "root"))


def frame(spark, n=100):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("double")).alias("x"), F.array(F.col("id").cast("double"), F.lit(None)).alias("v"), F.struct(F.concat(F.lit("é"), F.col("id").cast("string")).alias("s")).alias("k"), F.to_timestamp(F.lit("2020-01-02 03:04:05")).alias("at"))


def test_frames_go_round(spark, entries):
    df = frame(spark).repartitionByRange(4, "id")
    entries.write(df, "frame")
    back = entries.read("frame")
    assert back.schema.simpleString() == df.schema.simpleString() and back.rdd.getNumPartitions() == 4
    assert sorted(back.collect()) == sorted(df.collect()) and entries.kind("frame") == "frame" and entries.array("frame") is None
    entries.write(df.limit(3), "frame")
    assert entries.read("frame").count() == 3
    df.limit(2).write.format("tidemark").mode("append").save(entries.root, entry="frame")
    assert entries.read("frame").count() == 5


def test_filters_leave_out_files(spark, entries):
    entries.write(frame(spark).repartitionByRange(5, "id"), "frame")
    reader = st.EntrySource({"path": entries.root, "entry": "frame"}).reader(entries.read("frame").schema)
    for f in (st.GreaterThanOrEqual(("id",), 90), st.EqualTo(("x",), 1.0)):
        list(reader.pushFilters([f]))
    assert len(reader.partitions()) == 1
    for test in ("id >= 90", "id = 17", "id < 5 and x > 1", "id > 1000", "id between 39 and 41"):
        assert sorted(entries.read("frame").where(test).collect()) == sorted(frame(spark).where(test).collect())
    assert entries.read("frame").where("id >= 90").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("shape", [(7, 3), (5,), (2, 3, 4), (0, 3)])
def test_arrays_go_round(entries, shape):
    x = np.random.default_rng(1).normal(size=shape)
    entries.write(x, "a")
    assert entries.kind("a") == "array" and np.array_equal(entries.array("a"), x) and entries.array("a").shape == shape
    assert entries.read("a").columns == ["row", "values"] and entries.read("a").count() == len(x)


def test_unknown_names_fall_through(spark, entries):
    assert entries.read("none") is None and entries.array("none") is None
    store = readers.Store(spark, entries.root)
    store.write(frame(spark, 4).select("id"), "table")
    store.write(frame(spark, 6).select("id"), "text", json=True)
    assert entries.read("table").count() == 4 and entries.read("text").count() == 6
    with pytest.raises(PySparkException, match="no entry"):
        spark.read.format("tidemark").load(entries.root, entry="none").collect()


def test_a_failed_write_leaves_the_entry(spark, entries):
    entries.write(frame(spark, 10).select("id"), "frame")
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        entries.write(bad, "frame")
    assert sorted(r.id for r in entries.read("frame").collect()) == list(range(10))


def test_empty(spark, entries):
    entries.write(frame(spark, 0), "empty")
    assert entries.read("empty").count() == 0 and entries.read("empty").columns == frame(spark).columns
