"""What the operators share: slices, row keys, names, the shared folder."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from tessella.llm import common


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * 10] * 5 + ["y" * 1_000] + [None] + ["z" * 40] * 20 + [""] * 30
    b = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], names=["t", "n"])
    parts = list(common.slices(iter([b, b.slice(0, 0), b]), rows=12, size=100))
    assert [n for p in parts for n in p.column(1).to_pylist()] == [*range(len(texts))] * 2
    for p in parts:
        size = sum(len(x or "") for x in p.column(0).to_pylist())
        assert p.num_rows <= 12 and (size <= 100 or p.num_rows == 1)


def test_row_keys_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, None, "a"), (1, None, None)], "p long, q long, `r.s` string").withColumn("m", F.create_map(F.lit("k"), F.col("p")))
    keys = [r[0] for r in rows.select(common.row_key(rows)).collect()]
    assert len(set(keys)) == 3 and keys[0] == keys[2]


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Own int, own_ int")
    assert common.free_name(df, "own", "own", "x") == ["own__", "own___", "x"]


def test_a_scope_leaves_nothing_behind(spark, tmp_path):
    root = common.shared_dir(spark).removeprefix("file://") + "/tessella"
    with common.scope(spark):
        path = common.fresh(spark, "t").removeprefix("file://")
        assert common.cut(spark.range(3), "t").count() == 3
        assert os.path.dirname(path) in [os.path.join(root, x) for x in os.listdir(root)]
    assert not os.path.exists(os.path.dirname(path))


def test_stages_take_empty_tables_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
