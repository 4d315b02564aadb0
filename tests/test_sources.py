import pytest
from pyspark.sql import types as T

from featureflow.sources.storage import checkpoint_root, checkpointed, scratch_path
from featureflow.sources.tables import read_role, table_schema, write_csv, write_predictions


def test_types_of_the_labelled_table():
    schema = table_schema(["a", "b"], label="class_col")
    assert [f.dataType for f in schema] == [T.LongType(), T.DoubleType(), T.DoubleType()]


def test_csv_role(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    df = spark.createDataFrame([(1, 0.5), (0, 1.25)], table_schema(["a"], label="class_col"))
    write_csv(df, path)
    got = read_role(spark, "train", {"train": path}, df.schema)
    assert sorted(map(tuple, got.collect())) == [(0, 1.25), (1, 0.5)] and got.schema == df.schema
    with pytest.raises(ValueError):
        read_role(spark, "train", {"train": path})


def test_unknown_role(spark):
    with pytest.raises(ValueError):
        read_role(spark, "holdout", {"train": "x"})
    with pytest.raises(ValueError):
        read_role(spark, "test", {"train": "x"})


def test_predictions_have_no_index_column(spark, tmp_path):
    scored = spark.createDataFrame([(2, 1.0), (1, 0.0)], "id bigint, prediction double")
    path = str(tmp_path / "p")
    write_predictions(scored, "m", path, fmt="csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["model_name", "id", "prediction"]
    assert [r["id"] for r in back.collect()] == ["1", "2"]


def test_scratch_is_under_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == root and scratch_path(spark, "x").startswith(f"{root}/x-")
    assert checkpointed(spark.range(5)).count() == 5
