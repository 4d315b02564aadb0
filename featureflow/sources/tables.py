"""Scans of the labelled and unlabelled tables and sinks for predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("train", "test")


def table_schema(features: Sequence[str], label: str | None = None, key: str | None = None) -> T.StructType:
    """Explicit schema of a feature table: long key, long label, double features."""
    fields = [T.StructField(key, T.LongType())] if key else []
    fields += [T.StructField(label, T.LongType())] if label else []
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in features])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line, read with a given schema, so no pass is spent on inference."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_role(
    spark: SparkSession, role: str, paths: Mapping[str, str], schema: T.StructType | None = None
) -> DataFrame:
    """The 'train' or 'test' table: Parquet, or CSV when the path ends in .csv."""
    if role not in ROLES or role not in paths:
        raise ValueError(f"unknown data set {role!r}, expected one of {ROLES}")
    path = paths[role]
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV folder with a header in each part."""
    df.write.mode("overwrite").option("header", True).csv(path)


def prediction_frame(scored: DataFrame, model_name: str, key: str = "id") -> DataFrame:
    """(model_name, id, prediction) of a scored table."""
    return scored.select(F.lit(model_name).alias("model_name"), F.col(key).alias("id"), "prediction")


def write_predictions(
    scored: DataFrame, model_name: str, path: str, key: str = "id", fmt: str = "parquet", ordered: bool = True
) -> None:
    """Write predictions, range-sorted by id unless told otherwise."""
    out = prediction_frame(scored, model_name, key)
    if ordered:
        out = out.orderBy("id")
    out.write.mode("overwrite").option("header", True).format(fmt).save(path)


def publish(df: DataFrame, name: str) -> DataFrame:
    """Register a view for SQL users and hand the frame back."""
    df.createOrReplaceTempView(name)
    return df
