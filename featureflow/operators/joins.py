"""Keyed joins: columns onto a table, labels onto features, hold-outs, and value lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 200_000
HOT_SHARE = 1_000


def attach_columns(df: DataFrame, extra: DataFrame, key: str, hot_keys: bool = False) -> DataFrame:
    """Left outer join of further columns, unique by key; the left table keeps every row.

    With row identities on both sides the plain join is even. Set hot_keys where the key repeats on
    the left and one value may hold a large share of the rows.
    """
    return lookup(df, key, extra) if hot_keys else df.join(extra, key, "left")


def attach_labels(
    labels: DataFrame, features: DataFrame, key: str, label: str, feature_cols: list[str]
) -> DataFrame:
    """(id, label, features...): labels on the left, so a label without features keeps a row of nulls."""
    left = labels.select(F.col(key).alias("id"), F.col(label).alias("label"))
    right = features.select(F.col(key).alias("id"), *feature_cols)
    return left.join(right, "id", "left")


def holdout(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in the sample; a null key is in no sample, so its rows stay."""
    return df.join(sample.select(key), key, "left_anti")


def lookup(
    df: DataFrame, column: str, table: DataFrame, small_rows: int = SMALL_TABLE_ROWS
) -> DataFrame:
    """Left join of a table of unique values on `column`, safe when one value holds many rows.

    A table checked to be small is broadcast. A larger one is shuffled, but nulls and the values
    holding more than 1/HOT_SHARE of the rows (so fewer than HOT_SHARE of them) skip the shuffle
    and meet their own few table rows by broadcast.
    """
    if table.limit(small_rows + 1).count() <= small_rows:
        return df.join(F.broadcast(table), column, "left")
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = df.count()
    hot = [r[0] for r in counts.filter(F.col("n") * HOT_SHARE > total).select(column).collect()]
    is_hot = F.col(column).isNull() | F.col(column).isin(hot)
    few = F.broadcast(table.filter(F.col(column).isin(hot)))
    return (
        df.filter(is_hot)
        .join(few, column, "left")
        .unionByName(df.filter(~is_hot).join(table, column, "left"))
    )
