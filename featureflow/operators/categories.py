"""Category frequencies of many columns at once: ratios, rare values, and values only the test table has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import more_than_one_decimal
from .ranks import value_counts


@dataclass(frozen=True)
class CategoryStats:
    """What the rules need to know about the categories of one column."""

    n_distinct: int
    n_rare: int
    replacement: float | None
    n_test_only: int
    rare: tuple[float, ...]


def _named(df: DataFrame, columns: Sequence[str], *rest) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("item") + 1)
    return df.select(names.alias("column_name"), *rest)


def category_ratios(df: DataFrame, columns: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """(column_name, value, n_<flag>..., ratio): counts, and the train count over the largest train count.

    The ratio is rounded to four places and is null for values the train part does not have.
    Only one row per column, the largest count, is broadcast.
    """
    counts = value_counts(df, columns, flags).drop("bucket")
    largest = counts.groupBy("item").agg(F.max("n_train").alias("largest"))
    ratio = F.when(F.col("n_train") > 0, F.round(F.col("n_train") / F.col("largest"), 4))
    joined = counts.join(F.broadcast(largest), "item").withColumn("ratio", ratio)
    return _named(joined, columns, "value", *[f"n_{f}" for f in flags], "ratio")


def rare_values(ratios: DataFrame, threshold: float) -> DataFrame:
    """(column_name, value) of the categories whose ratio is at or below the threshold."""
    return ratios.filter(F.col("ratio") <= threshold).select("column_name", "value")


def test_only_values(ratios: DataFrame) -> DataFrame:
    """(column_name, value) of categories the train part lacks."""
    return ratios.filter((F.col("n_train") == 0) & (F.col("n_test") > 0)).select("column_name", "value")


def category_stats(
    df: DataFrame,
    columns: Sequence[str],
    flags: Mapping[str, Column],
    threshold: float,
    inline: int = 1_000,
) -> tuple[dict[str, CategoryStats], DataFrame]:
    """Statistics per column, and the rare-value table.

    Up to `inline` rare values of a column are listed in its statistics; longer lists are left empty
    there and stay a distributed table.
    """
    ratios = category_ratios(df, columns, flags)
    is_rare = F.col("ratio") <= threshold
    rare = rare_values(ratios, threshold)
    ratios.persist()
    try:
        # One row per column reaches the driver.
        summary = ratios.groupBy("column_name").agg(
            F.count_if(F.col("n_train") > 0).alias("n_distinct"),
            F.count_if(is_rare).alias("n_rare"),
            F.avg(F.when(is_rare, F.col("value"))).alias("replacement"),
            F.count_if((F.col("n_train") == 0) & (F.col("n_test") > 0)).alias("n_test_only"),
        )
        rows = {r["column_name"]: r for r in summary.collect()}
        short = [c for c, r in rows.items() if 0 < r["n_rare"] <= inline]
        lists: dict[str, list[float]] = {}
        if short:
            for r in rare.filter(F.col("column_name").isin(short)).collect():  # at most `inline` a column
                lists.setdefault(r["column_name"], []).append(r["value"])
    finally:
        ratios.unpersist()
    stats = {
        c: CategoryStats(
            r["n_distinct"], r["n_rare"], r["replacement"], r["n_test_only"], tuple(sorted(lists.get(c, [])))
        )
        for c, r in rows.items()
    }
    return stats, rare


def categorical_test(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, n_distinct, is_categorical): no value has more than one decimal.

    The rule is applied to the distinct values, which also gives their number.
    """
    counts = value_counts(df, columns, {"all": F.lit(True)})
    summary = counts.groupBy("item").agg(
        F.sum("n_all").alias("n"),
        F.count("*").alias("n_distinct"),
        (~F.bool_or(more_than_one_decimal(F.col("value")))).alias("is_categorical"),
    )
    return _named(summary, columns, "n", "n_distinct", "is_categorical")
