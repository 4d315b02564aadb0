"""Train and hold-out splits: keyed (default), Bernoulli, and by anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import in_sample, split_name


def named_split(df: DataFrame, key: str, seed: int = 1, fraction: float = 0.75) -> DataFrame:
    """Append `name` in {train, test}, decided by the key alone."""
    return df.withColumn("name", split_name(F.col(key), seed, fraction))


def keyed_split(
    df: DataFrame, key: str, seed: int = 1, fraction: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """The sample and its exact complement, null keys included there, as two filters of one table; no join."""
    chosen = in_sample(F.col(key), seed, fraction)
    return df.filter(chosen), df.filter(~chosen)


def bernoulli_sample(df: DataFrame, seed: int, fraction: float = 0.75) -> DataFrame:
    """Independent draw of each row, without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
