"""The champion gate: does a run's mean metric reach the recorded best?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def champion_gate(best: DataFrame, run: DataFrame) -> DataFrame:
    """(name, mroc, sdroc, best_mroc, accepted) for one run against at most one recorded row.

    Both means are compared at two decimals and a tie counts as a new best. With no record, or a
    record without a mean, the run is accepted; a run without a mean never is.
    """
    tagged = best.select(F.lit("best").alias("side"), "mroc", "sdroc", "name").unionByName(
        run.select(F.lit("run").alias("side"), "mroc", "sdroc", "name")
    )

    def of(side: str, column: str):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    row = tagged.agg(
        of("run", "name").alias("name"),
        of("run", "mroc").alias("mroc"),
        of("run", "sdroc").alias("sdroc"),
        of("best", "mroc").alias("best_mroc"),
    )
    reached = F.col("best_mroc").isNull() | (F.round("best_mroc", 2) <= F.round("mroc", 2))
    return row.withColumn("accepted", F.col("mroc").isNotNull() & reached)
