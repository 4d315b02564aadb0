"""The champion record: versions of one row mroc, sdroc, name, appended and never overwritten.

A record kept elsewhere as a CSV file or folder with these columns is read as the version before the first.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

SCHEMA = "mroc double, sdroc double, name string"


def champion_version(spark: SparkSession, path: str) -> int:
    """Number of the last committed record; 0 when nothing was committed."""
    return Versions(spark, path).latest()


def read_champion(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """At most one row: the record of a version (default: the last), else the last line of a plain CSV; empty when there is none."""
    versions = Versions(spark, path)
    version = versions.latest() if version is None else version
    where = versions.open(version) if version else path
    try:
        rows = spark.read.schema(SCHEMA).option("header", True).csv(where)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    placed = rows.select(F.struct("mroc", "sdroc", "name").alias("line"), F.monotonically_increasing_id().alias("place"))
    last = placed.filter("mroc IS NOT NULL OR sdroc IS NOT NULL OR name IS NOT NULL").agg(F.max_by("line", "place").alias("r"))
    return last.filter("r IS NOT NULL").select("r.*")


def write_champion(metrics: DataFrame, path: str, after: int | None = None) -> int:
    """Append the record as the version after `after` (default: the last one) and return its number.

    The row is written before it is committed: a run that stops in between leaves the earlier record in place, and
    one that lost against another run gets a VersionConflict.
    """
    row = metrics.select("mroc", "sdroc", "name").first()
    spark = metrics.sparkSession
    versions = Versions(spark, path)
    after = versions.latest() if after is None else after
    name = versions.reserve()
    spark.createDataFrame([tuple(row)], SCHEMA).coalesce(1).write.option("header", True).csv(versions.data_path(name))
    return versions.commit(name, after)
