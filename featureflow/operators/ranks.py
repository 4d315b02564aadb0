"""Order statistics and dense row numbers without moving a whole column into one task.

Rows are spread over buckets of consecutive values. The bucket borders are approximate
quantiles of a bounded sample, fixed on the driver once (a bounded list of numbers), so a row's bucket is a pure
function of its value and any task can be recomputed safely. Ranks are then a per-bucket
running count plus the number of rows in the lower buckets.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import as_number
from ..sources.storage import checkpointed

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 20_000
SAMPLE_PER_BUCKET = 20
COLUMNS_PER_JOB = 32


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Number of buckets with borders on the driver, so that each holds about `rows_per_bucket` rows or is divided further."""
    return max(1, min(MAX_BUCKETS, -(-rows // rows_per_bucket)))


def parts_per_bucket(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Even parts of the values of a bucket that keep a part at about `rows_per_bucket` rows however many there are."""
    return max(1, -(-rows // (rows_per_bucket * bucket_count(rows, rows_per_bucket))))


def blocks(columns: Sequence[str], size: int = COLUMNS_PER_JOB) -> list[Sequence[str]]:
    """Consecutive blocks of columns, each small enough for the generated code of one job."""
    return [columns[i : i + size] for i in range(0, len(columns), size)]


def split_points(df: DataFrame, columns: Sequence[str], buckets: int, rows: int) -> dict[str, list[float]]:
    """Strictly increasing inner borders per column; a value holding many rows yields one border.

    Borders only balance the work, no result depends on them, so a sample of SAMPLE_PER_BUCKET rows
    a bucket is enough and bounds what the last step of the quantile sketch has to merge.
    """
    if buckets <= 1:
        return {c: [] for c in columns}
    fraction = buckets * SAMPLE_PER_BUCKET / max(rows, 1)
    if fraction < 1:
        df = df.sample(withReplacement=False, fraction=fraction, seed=buckets)
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    accuracy = F.lit(max(10_000, 10 * buckets))
    out: dict[str, list[float]] = {}
    for block in blocks(columns):
        row = df.agg(
            *[F.percentile_approx(as_number(F.col(c)), shares, accuracy).alias(f"p{i}") for i, c in enumerate(block)]
        ).first()
        out.update({c: sorted(set(row[f"p{i}"] or [])) for i, c in enumerate(block)})
    return out


def add_buckets(
    df: DataFrame, points: Mapping[str, Sequence[float]], names: Mapping[str, str]
) -> DataFrame:
    """Append one bucket number per column, looked up by binary search in its borders."""
    split = [c for c in names if points[c]]
    for c in names:
        if c not in split:
            df = df.withColumn(names[c], F.lit(0.0))
    if not split:
        return df
    borders = [[float("-inf"), *points[c], float("inf")] for c in split]
    return Bucketizer(
        splitsArray=borders, inputCols=split, outputCols=[names[c] for c in split], handleInvalid="keep"
    ).transform(df)


def _divided(value: Column, bucket: Column, points: Sequence[float], parts: int) -> Column:
    """Bucket number, or with several parts bucket * parts + part; it never falls as the value rises.

    The first and the last bucket have no outer border and are divided on the scale of their neighbours.
    """
    if parts == 1 or not points:
        return bucket.cast("long")
    width = (points[-1] - points[0]) / len(points) or 1.0
    borders = F.array(*[F.lit(float(x)) for x in (points[0] - width, *points, points[-1] + width)])
    low, high = F.get(borders, bucket.cast("int")), F.get(borders, bucket.cast("int") + 1)
    part = F.floor((value - low) / (high - low) * parts)
    return bucket.cast("long") * parts + F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))


def value_counts(
    df: DataFrame,
    columns: Sequence[str],
    flags: Mapping[str, Column],
    points: Mapping[str, Sequence[float]] | None = None,
    parts: int = 1,
    within: Sequence[str] = (),
) -> DataFrame:
    """(item, <within>, bucket, value, n_<flag>...): distinct values of many columns in one pass.

    With `parts` above 1 every bucket is cut into that many even parts, numbered through.

    `item` is the position of the column. Counting before anything is sorted leaves one row per
    distinct value and map task, so a value held by a third of the rows costs no more than any other.
    """
    wide = df.select(
        *[as_number(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)],
        *[f.cast("int").alias(f"f_{name}") for name, f in flags.items()],
        *within,
    )
    if points is None:
        points = {c: [] for c in columns}
    wide = add_buckets(
        wide,
        {f"v{i}": points[c] for i, c in enumerate(columns)},
        {f"v{i}": f"b{i}" for i in range(len(columns))},
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("item"),
                _divided(F.col(f"v{i}"), F.col(f"b{i}"), points[c], parts).alias("bucket"),
                F.col(f"v{i}").alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    long = wide.select(F.inline(cells), *[f"f_{name}" for name in flags], *within).filter("value IS NOT NULL")
    return long.groupBy("item", *within, "bucket", "value").agg(*[F.sum(f"f_{name}").alias(f"n_{name}") for name in flags])


def ordered_counts(
    df: DataFrame,
    columns: Sequence[str],
    flags: Mapping[str, Column],
    rows: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    within: Sequence[str] = (),
) -> DataFrame:
    """(item, <within>, value, n_<flag>, upto_<flag>): counts and counts up to and including each value, apart for each of `within`.

    `rows` is the row count of df, used only to choose the number of buckets.
    """
    buckets, parts = bucket_count(rows, rows_per_bucket), parts_per_bucket(rows, rows_per_bucket)
    counts = value_counts(df, columns, flags, split_points(df, columns, buckets, rows), parts, within)
    names, items = list(flags), ["item", *within]
    window = W.partitionBy(*items, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = counts.select(
        *items, "bucket", "value", *[f"n_{f}" for f in names], *[F.sum(f"n_{f}").over(window).alias(f"r_{f}") for f in names]
    )
    if buckets == 1:
        return running.select(*items, "value", *[f"n_{f}" for f in names], *[F.col(f"r_{f}").alias(f"upto_{f}") for f in names])
    sizes = counts.groupBy(*items, "bucket").agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in names])
    offsets = starts(sizes, "bucket", {f"n_{f}": f"o_{f}" for f in names}, parts, items).select(*items, "bucket", *[f"o_{f}" for f in names])
    return running.join(offsets, [*items, "bucket"]).select(
        *items, "value", *[f"n_{f}" for f in names], *[(F.col(f"r_{f}") + F.col(f"o_{f}")).alias(f"upto_{f}") for f in names]
    )


def starts(sizes: DataFrame, place: str, sums: Mapping[str, str], group: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Append, for each size column, the sum over all rows of lower `place`; exact at any number of rows.

    The prefix sum has two levels: inside groups of `group` consecutive places, and over the groups, so
    that neither holds more rows in one task than there are groups or places in a group.
    """
    inside = W.partitionBy(*within, "__group").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy(*within).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    grouped = sizes.withColumn("__group", F.floor(F.col(place) / group))
    above = grouped.groupBy(*within, "__group").agg(*[F.sum(n).alias(n) for n in sums])
    zero = F.lit(0).cast("bigint")
    above = above.select(*within, "__group", *[F.coalesce(F.sum(n).over(over), zero).alias(f"__above_{o}") for n, o in sums.items()])
    local = grouped.select("*", *[F.coalesce(F.sum(n).over(inside), zero).alias(f"__in_{o}") for n, o in sums.items()])
    joined = local.join(above, [*within, "__group"])
    return joined.select(*sizes.columns, *[(F.col(f"__in_{o}") + F.col(f"__above_{o}")).alias(o) for o in sums.values()])


def with_row_num(
    df: DataFrame, key: str, name: str = "row_num", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Append 0..n-1 in the order of a unique numeric, date, timestamp or string key that every row has (else ValueError).

    Three scans of the key column alone count it and fix the buckets and their sizes; the table itself is
    shuffled once, by bucket. Strings stand in the order of their code points.
    """
    dtype = df.schema[key].dataType
    kind = dtype.typeName()
    if isinstance(dtype, T.StringType):
        return _with_text_num(df, key, name, rows_per_bucket)
    if not isinstance(dtype, T.NumericType) and kind not in ("date", "timestamp"):
        raise TypeError(f"{key} is {kind}; number rows by a numeric, temporal or string key, or use number_sorted")
    order = F.unix_micros(key) if kind == "timestamp" else F.unix_date(key) if kind == "date" else F.col(key)
    slim = df.select(order.cast("double").alias("k"))
    rows, known = slim.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNotNull() & ~F.isnan("k"))).first()
    if rows != known:
        raise ValueError(f"{rows - known} rows have no {key}; rows are numbered by a key that every row has")
    buckets, parts = bucket_count(rows, rows_per_bucket), parts_per_bucket(rows, rows_per_bucket)
    points = split_points(slim, ["k"], buckets, rows)
    place = _divided(F.col("__k"), F.col("__b"), points["k"], parts)
    dealt = lambda d: add_buckets(d, {"__k": points["k"]}, {"__k": "__b"}).withColumn("__bucket", place).drop("__b")
    sizes = dealt(slim.withColumnRenamed("k", "__k")).groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    start = _small(starts(sizes, "__bucket", {"n": "__start"}, max(parts, math.isqrt(buckets * parts))).select("__bucket", "__start"))
    spread = dealt(df.withColumn("__k", order.cast("double")))
    inner = F.row_number().over(W.partitionBy("__bucket").orderBy(key)) - 1
    return (
        spread.withColumn("__place", inner)
        .join(start, "__bucket")
        .withColumn(name, F.col("__place") + F.col("__start"))
        .drop("__bucket", "__place", "__start", "__k")
    )


# Characters of a sampled string that are kept as a border.
BORDER_CHARS = 64


def text_borders(df: DataFrame, column: str, buckets: int, rows: int) -> list[str]:
    """Strictly increasing inner borders from a sample of SAMPLE_PER_BUCKET strings a bucket; they only balance the work."""
    if buckets <= 1:
        return []
    fraction = buckets * SAMPLE_PER_BUCKET / max(rows, 1)
    drawn = df.sample(withReplacement=False, fraction=fraction, seed=buckets) if fraction < 1 else df
    found = sorted(r[0] for r in drawn.select(F.substring(column, 1, BORDER_CHARS)).limit(2 * buckets * SAMPLE_PER_BUCKET).collect())
    step = max(1, len(found) // buckets)
    return sorted(set(found[step::step]))


def text_bucket(value: Column, borders: Sequence[str]) -> Column:
    """How many borders are at or below a string, by binary search in built-in expressions."""
    if not borders:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(list(borders))), "array<string>")  # one folded literal, not a node per border
    low, high = F.lit(0).alias("low"), F.lit(len(borders)).alias("high")

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.get(table, middle) <= value
        open_ = s["low"] < s["high"]
        return F.struct(
            F.when(open_ & above, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~above, middle).otherwise(s["high"]).alias("high")
        )

    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))
    return F.aggregate(steps, F.struct(low, high), halved, lambda s: s["low"])


def _with_text_num(df: DataFrame, key: str, name: str, rows_per_bucket: int) -> DataFrame:
    slim = df.select(F.col(key).alias("k"))
    rows, known = slim.agg(F.count(F.lit(1)), F.count("k")).first()
    if rows != known:
        raise ValueError(f"{rows - known} rows have no {key}; rows are numbered by a key that every row has")
    buckets = bucket_count(rows, rows_per_bucket)
    borders = text_borders(slim, "k", buckets, rows)
    sizes = slim.groupBy(text_bucket(F.col("k"), borders).alias("__bucket")).agg(F.count(F.lit(1)).alias("n"))
    start = _small(starts(sizes, "__bucket", {"n": "__start"}, math.isqrt(buckets) + 1).select("__bucket", "__start"))
    spread = df.withColumn("__bucket", text_bucket(F.col(key), borders))
    inner = F.row_number().over(W.partitionBy("__bucket").orderBy(key)) - 1
    return (
        spread.withColumn("__place", inner)
        .join(start, "__bucket")
        .withColumn(name, F.col("__place") + F.col("__start"))
        .drop("__bucket", "__place", "__start")
    )


# A table of starts up to this size is sent to every task; a larger one is joined by a shuffle.
SENT_STARTS = 20_000


def _small(start: DataFrame) -> DataFrame:
    """The starts, computed once and kept in shared storage, marked for broadcast if few enough."""
    start = checkpointed(start)
    return F.broadcast(start) if start.count() <= SENT_STARTS else start


# Files whose starts are summed up in one task.
FILES_PER_GROUP = 4_096


def read_numbered(spark, path: str, name: str = "row_num", format: str = "parquet", schema=None, **options) -> DataFrame:
    """A Parquet or CSV table with 0..n-1 in file order: the row's place in its file plus the rows of earlier files.

    No row or file list reaches the driver, and the table is not shuffled for the join with its file starts
    unless that table is large. Parquet rows know their place in the file. For CSV, rows of a file keep the
    order of their blocks: places come from monotonically increasing ids, which follow the blocks of a file as they are read.
    """
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if format == "parquet":
        tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.lit(0).cast("bigint").alias("__block"), F.col("_metadata.row_index").alias("__index"))
        files = df.select(F.col("_metadata.file_path").alias("__file"), F.lit(0).cast("bigint").alias("__block"))
    else:
        block = F.col("_metadata.file_block_start").alias("__block")
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), block, F.monotonically_increasing_id().alias("__id"))
        placed = checkpointed(placed)
        first = placed.groupBy("__file", "__block").agg(F.min("__id").alias("__first"))
        tagged = placed.join(first, ["__file", "__block"]).withColumn("__index", F.col("__id") - F.col("__first")).drop("__id", "__first")
        files = placed.select("__file", "__block")
    counts = files.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"))
    ordered = number_sorted(counts, [F.col("__file"), F.col("__block")], "__place")
    start = _small(starts(ordered, "__place", {"n": "__start"}, FILES_PER_GROUP).select("__file", "__block", "__start"))
    return (
        tagged.join(start, ["__file", "__block"])
        .withColumn(name, F.col("__index") + F.col("__start"))
        .drop("__file", "__block", "__index", "__start")
    )


def number_sorted(df: DataFrame, order: Sequence[Column], name: str = "row_num") -> DataFrame:
    """Append 0..n-1 in any sort order, strings included.

    A range sort is checkpointed so that partition numbers and positions stay what they were,
    then each partition's start is added. Meant for distinct-value tables rather than raw rows:
    equal sort keys share a partition.
    """
    at = F.monotonically_increasing_id()  # partition number above bit 33, position below
    placed = checkpointed(df.orderBy(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # one row per partition
    starts, total = [], 0
    for r in sorted(sizes):
        starts.append((r["p"], total))
        total += r["n"]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "__p bigint, __start bigint"))
    return (
        placed.withColumn("__p", part)
        .join(start, "__p")
        .withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start"))
        .drop("__at", "__p", "__start")
    )
