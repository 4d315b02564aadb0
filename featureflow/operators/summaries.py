"""The tables behind the plots: histograms, densities and class rates per train, test and combined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_number


def _bin(x: Column, low: float, width: float, bins: int) -> Column:
    """Fixed-width bin number; the maximum belongs to the last bin."""
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")


def _range(df: DataFrame, x: Column, distinct: bool) -> dict:
    """Bounds and row counts of a column: one row."""
    aggregates = [F.min(x).alias("low"), F.max(x).alias("high")]
    aggregates += [F.count_if((F.col("name") == p) & x.isNotNull()).alias(p) for p in ("train", "test")]
    row = df.agg(*aggregates).first().asDict()
    if distinct:
        row["distinct"] = df.select(x.alias("x")).filter("x IS NOT NULL").distinct().count()
    return row


def _binned(df: DataFrame, column: str, bins: int | None) -> tuple[DataFrame, dict]:
    x = as_number(F.col(column))
    r = _range(df, x, bins is None)
    bins = bins or max(1, r["distinct"])
    low, high = r["low"] or 0.0, r["high"] or 0.0
    width = (high - low) / bins
    number = _bin(x, low, width, bins).alias("bin")
    parts = df.select("name", number).filter("bin IS NOT NULL").groupBy("bin").agg(
        *[F.count_if(F.col("name") == p).alias(p) for p in ("train", "test")]
    )
    # Combined is the sum of both counts, so no row is read or shuffled twice for it.
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("name"), count.alias("count"))
            for p, count in (
                ("train", F.col("train")),
                ("test", F.col("test")),
                ("combined", F.col("train") + F.col("test")),
            )
        ]
    )
    table = parts.select("bin", F.inline(cells)).filter(F.col("count") > 0)
    totals = {"train": r["train"], "test": r["test"], "combined": r["train"] + r["test"]}
    return table, {"low": low, "width": width, "totals": totals}


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(name, bin, bin_low, count) of a table with a train/test `name`; by default one bin per distinct value."""
    table, info = _binned(df, column, bins)
    return table.select(
        "name", "bin", (F.lit(info["low"]) + F.col("bin") * F.lit(info["width"])).alias("bin_low"), "count"
    )


def density(df: DataFrame, column: str, bins: int = 64) -> DataFrame:
    """(name, bin, bin_low, density): share of the rows per unit of the column."""
    table, info = _binned(df, column, bins)
    n = info["totals"]
    total = (
        F.when(F.col("name") == "train", F.lit(n["train"]))
        .when(F.col("name") == "test", F.lit(n["test"]))
        .otherwise(F.lit(n["combined"]))
    )
    return table.select(
        "name",
        "bin",
        (F.lit(info["low"]) + F.col("bin") * F.lit(info["width"])).alias("bin_low"),
        F.try_divide(F.col("count").cast("double"), total * F.lit(info["width"])).alias("density"),
    )


def class_rate(df: DataFrame, column: str, label: str, bins: int = 20) -> DataFrame:
    """(bin, bin_low, count, rate): share of positive labels along a feature."""
    x = as_number(F.col(column))
    r = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    low, width = r["low"] or 0.0, ((r["high"] or 0.0) - (r["low"] or 0.0)) / bins
    return (
        df.select(_bin(x, low, width, bins).alias("bin"), F.col(label).cast("double").alias("y"))
        .filter("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.count("*").alias("count"), F.avg("y").alias("rate"))
        .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_low"), "count", "rate")
    )


GROUPS = ("train", "test", "combined")


def _bandwidth(n: int, sd: float | None) -> float:
    """The normal reference rule from the moments; 1 for values that do not vary."""
    return 1.06 * sd * n**-0.2 if sd else 1.0


def kernel_density(df: DataFrame, column: str, points: int = 128) -> DataFrame:
    """(name, point, x, density): a Gaussian kernel density on a fixed grid, for train, test and combined.

    Values are shared linearly between their two grid points, so what is added up has one row per group and grid
    point; the kernel is then spread over the grid. The bandwidth is 1.06 sd n^(-1/5), and the grid reaches three bandwidths
    beyond the values. A group without values has no rows. Nulls and NaN are left out.
    """
    x = as_number(F.col(column))
    within = {"train": F.col("name") == "train", "test": F.col("name") == "test", "combined": F.col("name").isin("train", "test")}
    stats = {"n": F.count, "sd": F.stddev_samp, "low": F.min, "high": F.max}
    row = df.agg(*[f(F.when(within[g], x)).alias(f"{g}_{k}") for g in GROUPS for k, f in stats.items()]).first()
    known = {}
    for g in GROUPS:
        n, sd, low, high = (row[f"{g}_{k}"] for k in stats)
        if n:
            width = _bandwidth(n, sd)
            start = low - 3 * width
            known[g] = (n, width, start, (high + 3 * width - start) / (points - 1))
    if not known:
        return df.select(F.lit("").alias("name"), F.lit(0).alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    cells = []
    for g, (_, _, start, step) in known.items():
        place = (x - F.lit(start)) / F.lit(step)
        cell = F.least(F.floor(place), F.lit(points - 2)).cast("int")
        for shift, weight in ((0, 1 - (place - cell)), (1, place - cell)):
            cells.append(F.struct(F.when(within[g] & x.isNotNull(), g).alias("name"), (cell + shift).alias("cell"), weight.alias("weight")))
    binned = df.select(F.inline(F.array(*cells))).filter("name IS NOT NULL").groupBy("name", "cell").agg(F.sum("weight").alias("weight"))
    of = lambda k: F.element_at(F.create_map(*[F.lit(v) for g, found in known.items() for v in (g, float(found[k]))]), F.col("name"))
    spread = binned.select("name", "cell", "weight", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    away = (F.col("point") - F.col("cell")) * of(3) / of(1)
    summed = spread.groupBy("name", "point").agg(F.sum(F.col("weight") * F.exp(-0.5 * away * away)).alias("total"))
    return summed.select("name", "point", (of(2) + F.col("point") * of(3)).alias("x"), (F.col("total") / (of(0) * of(1) * math.sqrt(2 * math.pi))).alias("density"))


def smooth_rate(df: DataFrame, column: str, label: str, bins: int = 64, points: int = 32, span: float = 0.5) -> DataFrame:
    """(point, x, rate): the label's local quadratic regression on the feature, at the middles of `points` even parts.

    Rows are added up into moments per cell of the feature's range; a point weighs cells within `span` of the range by
    the tricube of their distance and solves its three normal equations in expressions. Where they are singular (too few
    different values) the rate is the weighted mean. Rows without a feature or label are left out.
    """
    x, y = as_number(F.col(column)), F.col(label).cast("double")
    usable = df.select(F.when(y.isNotNull(), x).alias("x"), y.alias("y")).filter("x IS NOT NULL")
    r = usable.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    low, reach = r["low"] or 0.0, ((r["high"] or 0.0) - (r["low"] or 0.0)) or 1.0
    u = (F.col("x") - F.lit(low)) / F.lit(reach)
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(u, F.lit(float(k)))
    cell = F.least(F.floor(u * bins), F.lit(bins - 1)).cast("int")
    sums = [F.sum(power(k)).alias(f"s{k}") for k in range(5)] + [F.sum(F.col("y") * power(k)).alias(f"t{k}") for k in range(3)]
    cells = usable.groupBy(cell.alias("cell")).agg(*sums)
    each = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    g = (F.col("point") + 0.5) / points
    away = F.abs((F.col("cell") + 0.5) / bins - g) / span
    weight = F.when(away < 1, F.pow(1 - F.pow(away, F.lit(3.0)), F.lit(3.0)))
    names = [f"s{k}" for k in range(5)] + [f"t{k}" for k in range(3)]
    weighed = each.withColumn("w", weight).filter("w IS NOT NULL").groupBy("point").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])

    def about(letter: str, k: int) -> Column:
        """The k-th moment about the point."""
        return sum((math.comb(k, i) * F.col(f"{letter}{i}") * F.pow(-g, F.lit(float(k - i))) for i in range(k + 1)), F.lit(0.0))

    placed = weighed.select("point", *[about("s", k).alias(f"m{k}") for k in range(5)], *[about("t", k).alias(f"v{k}") for k in range(3)])
    m, v = [F.col(f"m{k}") for k in range(5)], [F.col(f"v{k}") for k in range(3)]
    whole = m[0] * (m[2] * m[4] - m[3] * m[3]) - m[1] * (m[1] * m[4] - m[3] * m[2]) + m[2] * (m[1] * m[3] - m[2] * m[2])
    part = v[0] * (m[2] * m[4] - m[3] * m[3]) - m[1] * (v[1] * m[4] - m[3] * v[2]) + m[2] * (v[1] * m[3] - m[2] * v[2])
    solved = F.when(F.abs(whole) > 1e-10 * F.pow(m[0], F.lit(3.0)), part / whole).otherwise(v[0] / m[0])
    return placed.select("point", (F.lit(low) + g * reach).alias("x"), solved.alias("rate"))
