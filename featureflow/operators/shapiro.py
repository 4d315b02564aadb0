"""Shapiro-Wilk W of raw and shift-logged values, for many columns and populations in one job.

The shifted log is monotone, so both statistics share one ordering. The distinct values are
ordered once; each contributes its value times the sum of the normal scores of its ranks, which
`functions.normal` gives in constant time however many rows share the value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOG_EPS
from ..functions.normal import score_constants, with_cumulative_scores
from ..functions.rules import shift_log
from .moments import Moments, column_moments, combine
from .ranks import ROWS_PER_BUCKET, ordered_counts

CONSTANTS_SCHEMA = (
    "item int not null, pop string not null, n double not null, mean double not null, low double not null, "
    "high double not null, ss double not null, center double not null, tail array<double> not null, "
    "offset double not null, inv_root double not null, m_last double not null, m_next double not null, "
    "a_last double not null, a_next double not null, eps double not null"
)


def _constants(item: int, pop: str, m: Moments, eps: float) -> tuple | None:
    """What the statistic needs about one population of one column; None where W is undefined."""
    if m.n < 3 or not m.sd:
        return None
    s = score_constants(m.n)
    center = math.log(m.mean - m.low + eps)
    return (
        item, pop, float(m.n), m.mean, m.low, m.high, m.sd**2 * (m.n - 1), center,
        s["tail"], s["offset"], s["inv_root"], s["m_last"], s["m_next"], s["a_last"], s["a_next"], eps,
    )


def _weighted(total: Column, first: Column, second: Column, before: Column, last: Column) -> Column:
    """Sum of a(i) x(i) from the plain score sum and the two extreme values on each side."""
    outer, inner = last - first, before - second
    return (
        F.col("inv_root") * (total - F.col("m_last") * outer - F.col("m_next") * inner)
        + F.col("a_last") * outer
        + F.col("a_next") * inner
    )


def shapiro_from_moments(
    df: DataFrame,
    columns: Sequence[str],
    flags: Mapping[str, Column],
    moments: Mapping[tuple[str, str], Moments],
    populations: Mapping[str, Sequence[str]],
    eps: float | Sequence[float] = LOG_EPS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(column_name, population, n, w_raw, w_log, log_mean, log_sd, eps), a row for each eps.

    The logs of all shifts have the order of the raw values, so any number of them is judged in one ordered pass.

    `flags` mark disjoint parts of df; each population is a union of parts, so the combined
    population needs no second copy of the rows. Undefined columns (fewer than three values, or a
    constant) give no row.
    """
    spark = df.sparkSession
    stats = {(c, p): combine([moments[c, part] for part in parts]) for c in columns for p, parts in populations.items()}
    shifts = [eps] if isinstance(eps, float | int) else list(eps)
    known = [_constants(i, p, stats[c, p], float(e)) for i, c in enumerate(columns) for p in populations for e in shifts]
    constants = spark.createDataFrame([k for k in known if k], CONSTANTS_SCHEMA)
    rows = max((sum(moments[c, f].n for f in flags) for c in columns), default=0)
    ordered = ordered_counts(df, columns, flags, rows, rows_per_bucket)
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("pop"),
                sum((F.col(f"n_{x}") for x in parts[1:]), F.col(f"n_{parts[0]}")).cast("double").alias("k"),
                sum((F.col(f"upto_{x}") for x in parts[1:]), F.col(f"upto_{parts[0]}")).cast("double").alias("hi"),
            )
            for p, parts in populations.items()
        ]
    )
    # One constants row per column and population: its size follows the schema, not the data.
    zero = F.lit(0.0)
    ranked = (
        ordered.select("item", "value", F.inline(cells))
        .filter("k > 0")
        .select("item", "pop", "value", F.coalesce("k", zero).alias("k"), F.coalesce("hi", zero).alias("hi"))
        .join(F.broadcast(constants), ["item", "pop"])
        .withColumn("lo", F.col("hi") - F.col("k"))
    )
    n = F.col("n")
    scored = with_cumulative_scores(ranked, {"to_hi": "hi", "to_lo": "lo"}).select(
        "*",
        (F.col("to_hi") - F.col("to_lo")).alias("weight"),
        (F.col("value") - F.col("mean")).alias("x"),
        (shift_log(F.col("value"), F.col("low"), F.col("eps")) - F.col("center")).alias("log"),
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") < rank) & (F.col("hi") >= rank), F.col("value")))

    k = F.col("k")
    carried = ["n", "low", "high", "ss", "center", "inv_root", "m_last", "m_next", "a_last", "a_next"]
    sums = scored.groupBy("item", "pop", "eps").agg(
        F.sum(F.col("weight") * F.col("x")).alias("mx"),
        F.sum(F.col("weight") * F.col("log")).alias("ml"),
        F.sum(k * F.col("log")).alias("l1"),
        F.sum(k * F.col("log") * F.col("log")).alias("l2"),
        at_rank(F.lit(2.0)).alias("second"),
        at_rank(n - 1).alias("before"),
        *[F.first(c).alias(c) for c in carried],
    )
    log = {v: shift_log(F.col(v), F.col("low"), F.col("eps")) for v in ("low", "second", "before", "high")}
    raw_top = _weighted(F.col("mx"), F.col("low"), F.col("second"), F.col("before"), F.col("high"))
    log_top = _weighted(F.col("ml"), log["low"], log["second"], log["before"], log["high"])
    log_ss = F.col("l2") - F.col("l1") * F.col("l1") / n
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("item") + 1)
    return sums.select(
        names.alias("column_name"),
        F.col("pop").alias("population"),
        n.cast("bigint").alias("n"),
        F.least(F.lit(1.0), raw_top * raw_top / F.col("ss")).alias("w_raw"),
        F.least(F.lit(1.0), F.try_divide(log_top * log_top, log_ss)).alias("w_log"),
        (F.col("center") + F.col("l1") / n).alias("log_mean"),
        F.sqrt(log_ss / (n - 1)).alias("log_sd"),
        "eps",
    )


def shapiro_wilk(
    df: DataFrame, columns: Sequence[str], eps: float = LOG_EPS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """W of every column over the whole table; see `shapiro_from_moments` for the output."""
    everything = {"all": F.lit(True)}
    return shapiro_from_moments(
        df, columns, everything, column_moments(df, columns, everything), {"all": ["all"]}, eps, rows_per_bucket
    )
