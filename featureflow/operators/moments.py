"""Per-column moments and rule counts: all columns and all parts of a table in one aggregate."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_number, balance_ratio, more_than_one_decimal
from .ranks import blocks


@dataclass(frozen=True)
class Moments:
    """Statistics of one column in one part of the table."""

    n: int
    low: float | None
    high: float | None
    mean: float | None
    sd: float | None
    balance: float | None
    categorical: bool

    def max_abs_z(self) -> float | None:
        """Largest |z|, from the extremes; None for a constant column."""
        if not self.sd:
            return None
        return max(self.high - self.mean, self.mean - self.low) / self.sd


def moment_aggregates(x: Column, prefix: str) -> list[Column]:
    """The aggregate expressions behind one `Moments`."""
    return [
        F.count(x).alias(f"{prefix}n"),
        F.min(x).alias(f"{prefix}low"),
        F.max(x).alias(f"{prefix}high"),
        F.avg(x).alias(f"{prefix}mean"),
        F.stddev_samp(x).alias(f"{prefix}sd"),
        balance_ratio(x).alias(f"{prefix}balance"),
        (~F.coalesce(F.bool_or(more_than_one_decimal(x)), F.lit(False))).alias(f"{prefix}categorical"),
    ]


def column_moments(
    df: DataFrame, columns: Sequence[str], flags: Mapping[str, Column]
) -> dict[tuple[str, str], Moments]:
    """Moments per (column, part). Parts are disjoint; a row in no part is left out.

    Columns are taken in blocks: a columnar scan reads each column once either way, and the
    generated code of one aggregate stays small on wide tables.
    """
    part = F.coalesce(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])
    out: dict[tuple[str, str], Moments] = {}
    fields = list(Moments.__dataclass_fields__)
    for block in blocks(columns):
        slim = df.select(part.alias("part"), *[as_number(F.col(c)).alias(f"v{i}") for i, c in enumerate(block)])
        aggregates = [a for i in range(len(block)) for a in moment_aggregates(F.col(f"v{i}"), f"c{i}_")]
        rows = {r["part"]: r for r in slim.filter("part IS NOT NULL").groupBy("part").agg(*aggregates).collect()}
        for name in flags:
            for i, c in enumerate(block):
                r = rows.get(name)
                out[c, name] = (
                    Moments(**{f: r[f"c{i}_{f}"] for f in fields})
                    if r is not None
                    else Moments(0, None, None, None, None, None, True)
                )
    return out


def combine(parts: Sequence[Moments]) -> Moments:
    """Moments of the union of disjoint parts; balance is not defined for a union and left out."""
    parts = [p for p in parts if p.n]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return Moments(0, None, None, None, None, None, True)
    n = sum(p.n for p in parts)
    mean = math.fsum(p.mean * p.n for p in parts) / n
    ss = math.fsum((p.sd or 0.0) ** 2 * (p.n - 1) + p.n * (p.mean - mean) ** 2 for p in parts)
    return Moments(
        n, min(p.low for p in parts), max(p.high for p in parts), mean,
        math.sqrt(ss / (n - 1)), None, all(p.categorical for p in parts),
    )
