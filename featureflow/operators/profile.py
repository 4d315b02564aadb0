"""Profile of a train and a test table: which derivation each column gets, and the numbers it needs.

Three passes decide everything: one aggregate for moments of all columns, one count of category
values for the categorical columns, one ordered pass for the continuous ones. The result is a few
numbers per column; no rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from .categories import CategoryStats, category_stats
from ..sources.storage import checkpointed
from .moments import Moments, column_moments
from .ranks import ROWS_PER_BUCKET, blocks
from .shapiro import shapiro_from_moments

POPULATIONS = {"train": ["train"], "test": ["test"], "combined": ["train", "test"]}
# Two-valued columns have the same W raw and logged; differences below this are rounding.
W_TIE = 1e-9

KINDS = ("binarized", "trunc_cat", "cat", "N", "LN", "state")


@dataclass(frozen=True)
class ColumnProfile:
    """The decision for one column. Moments are those of the transformed values, per table."""

    column_name: str
    kind: str
    choice: str | None = None
    choice_train: str | None = None
    choice_test: str | None = None
    choice_combined: str | None = None
    w_raw: float | None = None
    w_log: float | None = None
    max_abs_z: float | None = None
    balance: float | None = None
    n_distinct: int | None = None
    n_rare: int | None = None
    n_test_only: int | None = None
    replacement: float | None = None
    rare: tuple[float, ...] = ()
    low_train: float | None = None
    low_test: float | None = None
    mean_train: float | None = None
    mean_test: float | None = None
    sd_train: float | None = None
    sd_test: float | None = None
    log_eps: float | None = None

    def long_list(self) -> bool:
        """Whether the rare values stand in the profile's table rather than here."""
        return self.kind == "trunc_cat" and self.n_rare != len(self.rare)

    def outputs(self) -> list[str]:
        """Names of the derived columns that are used."""
        suffixes = ["state", "st_inter"] if self.kind == "state" else [self.kind]
        return [f"{self.column_name}_{s}" for s in suffixes]

    def reference_only(self) -> list[str]:
        """Names of the columns that are only looked at, never used."""
        if self.kind == "binarized":
            return [f"{self.column_name}_categorical"]
        if self.kind == "trunc_cat":
            return [f"{self.column_name}_cat"]
        return [self.column_name] if self.kind == "state" else []

    def mismatches(self) -> list[tuple[str, str]]:
        """(kind, detail) of every disagreement between train and test."""
        out = []
        if self.n_test_only:
            out.append(("category", f"test only: {self.n_test_only}"))
        if self.choice_train != self.choice_test:
            out.append(("transform", f"train: {self.choice_train}, test: {self.choice_test}"))
        for side, sd, other in (("train", self.sd_train, self.sd_test), ("test", self.sd_test, self.sd_train)):
            if not sd and other:
                out.append(("constant", f"{side} does not vary"))
        return out


PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("choice", "choice_train", "choice_test", "choice_combined")],
        *[T.StructField(c, T.DoubleType()) for c in ("w_raw", "w_log", "max_abs_z", "balance")],
        *[T.StructField(c, T.LongType()) for c in ("n_distinct", "n_rare", "n_test_only")],
        T.StructField("replacement", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.DoubleType())),
        *[
            T.StructField(f"{s}_{p}", T.DoubleType())
            for s in ("low", "mean", "sd")
            for p in ("train", "test")
        ],
        T.StructField("log_eps", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Profile:
    """Profiles of all columns, plus the distributed table of long rare-value lists."""

    columns: tuple[ColumnProfile, ...]
    rare: DataFrame | None = None

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(p for p in self.columns if p.column_name == name)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per column, ready to be stored and applied to new data later."""
        rows = [tuple(list(v) if isinstance(v, tuple) else v for v in asdict(p).values()) for p in self.columns]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        """Store the whole profile, long rare-value lists included, as two Parquet tables under a folder."""
        self.to_frame(spark).write.mode("overwrite").parquet(f"{path}/columns")
        rare = self.rare if self.rare is not None else spark.createDataFrame([], "column_name string, value double")
        rare.write.mode("overwrite").parquet(f"{path}/rare")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Profile:
        """A profile stored by `write`, ready to derive new data."""
        return Profile.from_frame(spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/rare"))

    @staticmethod
    def from_frame(df: DataFrame, rare: DataFrame | None = None) -> Profile:
        """Read a stored profile back; it has one row per column."""
        rows = [r.asDict() for r in df.collect()]
        return Profile(tuple(ColumnProfile(**(r | {"rare": tuple(r["rare"] or ())})) for r in rows), rare)

    def report(self, spark: SparkSession) -> DataFrame:
        """(column_name, kind, detail) of every mismatch between the tables."""
        rows = [(p.column_name, kind, detail) for p in self.columns for kind, detail in p.mismatches()]
        return spark.createDataFrame(rows, "column_name string, kind string, detail string")

    def usage(self, spark: SparkSession) -> DataFrame:
        """(column_name, derived_name, used): every derived column and whether it enters the features."""
        rows = [
            (p.column_name, name, used)
            for p in self.columns
            for names, used in ((p.outputs(), True), (p.reference_only(), False))
            for name in names
        ]
        return spark.createDataFrame(rows, "column_name string, derived_name string, used boolean")


def normal_or_log(w_raw: float | None, w_log: float | None) -> str:
    """The shape with the larger W; ties and undefined statistics go to log-normal."""
    if w_raw is None:
        return "log-normal"
    return "normal" if w_log is None or w_raw > w_log + W_TIE else "log-normal"


def stacked(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, columns...): train on top of test, scanned once each."""
    return train.select(F.lit("train").alias("name"), *columns).unionByName(
        test.select(F.lit("test").alias("name"), *columns)
    )


def profile(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    config: Config = Config(),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> Profile:
    """Profile the columns of two tables that share them."""
    return profile_stacked(stacked(train, test, columns), columns, config, rows_per_bucket)


def profile_stacked(
    df: DataFrame, columns: Sequence[str], config: Config = Config(), rows_per_bucket: int = ROWS_PER_BUCKET
) -> Profile:
    """Profile one table whose `name` column says train or test."""
    flags = {"train": F.col("name") == "train", "test": F.col("name") == "test"}
    moments = column_moments(df, columns, flags)
    categorical = [c for c in columns if moments[c, "train"].categorical]
    continuous = [c for c in columns if c not in categorical]
    # Wide tables are taken in blocks of columns; a columnar scan reads each column once either way.
    stats: dict[str, CategoryStats] = {}
    rare: list[DataFrame] = []
    for block in blocks(categorical):
        found, values = category_stats(df, block, flags, config.category_trunc_threshold, config.inline_rare)
        stats |= found
        rare.append(values)
    shapes = {}
    for block in blocks(continuous):
        found = shapiro_from_moments(df, block, flags, moments, POPULATIONS, (config.log_eps, *config.log_shifts), rows_per_bucket)
        rows = found.collect()  # three rows a column and shift
        kept = {c: _best_shift([r for r in rows if r["column_name"] == c], config) for c in block}
        shapes |= {(r["column_name"], r["population"]): r for r in rows if r["eps"] == kept[r["column_name"]]}
    decided = {c: _categorical(c, moments, stats.get(c), config) for c in categorical}
    decided |= {c: _continuous(c, moments, shapes, config) for c in continuous}
    found = tuple(decided[c] for c in columns)
    long_lists = [p.column_name for p in found if p.long_list()]
    if not long_lists:
        return Profile(found)
    # Counted once and kept in shared storage, so that deriving never goes back to the raw tables.
    values = reduce(DataFrame.unionByName, rare).filter(F.col("column_name").isin(long_lists))
    return Profile(found, checkpointed(values))


def _categorical(c: str, moments: dict, stats: CategoryStats | None, config: Config) -> ColumnProfile:
    m: Moments = moments[c, "train"]
    base = ColumnProfile(c, "cat", balance=m.balance)
    if stats is None:
        return base
    base = replace(base, n_distinct=stats.n_distinct, n_rare=stats.n_rare, n_test_only=stats.n_test_only)
    if m.balance is not None and m.balance > config.unbalanced_threshold:
        return replace(base, kind="binarized")
    if stats.n_rare:
        return replace(base, kind="trunc_cat", replacement=stats.replacement, rare=stats.rare)
    return base


def _best_shift(rows: list, config: Config) -> float:
    """The shift with the largest W of the log in train, the first of several."""
    w = {r["eps"]: r["w_log"] for r in rows if r["population"] == "train" and r["w_log"] is not None}
    shifts = [float(e) for e in (config.log_eps, *config.log_shifts)]
    return max(shifts, key=lambda e: (w.get(e, -1.0), -shifts.index(e)))


def _continuous(c: str, moments: dict, shapes: dict, config: Config) -> ColumnProfile:
    w = {p: shapes.get((c, p)) for p in POPULATIONS}
    eps = next((r["eps"] for r in w.values() if r), config.log_eps)
    choices = {
        p: normal_or_log(r["w_raw"] if r else None, r["w_log"] if r else None) for p, r in w.items()
    }
    agreed = choices["train"] if choices["train"] == choices["test"] else choices["combined"]
    sides = {}
    for p in ("train", "test"):
        m: Moments = moments[c, p]
        if agreed == "normal":
            sides[p] = m
        elif w[p] is None:
            sides[p] = _few_logs(m, eps)
        else:
            # The shifted log is monotone, so its extremes come from those of the raw values.
            sides[p] = replace(m, mean=w[p]["log_mean"], sd=w[p]["log_sd"])
    train = sides["train"]
    top = _max_abs_z(train, agreed, w["train"] is not None, eps)
    kind = "state" if top is not None and top > config.z_cut else "N" if agreed == "normal" else "LN"
    return ColumnProfile(
        c,
        kind,
        choice=agreed,
        choice_train=choices["train"],
        choice_test=choices["test"],
        choice_combined=choices["combined"],
        w_raw=w["train"]["w_raw"] if w["train"] else None,
        w_log=w["train"]["w_log"] if w["train"] else None,
        max_abs_z=top,
        low_train=moments[c, "train"].low,
        low_test=moments[c, "test"].low,
        mean_train=train.mean,
        mean_test=sides["test"].mean,
        sd_train=train.sd,
        sd_test=sides["test"].sd,
        log_eps=eps,
    )


def _few_logs(m: Moments, eps: float) -> Moments:
    """Moments of the shifted log where W is undefined: one value, equal values or two; their extremes say all."""
    if not m.n:
        return m
    low, high = math.log(eps), math.log(m.high - m.low + eps)
    if m.low == m.high:
        return replace(m, mean=low, sd=0.0)
    return replace(m, mean=(low + high) / 2, sd=abs(high - low) / math.sqrt(2))


def _max_abs_z(m: Moments, choice: str, defined: bool, eps: float) -> float | None:
    if not m.sd or not defined:
        return None
    low, high = (m.low, m.high) if choice == "normal" else (math.log(eps), math.log(m.high - m.low + eps))
    return max(high - m.mean, m.mean - low) / m.sd
