"""Derived columns as one projection built from a profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.rules import as_number, binarize, replace_rare, shift_log, state, state_interaction, zscore
from .joins import lookup
from .profile import ColumnProfile, Profile


def _per_role(p: ColumnProfile, stat: str, role: str | Column) -> Column:
    """A statistic of the row's own table."""
    train, test = (F.lit(getattr(p, f"{stat}_{r}")).cast("double") for r in ("train", "test"))
    if isinstance(role, str):
        return train if role == "train" else test
    return F.when(role == "train", train).otherwise(test)


def transformed(p: ColumnProfile, role: str | Column, config: Config = Config()) -> Column:
    """The raw or shift-logged value, as the profile chose."""
    x = as_number(F.col(p.column_name))
    eps = config.log_eps if p.log_eps is None else p.log_eps
    return x if p.choice == "normal" else shift_log(x, _per_role(p, "low", role), eps)


def derived_columns(p: ColumnProfile, role: str | Column, config: Config = Config()) -> list[Column]:
    """The used columns of one profiled column; `role` is 'train', 'test' or a column holding these."""
    x = as_number(F.col(p.column_name))
    names = p.outputs()
    if p.kind == "binarized":
        return [binarize(x).alias(names[0])]
    if p.kind == "trunc_cat":
        return [replace_rare(x, p.rare, p.replacement).alias(names[0])]
    if p.kind == "cat":
        return [x.alias(names[0])]
    value = transformed(p, role, config)
    if p.kind in ("N", "LN"):
        return [value.alias(names[0])]
    sd = _per_role(p, "sd", role)
    # a side that does not vary has no deviation to divide by: its values are the mean
    still = (F.coalesce(sd, F.lit(0.0)) == 0.0) & value.isNotNull()
    z = F.when(still, F.lit(0.0)).otherwise(zscore(value, _per_role(p, "mean", role), sd))
    s = state(z, config.z_cut)
    return [s.alias(names[0]), state_interaction(s, value).alias(names[1])]


def derive(
    df: DataFrame,
    profile: Profile,
    role: str | Column,
    keep: Sequence[str] = (),
    config: Config = Config(),
) -> DataFrame:
    """(keep..., derived...) in one narrow projection, whatever the number of columns.

    Columns whose rare-value lists were too long for the profile are marked by joins with the stored lists,
    by broadcast if the bytes of all lists allow.
    """
    long_lists = [p for p in profile.columns if p.long_list()]
    if long_lists:
        if profile.rare is None:
            names = ", ".join(p.column_name for p in long_lists)
            raise ValueError(f"the rare values of {names} are not in the profile; store it with write and read it with read")
        df = _mark_rare(df, long_lists, profile.rare)
    out = []
    for p in profile.columns:
        if p in long_lists:
            x = as_number(F.col(p.column_name))
            out.append(F.when(F.col(f"__rare_{p.column_name}"), F.lit(p.replacement)).otherwise(x).alias(p.outputs()[0]))
        else:
            out += derived_columns(p, role, config)
    return df.select(*keep, *out)


# A row of the rare table takes some tens of bytes in a task's hash table.
RARE_ROW_BYTES = 64
RARE_BYTES = 32 << 20


def _mark_rare(df: DataFrame, columns: Sequence[ColumnProfile], rare: DataFrame) -> DataFrame:
    """Append `__rare_{c}` for several columns.

    Lists that fit into memory together are broadcast; larger ones are joined by shuffles that keep hot
    values apart. Either way the lists are read from shared storage, never counted again.
    """
    names = [p.column_name for p in columns]
    if rare.count() * RARE_ROW_BYTES <= RARE_BYTES:
        for c in names:
            table = rare.filter(F.col("column_name") == c).select(F.col("value").alias("__value"), F.lit(True).alias(f"__rare_{c}"))
            df = df.join(F.broadcast(table), as_number(F.col(c)) == F.col("__value"), "left").drop("__value")
        return df
    for c in names:
        table = rare.filter(F.col("column_name") == c).select(F.col("value").alias("__value"), F.lit(True).alias(f"__rare_{c}"))
        df = lookup(df.withColumn("__value", as_number(F.col(c))), "__value", table).drop("__value")
    return df
