"""Deterministic splits and folds decided by a row's key alone.

The same key always lands on the same side, whatever the partitioning, so a
recomputed task after a lost executor cannot move rows between train and hold-out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = 100


def _digest(key: Column, seed: int) -> Column:
    """First 32 bits of md5("seed:key") as a number."""
    digest = F.md5(F.concat(F.lit(f"{int(seed)}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def key_slot(key: Column, seed: int, parts: int = PARTS) -> Column:
    """Slot 0..parts-1 of a key; null for a null key."""
    return F.pmod(_digest(key, seed), F.lit(parts))


def in_sample(key: Column, seed: int, fraction: float = 0.75) -> Column:
    """True for the sampled share of keys, any fraction between 0 and 1; a null key is never sampled.

    Whole percents are decided by the slot alone; what is left of a fraction falls on the borderline
    slot and is decided by the rest of the digest.
    """
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1, got {fraction}")
    percent = round(fraction * PARTS, 9)
    whole = int(percent)
    slot = key_slot(key, seed)
    chosen = slot < whole
    if percent > whole:
        finer = F.floor(_digest(key, seed) / PARTS) < F.lit((percent - whole) * 2**32 / PARTS)
        chosen = chosen | ((slot == whole) & finer)
    return F.coalesce(chosen, F.lit(False))


def split_name(key: Column, seed: int, fraction: float = 0.75) -> Column:
    """'train' for sampled keys, 'test' for the others and for null keys."""
    return F.when(in_sample(key, seed, fraction), F.lit("train")).otherwise(F.lit("test"))


def fold(key: Column, folds: int, seed: int) -> Column:
    """Fold number 0..folds-1, independent of the train/hold-out split of the same seed; 0 for a null key."""
    return F.coalesce(key_slot(key, seed + 1_000_003, folds), F.lit(0)).cast("int")


def membership(key: Column, seeds: Sequence[int], fraction: float = 0.75, folds: int = 0, fold_seed: int = 0) -> Column:
    """All that is decided about a key as one number: bit i tells whether the sample of seed i holds it, its fold stands above.

    Stored once, it turns every later split and fold into a bit test (`sampled`, `fold_number`).
    """
    bits = [F.when(in_sample(key, s, fraction), F.lit(1 << i).cast("bigint")).otherwise(0) for i, s in enumerate(seeds)]
    if folds:
        bits.append(F.shiftleft(fold(key, folds, fold_seed).cast("bigint"), len(seeds)))
    whole = F.lit(0).cast("bigint")
    for b in bits:
        whole = whole.bitwiseOR(b)
    return whole


def sampled(member: Column, i: int) -> Column:
    """Whether the sample of the i-th seed holds the row."""
    return F.shiftright(member, i).bitwiseAND(F.lit(1)) == 1


def fold_number(member: Column, seeds: int) -> Column:
    """The fold stored above the bits of so many seeds."""
    return F.shiftright(member, seeds).cast("int")
