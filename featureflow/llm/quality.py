"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was are this by an at or not from "
    "le la les de des du un une et en est que qui dans pour pas sur au avec ce il "
    "der die das und ist von zu den mit nicht ein eine auf dem im es auch sich "
    "el los las del y que se por con para no una su al lo como"
).split()


class Rule(NamedTuple):
    """A document passes when `measure` is null or within [least, most]; a missing bound is open."""

    name: str
    measure: str
    least: float | None
    most: float | None


# Published ranges for web text, widened to 20 words below, and without a largest length.
RULES = (
    Rule("words", "n_words", 20, None),
    Rule("repeated_words", "try_divide(100 * n_repeat_words, n_words)", None, 30),
    Rule("word_length", "try_divide(word_chars, n_words)", 2, 14),
    Rule("symbols", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", 0.02, None),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", None, 0.3),
    Rule("bullet_lines", "try_divide(n_bullet_lines, n_lines)", None, 0.9),
    Rule("open_lines", "try_divide(n_open_lines, n_lines)", None, 0.3),
)


def _lines(df: DataFrame, text: str) -> DataFrame:
    lines = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    return lines.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("__lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long"),
            "n_open_lines": F.size(F.filter("__lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
        }
    ).drop("__lines")


def _words(df: DataFrame, text: str) -> DataFrame:
    words = df.withColumn("__words", F.array_remove(F.split(text, WORD_GAP), ""))
    return words.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        }
    )


def _doubled(array: Column, n: int) -> Column:
    return F.transform(array, lambda x, i: F.xxhash64(x, F.get(array, i + n)))


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words under an 8-word window that occurs twice or more.

    Windows are 64-bit hashes, doubled in length three times. Only a text in which two windows agree has
    them sorted; the covered words are then the union of its repeated windows. Each array stands in a
    column of its own, so that no lambda computes it anew for each element. A filter on the result would be pushed
    below and repeat the expressions of all arrays for each use; adding zero by task number, which is not deterministic,
    holds it above.
    """
    held = F.when(F.spark_partition_id() < 0, 1).otherwise(0)
    windows = df.withColumn("__1", F.transform("__words", lambda w: F.xxhash64(w)))
    for half in (1, 2, 4):
        windows = windows.withColumn(f"__{2 * half}", _doubled(F.col(f"__{half}"), half))
    return (
        windows.withColumn("__w", F.slice("__8", 1, F.greatest(F.size("__8") - (WINDOW - 1), F.lit(0))))
        .withColumn("__some", F.size(F.array_distinct("__w")) < F.size("__w"))
        .withColumn("__s", F.when(F.col("__some"), F.sort_array(F.transform("__w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .withColumn(
            "__at",
            F.sort_array(
                F.transform(
                    F.filter(
                        "__s",
                        lambda p, k: F.coalesce(p["h"] == F.get("__s", k - 1)["h"], F.lit(False))
                        | F.coalesce(p["h"] == F.get("__s", k + 1)["h"], F.lit(False)),
                    ),
                    lambda p: p["i"],
                )
            ),
        )
        .withColumn("__new", F.transform("__at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", k + 1) - x, F.lit(WINDOW)))))
        .withColumn("n_repeat_words", (F.coalesce(F.aggregate("__new", F.lit(0), lambda a, x: a + x), F.lit(0)) + held).cast("long"))
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the measures of a text column; null counts as empty. Columns of those names are replaced."""
    full = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    inner = [c for c in ("__text", "__words", "__1", "__2", "__4", "__8", "__w", "__some", "__s", "__at", "__new")]
    return _repeats(_words(_lines(full, "__text"), "__text")).drop(*inner)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a measured row breaks, in the order of the table."""
    broken = []
    for rule in rules:
        value = F.expr(f"({rule.measure})")
        outside = F.lit(False)
        if rule.least is not None:
            outside = outside | (value < rule.least)
        if rule.most is not None:
            outside = outside | (value > rule.most)
        broken.append(F.when(outside, F.lit(rule.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def assess(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append the measures, base_failed, kept and failed_rules to every row.

    One projection per row: no shuffle, no user function, whatever the keys are. base_failed: fewer than
    20 words, or more than 30 of 100 words in repeated 8-word windows. kept: false if base_failed or if a
    rule is broken. A ratio over zero words or lines is null and passes; such texts fail the base. Null
    text counts as empty. Repeated rows are assessed alike; an empty table stays empty. Input columns
    named like an output are replaced, all others are kept.
    """
    rows = measured(docs, text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        rows.withColumn("base_failed", base)
        .withColumn("failed_rules", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    judged = assess(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__body")), "__body", rules)
    return judged.where("kept").select("__row.*")
