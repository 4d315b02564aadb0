"""The physical plans keep what makes them fit for large tables."""

import re

import pytest
from pyspark.sql import functions as F

from featureflow.operators.categories import category_ratios
from featureflow.operators.evaluate import confusion, split_metrics
from featureflow.operators.moments import column_moments
from featureflow.operators.profile import profile
from featureflow.operators.ranks import ordered_counts, read_numbered, value_counts, with_row_num
from featureflow.operators.shapiro import shapiro_wilk
from featureflow.operators.split import keyed_split

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> set[str]:
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",")}


def everything():
    return {"all": F.lit(True)}


def test_counts_read_their_columns_and_combine_before_the_shuffle(lines):
    text = plan(value_counts(lines, ["l_tax", "l_discount"], everything()))
    assert read_columns(text) == {"l_tax", "l_discount"}
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


@pytest.mark.parametrize("rows_per_bucket", [10**6, 1000])
def test_ordered_counts_never_use_one_task_for_all(lines, rows_per_bucket):
    text = plan(ordered_counts(lines, ["l_tax"], everything(), 6000, rows_per_bucket))
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_statistic_has_no_global_window(lines):
    text = plan(shapiro_wilk(lines, ["l_tax", "l_extendedprice"]))
    assert read_columns(text) == {"l_tax", "l_extendedprice"}
    assert "SinglePartition" not in text and "NestedLoop" not in text


def test_generated_code_is_small_enough_to_compile_to_machine_code(spark, lines):
    df = shapiro_wilk(lines, ["l_tax", "l_extendedprice"])
    df.collect()
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_row_numbers_shuffle_the_table_once(lines, spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(with_row_num(orders, "o_orderkey", rows_per_bucket=300))
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text
    assert "Exchange hashpartitioning" not in plan(read_numbered(spark, f"{FOLDER}/orders.parquet"))


def test_metrics_of_all_splits_are_one_scan(lines):
    scored = lines.select(F.col("l_orderkey").alias("id"), F.lit(1.0).alias("label"), F.lit(0.0).alias("prediction"))
    text = plan(split_metrics(scored, "id", (1, 2, 3)))
    assert text.count("FileScan") == 1 and "partial_" in text
    assert plan(confusion(scored)).count("FileScan") == 1


def test_split_sides_are_filters(lines):
    for side in keyed_split(lines, "l_orderkey", 1):
        text = plan(side)
        assert "Exchange" not in text and "Join" not in text


def test_ratios_broadcast_one_row_per_column_only(lines):
    text = plan(category_ratios(lines, ["l_quantity"], {"train": F.lit(True)}))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_wide_tables_are_profiled_in_blocks(spark, monkeypatch, lines):
    from featureflow.operators import moments, profile as module, ranks

    small = lambda columns, size=2: [columns[i : i + 2] for i in range(0, len(columns), 2)]
    columns = ["l_tax", "l_quantity", "l_discount", "l_linenumber", "l_extendedprice"]
    whole = profile(lines, lines, columns)
    for m in (moments, module, ranks):
        monkeypatch.setattr(m, "blocks", small)
    parts = profile(lines, lines, columns)
    for a, b in zip(whole.columns, parts.columns):
        assert (a.column_name, a.kind, a.choice, a.rare) == (b.column_name, b.kind, b.choice, b.rare)
        assert a.max_abs_z == pytest.approx(b.max_abs_z)
    flags = {"all": F.lit(True)}
    assert column_moments(lines, columns, flags)["l_tax", "all"].n == lines.count()
