import math

import pytest
from pyspark.sql import functions as F

from featureflow.config import LOG_EPS, Config
from featureflow.functions import rules


def values(spark, xs, expression):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_state_cut_is_inclusive_and_keeps_nulls(spark):
    got = values(spark, [-1.645, 1.645, 1.6449, -3, 0, None], rules.state)
    assert got == [-1.0, 1.0, 0.0, -1.0, 0.0, None]


def test_interaction_is_zero_wherever_state_is_not(spark):
    got = values(spark, [-2, -1, 0.5, 1.7, None], lambda z: rules.state_interaction(rules.state(z), z * 10))
    assert got == [0.0, -10.0, 5.0, 0.0, None]


def test_binarize_leaves_non_positive_values(spark):
    assert values(spark, [-2, 0, 3, None], rules.binarize) == [-2.0, 0.0, 1.0, None]


def test_replace_rare(spark):
    assert values(spark, [1, 2, 9], lambda x: rules.replace_rare(x, [2, 9], 5.5)) == [1.0, 5.5, 5.5]
    assert values(spark, [1, 2], lambda x: rules.replace_rare(x, [], None)) == [1.0, 2.0]


def test_shift_log_of_the_minimum(spark):
    got = values(spark, [3, 4], lambda x: rules.shift_log(x, 3.0))
    assert got == [pytest.approx(math.log(LOG_EPS)), 0.0]


def test_zscore_of_a_constant_is_null(spark):
    assert values(spark, [1], lambda x: rules.zscore(x, 1.0, 0.0)) == [None]


@pytest.mark.parametrize(
    "x, more",
    [
        (1, False), (0.1, False), (0.3, False), (2.7, False), (-4.9, False), (12345678.5, False), (1e12 + 0.5, False),
        (0.25, True), (0.30000000000000004, True), (1e-7, True), (-1.01, True), (123456.78, True),
    ],
)
def test_one_decimal(spark, x, more):
    assert values(spark, [x], rules.more_than_one_decimal) == [more]


def test_one_decimal_agrees_with_decimal_rounding_everywhere(spark):
    df = spark.range(0, 300000).select((F.col("id") / F.lit(100.0) - 1000).alias("x"))
    differing = df.filter(rules.more_than_one_decimal(F.col("x")) != (F.col("x") != F.round("x", 1)))
    assert differing.count() == 0


def test_balance_of_all_zeros_is_null(spark):
    zeros = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert zeros.agg(rules.balance_ratio(F.col("x"))).first()[0] is None
    mixed = spark.createDataFrame([(0.0,), (0.0,), (-1.0,), (2.0,)], "x double")
    assert mixed.agg(rules.balance_ratio(F.col("x"))).first()[0] == 1.5


def test_nan_reads_as_missing(spark):
    assert values(spark, [float("nan"), 1], rules.as_number) == [None, 1.0]


def test_run_names():
    assert Config().run_name() == "lr_0.75_10.0_False_False_False_10.0_0.01"
    assert Config(model="gbt", gbt_depth=10, gbt_learn_rate=0.025).run_name().endswith("_10.0_0.025")
