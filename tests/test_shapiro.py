from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.config import LOG_EPS
from featureflow.functions.normal import LAST_WEIGHT, NEXT_WEIGHT, score_constants
from featureflow.operators.shapiro import shapiro_wilk


def brute_w(x):
    """The statistic from its definition, every rank spelled out."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = m @ m, n**-0.5
    if n == 3:
        a = np.array([-np.sqrt(0.5), 0, np.sqrt(0.5)])
    else:
        last = m[-1] / np.sqrt(mm) + sum(c * u ** (k + 1) for k, c in enumerate(LAST_WEIGHT))
        nxt = m[-2] / np.sqrt(mm) + sum(c * u ** (k + 1) for k, c in enumerate(NEXT_WEIGHT))
        ends = 1 if n <= 5 else 2
        phi = (mm - 2 * sum(m[-1 - k] ** 2 for k in range(ends))) / (1 - 2 * sum(v * v for v in (last, nxt)[:ends]))
        a = m / np.sqrt(phi)
        a[-1], a[0] = last, -last
        if ends == 2:
            a[-2], a[1] = nxt, -nxt
    d = x - x.mean()
    return (a @ x) ** 2 / (d @ d)


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))


def test_known_answer(spark):
    df = frame(spark, x=[148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert shapiro_wilk(df, ["x"]).first()["w_raw"] == pytest.approx(0.78881469, abs=1e-8)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 12, 64, 65, 66, 67, 400])
def test_equals_the_definition(spark, n):
    rng = np.random.default_rng(n)
    tied, smooth = rng.normal(size=n).round(1), rng.exponential(size=n)
    got = {r["column_name"]: r for r in shapiro_wilk(frame(spark, tied=tied, smooth=smooth), ["tied", "smooth"]).collect()}
    for name, x in (("tied", tied), ("smooth", smooth)):
        logged = np.log(x - x.min() + LOG_EPS)
        assert got[name]["w_raw"] == pytest.approx(brute_w(x), abs=1e-9)
        assert got[name]["w_log"] == pytest.approx(brute_w(logged), abs=1e-9)
        assert got[name]["log_mean"] == pytest.approx(logged.mean())
        assert got[name]["log_sd"] == pytest.approx(logged.std(ddof=1))


def test_a_hot_value_and_many_buckets_change_nothing(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(3000), rng.normal(size=6000)])
    rng.shuffle(x)
    df = frame(spark, x=x)
    few = shapiro_wilk(df, ["x"]).first()
    many = shapiro_wilk(df, ["x"], rows_per_bucket=200).first()
    assert few["w_raw"] == pytest.approx(brute_w(x), abs=1e-9)
    assert many["w_raw"] == pytest.approx(few["w_raw"], abs=1e-12)
    assert many["w_log"] == pytest.approx(few["w_log"], abs=1e-12)


def test_invariant_to_shift_and_scale(spark):
    x = np.random.default_rng(2).gamma(2.0, size=300)
    df = frame(spark, x=x).select("x", (F.lit(7.0) + 3 * F.col("x")).alias("y"))
    a, b = (r["w_raw"] for r in shapiro_wilk(df, ["x", "y"]).collect())
    assert a == pytest.approx(b) and 0 < a <= 1


def test_undefined_columns_give_no_row(spark):
    df = frame(spark, constant=[1, 1, 1, 1], x=[1, 2, 3, 4])
    assert [r["column_name"] for r in shapiro_wilk(df, ["constant", "x"]).collect()] == ["x"]
    assert shapiro_wilk(frame(spark, x=[1, 2]), ["x"]).count() == 0


@pytest.mark.parametrize("n", [66, 1000, 20001])
def test_squared_weights_sum_to_one(n):
    c = score_constants(n)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a = m * c["inv_root"]
    a[[0, -1]], a[[1, -2]] = c["a_last"], c["a_next"]
    assert a @ a == pytest.approx(1.0, abs=1e-10)
