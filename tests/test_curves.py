"""Density curves, smoother, grid of log shifts and text row numbers on hand-made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.config import LOG_EPS, Config
from featureflow.operators.derive import derive
from featureflow.operators.profile import Profile, profile_stacked
from featureflow.operators.ranks import text_bucket, with_row_num
from featureflow.operators.summaries import kernel_density, smooth_rate


def test_kernel_density_is_a_density(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(3, 2, 2000)
    rows = [("train" if i % 3 else "test", float(v)) for i, v in enumerate(values)] + [("train", None), ("test", float("nan"))]
    got = kernel_density(spark.createDataFrame(rows, "name string, v double"), "v").toPandas()
    for name, n in (("train", 1333), ("test", 667), ("combined", 2000)):
        curve = got[got.name == name].sort_values("point")
        assert len(curve) == 128 and abs(np.trapezoid(curve.density, curve.x) - 1) < 0.01
        here = values if name == "combined" else values[[bool(i % 3) == (name == "train") for i in range(2000)]]
        width = 1.06 * here.std(ddof=1) * n**-0.2
        plain = np.exp(-0.5 * ((curve.x.to_numpy()[:, None] - here) / width) ** 2).sum(axis=1) / (n * width * np.sqrt(2 * np.pi))
        assert np.abs(curve.density - plain).max() < 0.01 * plain.max()


def test_kernel_density_of_few_values(spark):
    frame = spark.createDataFrame([("train", 2.0), ("train", 2.0), ("test", None)], "name string, v double")
    got = kernel_density(frame, "v")
    assert {r.name for r in got.collect()} == {"train", "combined"} and got.count() == 256
    assert kernel_density(frame.limit(0), "v").count() == 0


def test_smoother_keeps_a_quadratic(spark):
    x = np.linspace(0, 10, 4000)
    frame = spark.createDataFrame([(float(a), float(3 + 2 * a - 0.1 * a * a)) for a in x] + [(None, 1.0), (1.0, None)], "x double, y double")
    got = smooth_rate(frame, "x", "y").collect()
    assert len(got) == 32 and all(abs(r.rate - (3 + 2 * r.x - 0.1 * r.x**2)) < 1e-6 for r in got)
    flat = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "x double, y double")
    assert {r.rate for r in smooth_rate(flat, "x", "y").collect()} == {0.5}
    assert smooth_rate(frame.limit(0), "x", "y").count() == 0


def test_a_better_shift_is_chosen_stored_and_applied(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("train" if i % 4 else "test", float(v)) for i, v in enumerate(np.exp(rng.normal(0, 1.5, 800)) + 5.123)]
    frame = spark.createDataFrame(rows, "name string, v double")
    plain, tried = profile_stacked(frame, ["v"])["v"], profile_stacked(frame, ["v"], Config(log_shifts=(0.05, 50.0)))
    assert plain.log_eps == LOG_EPS and plain.choice == "normal"
    assert tried["v"].log_eps == 0.05 and tried["v"].choice == "log-normal" and tried["v"].w_log > plain.w_log
    tried.write(spark, str(tmp_path / "p"))
    assert Profile.read(spark, str(tmp_path / "p"))["v"].log_eps == 0.05
    out = derive(frame, tried, F.col("name"), ["v", "name"]).filter("name = 'train'").collect()
    low = min(v for n, v in rows if n == "train")
    assert all(r[3] == 0.0 or abs(r[3] - np.log(r.v - low + 0.05)) < 1e-9 for r in out)


@pytest.mark.parametrize("per_bucket", [10_000_000, 7])
def test_text_row_numbers(spark, per_bucket):
    rng = np.random.default_rng(1)
    names = sorted({"".join(chr(c) for c in rng.choice([0x41, 0x5A, 0x61, 0xE9, 0x4E2D, 0x1F600, 0x22, 0x5C], rng.integers(0, 5))) for _ in range(600)})
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, place long").repartition(5)
    assert with_row_num(frame, "n", rows_per_bucket=per_bucket).filter("place != row_num").isEmpty()
    assert "Window" in with_row_num(frame, "n", rows_per_bucket=per_bucket)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        with_row_num(frame.withColumn("n", F.when(F.col("place") > 3, F.col("n"))), "n")


def test_text_bucket_is_a_binary_search(spark):
    borders = ["b", "ba", "c", 'q"\\', "é"]
    rows = [("",), ("a",), ("b",), ("b\x00",), ("ba",), ("bz",), ("c",), ('q"\\',), ("z",), ("é",), ("ü",)]
    got = spark.createDataFrame(rows, "s string").select("s", text_bucket(F.col("s"), borders).alias("b")).collect()
    assert [r.b for r in got] == [sum(x <= r.s for x in borders) for r in got]
