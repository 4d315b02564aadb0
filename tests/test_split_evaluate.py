import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.functions.keyed import fold, in_sample
from featureflow.operators.evaluate import area_under_roc, confusion, split_metrics, split_summary
from featureflow.operators.joins import attach_labels, holdout
from featureflow.operators.split import bernoulli_sample, keyed_split, named_split
from featureflow.operators.summaries import class_rate, density, histogram


def test_keyed_split_of_the_orders(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    sample, rest = keyed_split(orders, "o_orderkey", 1)
    got = sample.agg(F.count("*"), F.sum("o_orderkey")).first()
    assert tuple(got) == (11252, 84148160)
    assert rest.count() == 15000 - 11252
    again = holdout(orders, sample, "o_orderkey")
    assert again.exceptAll(rest).count() == 0 and rest.exceptAll(again).count() == 0


def test_split_ignores_partitioning_and_depends_on_the_seed(spark):
    ids = spark.range(500)
    one = {r["id"] for r in keyed_split(ids, "id", 1)[0].collect()}
    assert one == {r["id"] for r in keyed_split(ids.repartition(7), "id", 1)[0].collect()}
    assert one != {r["id"] for r in keyed_split(ids, "id", 2)[0].collect()}


def test_any_fraction_between_0_and_1(spark):
    rows = spark.range(40000).select(*[in_sample(F.col("id"), 1, x).cast("int").alias(f"f{i}") for i, x in enumerate((0.33, 0.3355, 0.34))])
    sums = rows.agg(*[F.sum(c) for c in rows.columns], F.sum(F.greatest(F.col("f0") - F.col("f1"), F.col("f1") - F.col("f2"))).alias("out")).first()
    assert sums[0] < sums[1] < sums[2] and abs(sums[1] / 40000 - 0.3355) < 0.01 and sums["out"] <= 0
    with pytest.raises(ValueError):
        in_sample(F.col("id"), 1, 1.0)


def test_null_keys_are_held_out_everywhere(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, 1.0, 1.0) for i in range(100)], "id long, label double, prediction double")
    train, test = keyed_split(rows, "id")
    assert train.count() + test.count() == 100 and test.filter("id IS NULL").count() == 10
    assert named_split(rows, "id").filter("id IS NULL AND name = 'test'").count() == 10
    assert split_metrics(rows, "id", [1]).first()["n"] == test.count()


def test_folds_cover_and_are_even(spark):
    sizes = {r["f"]: r["count"] for r in spark.range(3000).groupBy(fold(F.col("id"), 3, 1).alias("f")).count().collect()}
    assert set(sizes) == {0, 1, 2} and min(sizes.values()) > 850


def test_bernoulli_repeats_with_its_seed(spark):
    df = spark.range(0, 2000, 1, 4)
    a, b = (sorted(r["id"] for r in bernoulli_sample(df, 3).collect()) for _ in range(2))
    assert a == b and 1300 < len(a) < 1700


def scored(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label double, prediction double")


def test_confusion(spark):
    df = scored(spark, [(i, float(y), float(p)) for i, (y, p) in enumerate([(1, 1), (1, 1), (0, 1), (0, 0), (1, 0), (0, 0)])])
    r = confusion(df).first()
    assert (r["p"], r["neg"], r["tp"], r["fp"], r["sse"]) == (3, 3, 2, 1, 2.0)
    assert r["tpr"] == r["precision"] == pytest.approx(2 / 3)
    assert r["fpr"] == pytest.approx(1 / 3) and r["roc"] == pytest.approx(2.0)
    assert r["recall"] == pytest.approx(2 / 3) and r["fall_out"] == pytest.approx(1 / 3)


def test_zero_divisors_give_null(spark):
    none = confusion(scored(spark, [(1, 1.0, 0.0), (2, 0.0, 0.0)])).first()
    assert none["tpr"] is None and none["roc"] is None and none["fpr"] == 0.0
    clean = confusion(scored(spark, [(1, 1.0, 1.0), (2, 0.0, 0.0)])).first()
    assert clean["fpr"] == 0.0 and clean["roc"] is None


def test_one_pass_over_all_splits_equals_one_pass_each(spark):
    rng = np.random.default_rng(0)
    df = scored(spark, [(i, float(rng.random() < 0.4), float(rng.random() < 0.5)) for i in range(400)])
    together = split_metrics(df, "id", (1, 2, 3)).orderBy("seed").collect()
    for r in together:
        alone = confusion(keyed_split(df, "id", r["seed"])[1]).first()
        assert tuple(r)[1:] == tuple(alone)
    roc = [r["roc"] for r in together]
    got = split_summary(split_metrics(df, "id", (1, 2, 3))).first()
    assert got["mroc"] == pytest.approx(np.mean(roc)) and got["sdroc"] == pytest.approx(np.std(roc, ddof=1))


@pytest.mark.parametrize("per_bucket", [10**6, 40])
def test_auc_counts_pairs(spark, per_bucket):
    rng = np.random.default_rng(6)
    score, label = rng.integers(0, 60, 300) / 10, (rng.random(300) < 0.3).astype(float)
    df = spark.createDataFrame([(float(s), float(y)) for s, y in zip(score, label)], "s double, y double")
    pos, neg = score[label == 1], score[label == 0]
    want = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))
    assert area_under_roc(df, "s", "y", per_bucket).first()["auc"] == pytest.approx(want)
    one_class = df.withColumn("y", F.lit(1.0))
    assert area_under_roc(one_class, "s", "y").first()["auc"] is None


def test_labels_without_features_stay(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "k bigint, y int")
    features = spark.createDataFrame([(1, 5.0)], "k bigint, x double")
    got = sorted(map(tuple, attach_labels(labels, features, "k", "y", ["x"]).collect()))
    assert got == [(1, 0, 5.0), (2, 1, None)]


def test_histogram_and_density(spark):
    df = named_split(spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("v")), "id")
    rows = histogram(df, "v").collect()
    assert sum(r["count"] for r in rows if r["name"] == "combined") == 200
    assert {r["bin"] for r in rows} == set(range(10))
    per = density(df, "v", 9).collect()
    for name in ("train", "test", "combined"):
        assert math.isclose(sum(r["density"] for r in per if r["name"] == name), 1.0)
    flat = density(df.withColumn("v", F.lit(1.0)), "v", 4).collect()
    assert {r["density"] for r in flat} == {None}


def test_class_rate(spark):
    df = spark.createDataFrame([(i / 10, float(i >= 5)) for i in range(10)], "x double, y double")
    rows = class_rate(df, "x", "y", 2).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [5, 5] and [r["rate"] for r in rows] == [0.0, 1.0]
