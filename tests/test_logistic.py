"""Shared passes against pyspark.ml at its optimum, area under ROC of many columns, stored membership."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featureflow.config import Config
from featureflow.functions.keyed import fold, fold_number, in_sample, membership, sampled
from featureflow.operators import logistic
from featureflow.operators.evaluate import area_under_roc, areas_under_roc
from featureflow.operators.models import fit, validate

STRENGTHS = (0.0, 0.02, 0.5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3)) * [1, 40, 0.01] + [5, -300, 0]
    y = (x[:, 0] - 5 + x[:, 1] / 30 + 10 + rng.logistic(size=3000) > 0).astype(float)
    data = [(i, float(y[i]), *map(float, x[i]), 7.0) for i in range(3000)]
    frame = spark.createDataFrame(data, "id bigint, label double, a double, b double, c double, d double").repartition(5)
    vectors = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(frame).select("id", "label", "features")
    return vectors.withColumn("member", membership(F.col("id"), [1, 2], 0.75, 3, 9)).cache()


def test_coefficients_equal_the_optimum(rows):
    trained = [logistic.Trained(1, 2), logistic.Trained(0, None), logistic.Trained(None, 0)]
    models = [(k, s) for k in range(3) for s in STRENGTHS]
    got = logistic.fit_many(logistic.slim(rows), 4, trained, models, 2)
    for k, (number, strength) in enumerate(models):
        split, left_out = trained[number]
        part = rows if split is None else rows.filter(sampled(F.col("member"), split))
        part = part if left_out is None else part.filter(fold_number(F.col("member"), 2) != left_out)
        want = LogisticRegression(regParam=strength, tol=1e-14, maxIter=1000).fit(part)
        assert np.allclose(got.coefficients[k], want.coefficients.toArray(), rtol=1e-6, atol=1e-6)
        assert abs(got.intercepts[k] - want.intercept) < 1e-6 * max(1, abs(want.intercept)) and got.coefficients[k][3] == 0


def test_one_label_no_rows_and_separable_rows(spark, rows):
    trained = [logistic.Trained(None, None)]
    ones = logistic.slim(rows.withColumn("label", F.lit(1.0)))
    got = logistic.fit_many(ones, 4, trained, [(0, 0.1)], 2)
    assert got.intercepts[0] == np.inf and not got.coefficients.any()
    apart = logistic.slim(rows.withColumn("label", (F.col("id") >= 1500).cast("double")).drop("features").join(
        VectorAssembler(inputCols=["id"], outputCol="features").transform(rows.select("id")), "id"))
    got = logistic.fit_many(apart, 1, trained, [(0, 0.0), (0, 0.1)], 2)
    assert np.isfinite(got.coefficients).all() and (got.coefficients > 0).all()
    none = logistic.fit_many(logistic.slim(rows).filter("member < 0"), 4, trained, [(0, 0.1)], 2, about=logistic.Standard(np.zeros(4), np.ones(4), np.zeros(1), np.zeros(1), np.zeros((1, 4))))
    assert none.intercepts[0] == 0 and not none.coefficients.any()


def test_areas_of_many_columns(spark):
    rng = np.random.default_rng(1)
    data = [(float(rng.integers(0, 2)), int(rng.integers(0, 3)), float(rng.integers(0, 40)), float(rng.normal())) for _ in range(2000)]
    frame = spark.createDataFrame([*data, (0.0, 1, None, float("nan")), (None, 1, 1.0, 1.0), (2.0, 0, 1.0, 1.0)], "y double, part int, s double, t double").repartition(4)
    for buckets in (2_000_000, 150):
        got = {(r.item, r.part): (r.auc, r.positives, r.negatives) for r in areas_under_roc(frame, ["s", "t"], "y", "part", buckets).collect()}
        assert len(got) == 6
        for (item, part), (auc, positives, negatives) in got.items():
            want = area_under_roc(frame.filter(F.col("part") == part), "st"[item], "y").first()
            assert abs(auc - want.auc) < 1e-12 and (positives, negatives) == (want.positives, want.negatives)
    assert areas_under_roc(frame, ["s"], "y").first().positives == sum(y for y, *_ in data)


def test_membership_keeps_the_splits(spark):
    ids = spark.range(3000).select(F.when(F.col("id") > 5, F.col("id")).alias("id"))
    bits = ids.withColumn("m", membership(F.col("id"), [3, 4, 5], 0.705, 7, 11))
    for i, seed in enumerate((3, 4, 5)):
        assert bits.filter(sampled(F.col("m"), i) != in_sample(F.col("id"), seed, 0.705)).isEmpty()
    assert bits.filter(fold_number(F.col("m"), 3) != fold(F.col("id"), 7, 11)).isEmpty()


def test_choice_of_strength_and_model_files(spark, rows, tmp_path):
    config = Config(nfolds=3, reg_params=STRENGTHS, num_splits=2)
    model = fit(rows.drop("member"), config)
    assert len(model.avgMetrics) == 3 and all(0.5 < a <= 1 for a in model.avgMetrics)
    best = int(np.argmax(model.avgMetrics))
    want = LogisticRegression(regParam=STRENGTHS[best], tol=1e-14, maxIter=1000).fit(rows)
    stage = model.bestModel.stages[0]
    assert np.allclose(stage.coefficients.toArray(), want.coefficients.toArray(), rtol=1e-6)
    stage.write().overwrite().save(str(tmp_path / "m"))
    again = LogisticRegressionModel.load(str(tmp_path / "m"))
    same = again.transform(rows).join(want.transform(rows).select("id", F.col("prediction").alias("p")), "id")
    assert same.filter("prediction != p").isEmpty()
    assert [r.seed for r in validate(rows.drop("member"), config).collect()] == [1, 2]


def test_plan_has_no_digest_after_the_table_is_held(rows):
    plan = rows.filter(sampled(F.col("member"), 1))._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan.split("InMemoryRelation")[0]


def test_models_of_samples_and_folds_start_at_the_common_optimum(rows, monkeypatch):
    """A pass of every model is what grows with rows and models: few are left, and the results are those of a cold start."""
    passes, plain = [], logistic._stepper
    monkeypatch.setattr(logistic, "_stepper", lambda *a: passes.append(len(a[-1])) or plain(*a))
    slim = logistic.slim(rows)
    final, means = logistic.cross_validated(slim, 4, [0, 1], 2, 3, STRENGTHS)
    assert sum(n for n in passes if n > len(STRENGTHS)) <= 4 * 18
    for k, split in enumerate((0, 1)):
        best = STRENGTHS[int(np.argmax(means[k]))]
        cold = logistic.fit_many(slim, 4, [logistic.Trained(split, None)], [(0, best)], 2)
        assert np.allclose(final.coefficients[k], cold.coefficients[0], rtol=1e-7, atol=1e-9)
        assert abs(final.intercepts[k] - cold.intercepts[0]) < 1e-7 * max(1, abs(cold.intercepts[0]))


def test_areas_shuffle_arrays_and_not_rows(spark):
    frame = spark.range(4000).select((F.col("id") % 2).cast("double").alias("y"), F.col("id").cast("double").alias("s"), F.lit(None).cast("string").alias("k"))
    frame = frame.repartition(2).cache()
    out = areas_under_roc(frame, ["s", "s"], "y", "k", 500)
    assert {(r.item, r.k, r.positives, r.negatives) for r in out.collect()} == {(0, None, 2000, 2000), (1, None, 2000, 2000)}
    assert all(abs(r.auc - (2000 * 2001 / 2) / 2000**2) < 1e-12 for r in out.collect())
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "value" not in text
