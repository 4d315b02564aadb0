import numpy as np
import pytest

from featureflow.config import REG_PARAMS, Config
from featureflow.operators.champion import champion_gate
from featureflow.operators.encode import Assembled, assemble
from featureflow.operators.evaluate import area_under_roc
from featureflow.operators.models import fit, logistic_grid, refit, score, validate
from featureflow.plans.workflow import build_features, choose_model, run
from featureflow.sources.champion import SCHEMA, read_champion, write_champion


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=400).round(3), rng.integers(0, 3, 400)
    y = (x + 0.4 * rng.normal(size=400) > 0).astype(float)
    rows = [(i, float(y[i]), float(x[i]), float(z[i])) for i in range(400)]
    train = spark.createDataFrame(rows, "k bigint, y double, x double, z double")
    return train, train.select((train.k + 1000).alias("k"), "x", "z")


@pytest.fixture(scope="module")
def assembled(data) -> Assembled:
    return assemble(*data, "k", "y", ["x", "z"])


@pytest.mark.parametrize("name", ["lr", "svm", "gbt"])
def test_family(assembled, name):
    config = Config(model=name, nfolds=2, num_splits=2, gbt_max_iter=2, gbt_depth=2, reg_params=(0.02, 0.5), partitions=1)
    metrics = validate(assembled.train, config).collect()
    assert [r["seed"] for r in metrics] == [1, 2]
    assert all(r["precision"] > 0.7 and 0 < r["n"] < 200 for r in metrics)
    scored = score(refit(assembled.train, config), assembled.test).collect()
    assert sorted(r["id"] for r in scored) == list(range(1000, 1400))
    assert {r["prediction"] for r in scored} == {0.0, 1.0}


def test_logistic_separates(spark, assembled):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    model = fit(assembled.train, Config(nfolds=2, reg_params=(0.02, 0.5)))
    probability = model.transform(assembled.train).select("label", vector_to_array("probability")[1].alias("p"))
    assert area_under_roc(probability, "p", "label").first()["auc"] > 0.9
    assert np.isfinite(model.bestModel.stages[0].coefficients.toArray()).all()


def test_grid_and_unknown_family(assembled):
    assert len(logistic_grid(Config()).getEstimatorParamMaps()) == len(REG_PARAMS) == 14
    with pytest.raises(ValueError):
        fit(assembled.train, Config(model="forest"))
    with pytest.raises(ValueError):
        validate(assembled.train, Config(model="forest"))


def test_gbt_settings_are_applied(assembled):
    model = fit(assembled.train, Config(model="gbt", gbt_depth=2, gbt_learn_rate=0.3, gbt_max_iter=2))
    assert model.getNumTrees == 2 and max(t.depth for t in model.trees) <= 2


def gate(spark, best, new):
    rows = lambda v: [] if v is None else [(v, 1.0, "m")]
    new_row = spark.createDataFrame([(new, 1.0, "new")], SCHEMA)
    return champion_gate(spark.createDataFrame(rows(best), SCHEMA), new_row).first()["accepted"]


def test_gate(spark):
    assert gate(spark, None, 1.0) is True
    assert gate(spark, 2.001, 2.004) is True
    assert gate(spark, 2.004, 2.001) is True
    assert gate(spark, 2.01, 2.0) is False
    assert gate(spark, 2.0, None) is False


def test_record_keeps_the_last_line(spark, tmp_path):
    path = tmp_path / "record.csv"
    assert read_champion(spark, str(path)).count() == 0
    path.write_text("mroc,sdroc,name\n1.5,0.1,a\n2.5,0.2,b\n")
    assert tuple(read_champion(spark, str(path)).first()) == (2.5, 0.2, "b")
    folder = str(tmp_path / "folder")
    write_champion(read_champion(spark, str(path)), folder)
    write_champion(read_champion(spark, folder), folder)
    assert tuple(read_champion(spark, folder).first()) == (2.5, 0.2, "b")


def test_whole_run(spark, data, tmp_path):
    train, test = data
    config = Config(model="gbt", num_splits=2, gbt_max_iter=2, gbt_depth=2, cat_transform=True)
    champion, predictions = str(tmp_path / "champion"), str(tmp_path / "predictions")
    first = run(train, test, "k", "y", ["x", "z"], champion, predictions, config)
    assert first.decision.first()["accepted"] and first.predictions.count() == 400
    written = spark.read.parquet(predictions)
    assert written.columns == ["model_name", "id", "prediction"] and written.count() == 400
    assert read_champion(spark, champion).first()["name"] == config.run_name()
    better = spark.createDataFrame([(1e9, 0.0, "unbeatable")], SCHEMA)
    write_champion(better, champion)
    _, decision, nothing = choose_model(first.assembled, config, champion)
    assert not decision.first()["accepted"] and nothing is None
    assert read_champion(spark, champion).first()["name"] == "unbeatable"


def test_views(spark, data):
    build_features(*data, "k", "y", ["x", "z"], register=True)
    assert spark.sql("SELECT count(*) FROM model_train WHERE label = 1").first()[0] > 0
    assert spark.sql("SELECT x_state, z_cat FROM train").count() == 400
    assert spark.table("model_test").columns == ["id", "features"]
