"""Versions that are there or not, the champion record on them, and the stored scorer."""

import pytest
from pyspark.sql import functions as F

from featureflow.config import Config
from featureflow.operators.encode import CategoryIndexer, Encoding, assemble, fit_category_index
from featureflow.operators.models import refit
from featureflow.operators.profile import profile
from featureflow.plans import workflow
from featureflow.plans.scorer import Scorer
from featureflow.sources.champion import SCHEMA, champion_version, read_champion, write_champion
from featureflow.sources.versions import VersionConflict, Versions


def record(spark, mroc, name):
    return spark.createDataFrame([(mroc, 0.5, name)], SCHEMA)


def test_versions_are_appended(spark, tmp_path):
    path = str(tmp_path / "record")
    assert champion_version(spark, path) == 0 and read_champion(spark, path).count() == 0
    assert write_champion(record(spark, 1.0, "a"), path) == 1
    assert write_champion(record(spark, 2.0, "b"), path) == 2
    assert read_champion(spark, path).first()["name"] == "b" and read_champion(spark, path, 1).first()["name"] == "a"


def test_a_run_that_stops_before_the_commit_leaves_the_record(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "record")
    write_champion(record(spark, 1.0, "a"), path)

    def stop(self, name, after):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", stop)
        with pytest.raises(KeyboardInterrupt):
            write_champion(record(spark, 2.0, "b"), path)
    assert champion_version(spark, path) == 1 and read_champion(spark, path).first()["name"] == "a"
    assert write_champion(record(spark, 3.0, "c"), path) == 2 and read_champion(spark, path).first()["name"] == "c"


def test_of_two_runs_one_is_told(spark, tmp_path):
    path = str(tmp_path / "record")
    write_champion(record(spark, 1.0, "a"), path, 0)
    with pytest.raises(VersionConflict):
        write_champion(record(spark, 9.0, "late"), path, 0)
    assert read_champion(spark, path).first()["name"] == "a"
    versions = Versions(spark, path)
    versions.latest = lambda: 0  # both looked before either renamed
    with pytest.raises(VersionConflict):
        versions.commit(versions.reserve(), 0)
    assert Versions(spark, path).latest() == 1


def test_a_plain_file_is_the_version_before_the_first(spark, tmp_path):
    path = tmp_path / "folder"
    path.mkdir()
    (path / "part.csv").write_text("mroc,sdroc,name\n1.5,0.1,a\n2.5,0.2,b\n")
    assert read_champion(spark, str(path)).first()["name"] == "b"
    assert write_champion(record(spark, 3.0, "c"), str(path)) == 1 and read_champion(spark, str(path)).first()["name"] == "c"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, float(i * 7919 % 10 < 3 + 4 * (i % 3 == 0)), i / 7 + 0.013 * (i % 5), f"c{i % 4}", float(i % 3)) for i in range(300)]
    train = spark.createDataFrame(rows, "k bigint, y double, x double, s string, c double")
    return train, train.select((train.k + 1000).alias("k"), "x", "s", "c")


def test_the_gate_is_asked_again_after_a_conflict(spark, tables, tmp_path, monkeypatch):
    made = assemble(*tables, "k", "y", ["x", "c"])
    config, path = Config(nfolds=2, num_splits=2, reg_params=(0.1,)), str(tmp_path / "record")
    once = [record(spark, 1e9, "other")]
    real = workflow.refit

    def slow(train, config):
        if once:
            write_champion(once.pop(), path)  # another run wins while this one fits
        return real(train, config)

    monkeypatch.setattr(workflow, "refit", slow)
    _, decision, predictions = workflow.choose_model(made, config, path)
    assert not decision.first()["accepted"] and predictions is None
    assert read_champion(spark, path).first()["name"] == "other" and champion_version(spark, path) == 1


@pytest.mark.parametrize("most", [100_000, 0])
def test_indexer_and_encoding_files(spark, tables, tmp_path, most):
    train, _ = tables
    fitted = fit_category_index(train, ["s"], "keep", most)
    fitted.write(spark, str(tmp_path / "i"))
    later = train.withColumn("s", F.when(F.col("k") % 5 == 0, "new").when(F.col("k") % 7 != 0, F.col("s")))
    again = CategoryIndexer.read(spark, str(tmp_path / "i"))
    rows = lambda found: sorted((r.k, r.s_Index) for r in found.transform(later).collect())
    assert rows(again) == rows(fitted) and again.sizes == fitted.sizes


@pytest.mark.parametrize("settings", [{}, {"cat_transform": True}, {"cat_transform": True, "scale_data": True, "keep_raw_categories": True}])
def test_scorer_files(spark, tables, tmp_path, settings):
    train, test = tables
    config = Config(model="gbt", gbt_max_iter=2, gbt_depth=2, **settings)
    found, made = workflow.build_features(train, test, "k", "y", ["x", "c"], config)
    scorer = Scorer(found, made.encoding, refit(made.train, config), "k", config)
    path = str(tmp_path / "scorer")
    with pytest.raises(FileNotFoundError):
        Scorer.read(spark, path)
    assert scorer.write(spark, path) == 1 and scorer.write(spark, path) == 2
    again = Scorer.read(spark, path)
    told = lambda rows: sorted((r.id, str(r.features), r.prediction) for r in rows.collect())
    assert told(again.score(test)) == told(scorer.model.transform(made.test))
    assert again.config == config and isinstance(again.encoding, Encoding)
    assert profile(train, test, ["x"], config)["x"] == again.profile["x"]
