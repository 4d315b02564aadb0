"""The whole run: profile, derive, assemble, validate, compare with the champion, refit and score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators.champion import champion_gate
from ..operators.derive import derive
from ..operators.encode import Assembled, assemble
from ..operators.evaluate import split_summary
from ..operators.models import refit, score, validate
from ..operators.profile import Profile, profile
from ..sources.champion import champion_version, read_champion, write_champion
from ..sources.tables import prediction_frame, publish, write_predictions
from ..sources.versions import VersionConflict
from .scorer import Scorer


@dataclass(frozen=True)
class Run:
    """Everything a run leaves behind; predictions and scorer only when the run became champion."""

    profile: Profile
    assembled: Assembled
    metrics: DataFrame
    decision: DataFrame
    predictions: DataFrame | None
    scorer: Scorer | None = None


def build_features(
    train: DataFrame,
    test: DataFrame,
    key: str,
    label: str,
    columns: Sequence[str],
    config: Config = Config(),
    register: bool = False,
) -> tuple[Profile, Assembled]:
    """Profile both tables, derive the used columns and assemble them into vectors."""
    found = profile(train, test, columns, config)
    names = [n for p in found.columns for n in p.outputs()]
    categories = [n for p in found.columns if p.kind in ("cat", "trunc_cat") for n in p.outputs()]
    train_out = derive(train, found, "train", [key, label], config)
    test_out = derive(test, found, "test", [key], config)
    assembled = assemble(train_out, test_out, key, label, names, categories, config)
    if register:
        publish(train_out, "train")
        publish(test_out, "test")
        publish(assembled.train, "model_train")
        publish(assembled.test, "model_test")
    return found, assembled


def summarise(metrics: DataFrame, config: Config) -> DataFrame:
    """The one-row metrics record of a run: mroc, sdroc, name."""
    return split_summary(metrics).select("mroc", "sdroc", F.lit(config.run_name()).alias("name"))


def _judged(spark, record: DataFrame, champion_path: str) -> tuple[DataFrame, bool, int]:
    """(gate row, accepted, version it was judged against)."""
    version = champion_version(spark, champion_path)
    gate = champion_gate(read_champion(spark, champion_path, version), record).first()
    decision = spark.createDataFrame([tuple(gate)], "name string, mroc double, sdroc double, best_mroc double, accepted boolean")
    return decision, gate["accepted"], version


def _chosen(assembled: Assembled, config: Config, champion_path: str, predictions_path: str | None) -> tuple[DataFrame, DataFrame, DataFrame | None, Model | None]:
    metrics = validate(assembled.train, config)
    record = summarise(metrics, config)
    decision, accepted, version = _judged(metrics.sparkSession, record, champion_path)
    if not accepted:
        return metrics, decision, None, None
    model = refit(assembled.train, config)
    scored = score(model, assembled.test)
    while True:
        try:
            write_champion(record, champion_path, version)
            break
        except VersionConflict:  # another run was recorded meanwhile: the gate is asked again
            decision, accepted, version = _judged(metrics.sparkSession, record, champion_path)
            if not accepted:
                return metrics, decision, None, None
    if predictions_path is not None:
        write_predictions(scored, config.run_name(), predictions_path)
    return metrics, decision, prediction_frame(scored, config.run_name()), model


def choose_model(
    assembled: Assembled, config: Config, champion_path: str, predictions_path: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(split metrics, gate row, predictions): refit on all of train and score test if the run wins.

    The champion is recorded after the fit and against the version the gate has seen: a run that fails on the way leaves
    the earlier one in place, and of two runs at once the later is judged against the earlier.
    """
    return _chosen(assembled, config, champion_path, predictions_path)[:3]


def run(
    train: DataFrame,
    test: DataFrame,
    key: str,
    label: str,
    columns: Sequence[str],
    champion_path: str,
    predictions_path: str | None = None,
    config: Config = Config(),
    artefact_path: str | None = None,
) -> Run:
    """Run everything on a labelled and an unlabelled table; the winner's scorer is stored under `artefact_path` if that is given."""
    found, assembled = build_features(train, test, key, label, columns, config)
    metrics, decision, predictions, model = _chosen(assembled, config, champion_path, predictions_path)
    scorer = None if model is None else Scorer(found, assembled.encoding, model, key, config)
    if scorer is not None and artefact_path is not None:
        scorer.write(train.sparkSession, artefact_path)
    return Run(found, assembled, metrics, decision, predictions, scorer)
