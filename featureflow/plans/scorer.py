"""A run's profile, encoding and model as one stored artefact that scores later tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.ml import Model, PipelineModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.derive import derive
from ..operators.encode import Encoding, read_settings, write_settings
from ..operators.profile import Profile
from ..sources.versions import Versions


@dataclass(frozen=True)
class Scorer:
    """Everything needed to score rows that neither train nor test held."""

    profile: Profile
    encoding: Encoding
    model: Model
    key: str
    config: Config = Config()

    def features(self, table: DataFrame, role: str = "test") -> DataFrame:
        """(id, features): derived with the stored statistics of a role, encoded and scaled as fitted."""
        derived = derive(table, self.profile, role, [self.key], self.config)
        return self.encoding.transform(derived).select(F.col(self.key).alias("id"), "features")

    def score(self, table: DataFrame, role: str = "test") -> DataFrame:
        """(id, features, ..., prediction) of a later table, which needs the profiled columns and the key alone."""
        return self.model.transform(self.features(table, role))

    def write(self, spark: SparkSession, path: str, after: int | None = None) -> int:
        """Store all parts as the next version of a folder and return its number; nothing is there before it is committed."""
        versions = Versions(spark, path)
        after = versions.latest() if after is None else after
        name = versions.reserve()
        where = versions.data_path(name)
        self.profile.write(spark, f"{where}/profile")
        self.encoding.write(spark, f"{where}/encoding")
        model = self.model.bestModel if isinstance(self.model, CrossValidatorModel) else self.model
        model = model if isinstance(model, PipelineModel) else PipelineModel([model])
        model.write().overwrite().save(f"{where}/model")
        write_settings(spark, f"{where}/settings", {"key": self.key, "config": asdict(self.config)})
        return versions.commit(name, after)

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> Scorer:
        """The artefact of a version, by default the last."""
        versions = Versions(spark, path)
        version = versions.latest() if version is None else version
        if not version:
            raise FileNotFoundError(f"{path} holds no committed artefact")
        where = versions.open(version)
        told = read_settings(spark, f"{where}/settings")
        known = {f.name for f in fields(Config)}
        config = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in told["config"].items() if k in known})
        return Scorer(Profile.read(spark, f"{where}/profile"), Encoding.read(spark, f"{where}/encoding"), PipelineModel.load(f"{where}/model"), told["key"], config)
