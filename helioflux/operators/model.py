"""Boosted trees with class weights and a calibration on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Forecaster:
    """Trees and the monotone map from their probability to observed frequency; ``predict`` adds p in (0, 1)."""

    trees: PipelineModel
    calibration: object | None = None

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], label: str = "y", rounds: int = 20, depth: int = 4, seed: int = 7) -> Forecaster:
        """Positives weigh as much as negatives in all; the counts are one aggregation."""
        n = df.agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n")).first()
        heavy = (n["n"] - n["pos"]) / n["pos"] if n["pos"] else 1.0
        d = df.withColumn("_w", F.when(F.col(label) == 1, float(heavy)).otherwise(1.0)).withColumn("label", F.col(label).cast("double"))
        make = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="keep")
        model = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed).fit(make.transform(d))
        return cls(PipelineModel([make, model]))

    def _raw(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(df).withColumn("_p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    def calibrate(self, df: DataFrame, label: str = "y", method: str = "isotonic") -> Forecaster:
        """Learn the map from the trees' probability to observed frequency: any monotone one, or a ``sigmoid`` of it."""
        d = self._raw(df).select(F.col(label).cast("double").alias("label"), F.col("_p"))
        if method == "isotonic":
            self.calibration = IsotonicRegression(labelCol="label", featuresCol="_p").fit(d)
        elif method == "sigmoid":
            self.calibration = LogisticRegression(featuresCol="_v", labelCol="label").fit(_vector(d))
        else:
            raise ValueError("method must be isotonic or sigmoid")
        return self

    def save(self, path: str) -> None:
        """Both parts under ``path``, a folder that every executor can reach; what is there is replaced."""
        self.trees.write().overwrite().save(f"{path}/trees")
        if self.calibration is not None:
            self.calibration.write().overwrite().save(f"{path}/calibration")

    @classmethod
    def load(cls, path: str, calibrated: bool | str = True) -> Forecaster:
        """What ``save`` has written; ``calibrated`` is False, True (isotonic) or the method."""
        kind = LogisticRegressionModel if calibrated == "sigmoid" else IsotonicRegressionModel
        return cls(PipelineModel.load(f"{path}/trees"), kind.load(f"{path}/calibration") if calibrated else None)

    def predict(self, df: DataFrame) -> DataFrame:
        d = self._raw(df)
        if isinstance(self.calibration, LogisticRegressionModel):
            d = self.calibration.transform(_vector(d)).withColumn("_p", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")
        elif self.calibration is not None:
            d = self.calibration.setFeaturesCol("_p").setPredictionCol("_q").transform(d).withColumn("_p", F.col("_q")).drop("_q")
        return d.withColumn("p", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("_p")))).drop("_p")


def _vector(d: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["_p"], outputCol="_v").transform(d)


def offline_forecast(samples: DataFrame, events: DataFrame, horizon_min: float = 60.0, folds: int = 4, rounds: int = 10, calibration: str = "isotonic") -> DataFrame:
    """Held-out forecasts (event_id, stream, t, y, p, climatology, persistence, hawkes) of the last fold: features, labels, rolling-origin folds, trees, calibration.

    ``samples`` as for ``features``, ``events`` with stream, t_start, t_peak and t_end. The trees learn from the earlier
    four fifths of the fold's training rows, the calibration from the rest; the fold tests on what comes after the embargo.
    """
    from .common import cut
    from .features import FEATURES, features
    from .verify import blocked_folds, climatology, hawkes, hawkes_rate, labels, persistence_decayed

    wide = features(samples, events, horizon_min=horizon_min)
    rows = cut(labels(wide, events, horizon_min, ["stream"]))
    last = cut(blocked_folds(rows, folds, order=("t", "event_id")).where(F.col("fold") == folds))
    train, test = last.where("role = 'train'"), last.where("role = 'test'")
    split = train.agg(F.percentile_approx("t", 0.8)).first()[0]
    model = Forecaster.fit(train.where(F.col("t") <= split), FEATURES, rounds=rounds)
    model.calibrate(train.where(F.col("t") > split), method=calibration)
    base = climatology(train).first()["p"]  # two numbers of the training rows
    known = events.select("t_start").where(F.col("t_start") < train.agg(F.max("t")).first()[0])
    mu = hawkes_rate(known.select(F.col("t_start").alias("t"))).first()["mu_per_min"]
    past = F.col("decayed_flare_history")
    out = model.predict(test).withColumns({"climatology": F.lit(base), "persistence": persistence_decayed(past), "hawkes": hawkes(F.lit(mu), past, F.lit(horizon_min))})
    return out.select("event_id", "stream", "t", "y", "p", *BASELINES)


BASELINES = ("climatology", "persistence", "hawkes")


def offline_report(samples: DataFrame, events: DataFrame, horizon_min: float = 60.0, folds: int = 4, rounds: int = 10, calibration: str = "isotonic") -> DataFrame:
    """The offline pipeline's last step: one row with the battery of the held-out forecasts and their skill against the three baselines."""
    from .common import cut
    from .verify import report

    return report(cut(offline_forecast(samples, events, horizon_min, folds, rounds, calibration)), None, BASELINES)
