"""Distributed regressors and classifiers over windows and rows."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.operators import evaluate
from eventcast.operators.clean import feature_columns, fill_feature_nulls
from eventcast.operators.encode import apply_scaler, fit_scaler
from eventcast.operators.sequences import create_sequences, to_vectors
from eventcast.operators.split import split_column
from eventcast.session import result_table, stage


@dataclass(frozen=True)
class Regressor:
    """A named estimator setting."""

    name: str
    family: str = "linear"
    settings: dict = field(default_factory=dict)
    description: str = ""

    def estimator(self):
        if self.family == "linear":
            base = {"regParam": 0.01, "elasticNetParam": 0.0, "solver": "auto"}
            return LinearRegression(featuresCol="features", labelCol="y", **(base | self.settings))
        if self.family == "boosted":
            base = {"maxIter": 10, "maxDepth": 3, "seed": S.SEED}
            return GBTRegressor(
                featuresCol="features", labelCol="y", validationIndicatorCol="is_val",
                **(base | self.settings),
            )
        raise ValueError(f"unknown family {self.family}")


@contextmanager
def kept(df: DataFrame):
    """``df`` cached for several passes, unless it already is; released afterwards."""
    cached = df.storageLevel.useMemory or df.storageLevel.useDisk
    if not cached:
        df.persist()
    try:
        yield df
    finally:
        if not cached:
            df.unpersist()


def train_regressor(vectors: DataFrame, regressor: Regressor) -> Model:
    """Fit on the train rows; boosted trees stop early on the val rows."""
    fitted_on = ["train"] if regressor.family == "linear" else ["train", "val"]
    rows = vectors.filter(F.col("split").isin(fitted_on)).select(
        "y", "features", (F.col("split") == "val").alias("is_val")
    )
    with kept(rows):
        return regressor.estimator().fit(rows)


def predict(model: Model, vectors: DataFrame, split: str = "test") -> DataFrame:
    return model.transform(vectors.filter(F.col("split") == split)).withColumnRenamed(
        "prediction", "predicted"
    )


def evaluate_regressor(model: Model, vectors: DataFrame, name: str) -> DataFrame:
    scored = evaluate.score(predict(model, vectors), "y", "predicted")
    return scored.select(F.lit(name).alias("model"), "*")


def model_windows(
    panel: DataFrame, by: str, time: str, target: str = "attack_count",
    length: int = S.SEQUENCE_LENGTH, fit_on: str = "train",
    ratios: Sequence[float] = S.SPLIT_RATIOS, features: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str], DataFrame]:
    """Split windows over scaled features, the feature names and the scaler parameters.

    Features are every numeric panel column but the target; warm-up nulls become 0. The scaler
    sees the panel rows up to the last train target only (``fit_on='all'`` uses every row).
    """
    names = list(features) if features else feature_columns(panel, target)
    # Several passes read the panel, which is small next to the events behind it.
    filled = stage(fill_feature_nulls(panel.select(by, time, target, *names), names))
    keys = create_sequences(filled, names, target, length, by=by, time=time).select(
        by, "target_date"
    )
    label = split_column(keys, "target_date", [by], ratios)
    if fit_on == "train":
        last = keys.filter(label == "train").agg(F.max("target_date")).scalar()
        seen = filled.filter(F.col(time) <= last)
    else:
        seen = filled
    params = stage(fit_scaler(seen, names))
    scaled = apply_scaler(filled, params, names)
    windows = create_sequences(scaled, names, target, length, by=by, time=time)
    return windows.withColumn("split", label), names, params


def learned_model(
    panel: DataFrame, by: str, time: str, regressor: Regressor = Regressor("Windowed linear"),
    target: str = "attack_count", length: int = S.SEQUENCE_LENGTH,
) -> tuple[DataFrame, Model]:
    """Select, fill, scale, window, split, train and evaluate: (metrics row, model)."""
    windows, _, _ = model_windows(panel, by, time, target, length)
    vectors = to_vectors(windows).select(by, "target_date", "y", "split", "features")
    with kept(vectors):
        model = train_regressor(vectors, regressor)
        # The metrics are one row; computing them here lets the cached vectors go.
        row = evaluate_regressor(model, vectors, regressor.name).first()
    columns = "model string, n long, RMSE double, MAE double, MSE double, R2 double"
    return result_table(panel.sparkSession, [tuple(row)], columns), model


def classify(
    rows: DataFrame, features: str, label: str, max_iter: int = 50
) -> DataFrame:
    """Multinomial logistic regression on the train rows; predicted class of the test rows."""
    train = rows.filter(F.col("split") == "train").select(features, label)
    with kept(train):
        model = LogisticRegression(
            featuresCol=features, labelCol=label, predictionCol="predicted_code",
            family="multinomial", maxIter=max_iter, regParam=1e-4,
        ).fit(train)
    return model.transform(rows.filter(F.col("split") == "test")).withColumn(
        "predicted_code", F.col("predicted_code").cast("int")
    )
