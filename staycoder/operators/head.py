"""Logistic classification head on document vectors, fitted and applied by Spark ML."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycoder.operators.pooling import as_vector

OWN_COLUMNS = ("_features", "_logits", "_probability", "_label_id", "_code")  # of a head's stages, dropped from results


@dataclass(frozen=True)
class HeadConfig:
    """C is the inverse penalty strength on the summed loss; max_iter bounds the L-BFGS steps."""

    C: float = 1.0
    max_iter: int = 200
    tolerance: float = 1e-6
    aggregation_depth: int = 3


class HeadInfo(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Last stage of a head: when it was fitted and which classes it knows. It changes no row."""

    createdAt = Param(Params._dummy(), "createdAt", "time of the fit, UTC", typeConverter=TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "labels in id order", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, createdAt: str | None = None, classes: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset


def usable_rows(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows that can be learned from: vector present, label neither null nor empty."""
    return df.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & (F.col(label) != ""))


def fit_head(
    df: DataFrame,
    vector: str = "emb",
    label: str = "gold_dp",
    config: HeadConfig = HeadConfig(),
    weight: str | None = None,
) -> PipelineModel:
    """Fit the multinomial head (binomial for two classes) on the usable rows.

    The penalised objective C * sum(w * loss) + |W|^2 / 2 becomes Spark's mean loss with
    regParam = 1 / (C * sum(w)); intercepts are free and features are not rescaled. `df` is read
    for the class counts and once more by the solver, which caches its blocks: pass a stored table
    if computing the vectors is expensive. Its partitions are kept, so a caller spreads a tiny table; gradients are
    added up in a tree of `aggregation_depth`. Only labels and coefficients reach the driver.
    """
    rows = usable_rows(df, vector, label)
    rows = rows.select(
        as_vector(df, vector).alias("features"),
        F.col(label).cast("string").alias("label_name"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
    )
    per_class = rows.groupBy("label_name").agg(F.sum("weight").alias("w"))
    classes = per_class.orderBy("label_name").collect()
    if not classes:
        raise ValueError("no usable training row: every vector or label is missing")
    if len(classes) == 1:
        raise ValueError(f"only one class to learn: {classes[0]['label_name']!r}")
    names = [row["label_name"] for row in classes]
    total = sum(row["w"] for row in classes)
    indexer = StringIndexerModel.from_labels(names, inputCol="label_name", outputCol="label")
    solver = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        predictionCol="_label_id",
        probabilityCol="_probability",
        rawPredictionCol="_logits",
        family="auto",
        regParam=1.0 / (config.C * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=config.max_iter,
        tol=config.tolerance,
        aggregationDepth=config.aggregation_depth,
    )
    model = solver.fit(indexer.transform(rows))
    if model.summary.totalIterations >= config.max_iter:
        warnings.warn(f"the head stopped after {config.max_iter} iterations", stacklevel=2)
    # the summary holds the training table and its session, which must not travel with the model to the tasks
    model._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    model.setFeaturesCol("_features")
    names_back = IndexToString(inputCol="_label_id", outputCol="_code", labels=names)
    created = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    return PipelineModel(stages=[model, names_back, HeadInfo(createdAt=created, classes=names)])


def predict_head(
    df: DataFrame, model: PipelineModel, vector: str = "emb", out: str = "pred", with_score: bool = False
) -> DataFrame:
    """Add `out` = struct(code, score) for every row; the score is filled on request only."""
    applied = model.transform(df.withColumn("_features", as_vector(df, vector)))
    score = F.array_max(vector_to_array("_probability")) if with_score else F.lit(None).cast("double")
    prediction = F.struct(F.col("_code").alias("code"), score.alias("score"))
    return applied.withColumn(out, prediction).drop(*OWN_COLUMNS)


def class_logits(df: DataFrame, model: PipelineModel, vector: str = "emb", out: str = "logits") -> DataFrame:
    """Add the log-probabilities of all classes, in label order, as array<double>."""
    applied = model.stages[0].transform(df.withColumn("_features", as_vector(df, vector)))
    logs = F.transform(vector_to_array("_probability"), lambda p: F.ln(F.greatest(p, F.lit(1e-300))))
    return applied.withColumn(out, logs).drop(*OWN_COLUMNS)


def head_labels(model: PipelineModel) -> list[str]:
    return model.stages[1].getLabels()


def head_info(model: PipelineModel) -> dict[str, object]:
    """created_at and classes of a fitted or loaded head."""
    info = model.stages[-1]
    return {"created_at": info.getOrDefault("createdAt"), "classes": info.getOrDefault("classes")}


def save_head(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_head(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise FileNotFoundError(
            f"no saved head at {os.fspath(path)!r}: fit one in train mode before predicting"
        ) from error
