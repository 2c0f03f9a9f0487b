"""Fitted pipelines as flat arrays, so that tasks can evaluate them for many rows at once.

A forecast that feeds on itself needs one prediction a step. Run through `transform`, each
step is a Spark job; as arrays (medians, index maps, deviations, and a model's coefficients
or tree nodes) all steps of a series are taken inside one narrow pass. A model's size is
set by its parameters, not by the data, so it is safe in a closure.
"""

import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, StandardScalerModel, StringIndexerModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hourlake.session import remove, shared_dir


class Linear:
    def __init__(self, coefficients, intercept: float):
        self.coefficients, self.intercept = np.asarray(coefficients, float), float(intercept)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients + self.intercept


class Factors:
    """Factorization machine: a line and the products of all pairs of inputs."""

    def __init__(self, linear, factors, intercept: float):
        self.line, self.factors = Linear(linear, intercept), np.asarray(factors, float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        both = (x @ self.factors) ** 2 - (x * x) @ (self.factors * self.factors)
        return self.line.predict(x) + 0.5 * both.sum(axis=1)


class Trees:
    """All nodes of an ensemble in one table; a leaf has no feature."""

    def __init__(self, roots, weights, feature, threshold, left, right, value):
        self.roots, self.weights = roots, weights
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, row = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                lower = x[row, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(lower, self.left[at], self.right[at]), at)
            out += weight * self.value[at]
        return out


class Exported:
    """Preparation and model of a pipeline: raw inputs in the order of `numeric`, then the ids."""

    def __init__(self, numeric: list[str], medians: np.ndarray, labels: dict[str, dict[str, int]], deviations: np.ndarray, model):
        self.numeric, self.medians, self.labels, self.model = numeric, medians, labels, model
        self.scale = np.where(deviations != 0, 1 / np.where(deviations != 0, deviations, 1), 0.0)

    def indexed(self, column: str, values) -> np.ndarray:
        known = self.labels[column]
        return np.array([known.get(v, len(known)) for v in values], float)

    def predict(self, numeric: np.ndarray, ids: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(numeric), self.medians, numeric)
        return self.model.predict(np.hstack((filled, ids)) * self.scale)


def _trees(model, weights: list[float]) -> Trees:
    """The nodes, read from the stored form of the model."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark).rstrip('/')}/exported-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select("treeID", "nodeData.*") if "treeID" in rows.columns else rows.withColumn("treeID", F.lit(0))
    rows = rows.select("treeID", "id", "prediction", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories")
    nodes = sorted(map(tuple, rows.collect()), key=lambda n: n[:2])
    remove(spark, path)
    at = {n[:2]: i for i, n in enumerate(nodes)}
    inner = [n[3] >= 0 for n in nodes]
    if any(n[7] >= 0 for n, split in zip(nodes, inner, strict=True) if split):
        raise ValueError("splits by category cannot be exported; inputs must be plain numbers")
    return Trees(
        [at[t, 0] for t in sorted({n[0] for n in nodes})], weights,
        np.array([n[5] if split else -1 for n, split in zip(nodes, inner, strict=True)]),
        np.array([n[6][0] if split else 0.0 for n, split in zip(nodes, inner, strict=True)]),
        *[np.array([at[n[0], n[c]] if split else -1 for n, split in zip(nodes, inner, strict=True)]) for c in (3, 4)],
        np.array([n[2] for n in nodes]),
    )


def export(pipeline: PipelineModel) -> Exported:
    """The arrays of a pipeline as `preprocess_stages` and an estimator of `model_specs` make it."""
    stages, model = pipeline.stages[:-1], pipeline.stages[-1]
    one = lambda kind: next(s for s in stages if isinstance(s, kind))
    imputer = one(ImputerModel)
    numeric = imputer.getInputCols()
    medians = imputer.surrogateDF.first()
    labels = {s.getInputCol(): {v: i for i, v in enumerate(s.labels)} for s in stages if isinstance(s, StringIndexerModel)}
    if hasattr(model, "factors"):
        flat = Factors(model.linear.toArray(), model.factors.toArray(), model.intercept)
    elif hasattr(model, "coefficients"):
        flat = Linear(model.coefficients.toArray(), model.intercept)
    else:
        averaged = type(model).__name__.startswith("RandomForest")
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        flat = _trees(model, [w / len(weights) for w in weights] if averaged else weights)
    return Exported(list(numeric), np.array([medians[c] for c in numeric], float), labels, one(StandardScalerModel).std.toArray(), flat)
