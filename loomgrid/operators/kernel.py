"""A kernel machine: the Gaussian kernel as features (Nystroem), then support vector machines for all classes at once.

The features are stored in blocks once. A step of the minimisation (L-BFGS over
the weights of all classes, on the driver) is one pass: each task gives loss and
gradient of its blocks by products of matrices, and Spark adds them up. What
reaches the driver is a number for each feature and class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import stored

#: Rows whose kernels are the features; a bounded sample, chosen by a hash of the features.
LANDMARKS = 256
#: The hinge is rounded off over this width; rows of a stored block.
SMOOTH, BLOCK_ROWS = 0.25, 2048


class KernelFeatures(Transformer):
    """Column ``features`` (vector) to ``kernel``: products of kernels with the landmarks whose inner products are the kernel's best approximation from these."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        super().__init__()
        self.landmarks, self.gamma = landmarks, gamma
        own = np.exp(-gamma * _squares(landmarks, landmarks))
        values, vectors = np.linalg.eigh(own)
        keep = values > 1e-10 * values.max()
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def _transform(self, df: DataFrame) -> DataFrame:
        landmarks, gamma, whiten = self.landmarks, self.gamma, self.whiten

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def kernels(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.exp(-gamma * _squares(np.stack(x.to_list()), landmarks)) @ whiten)) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("kernel", array_to_vector(kernels(vector_to_array("features"))))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


class KernelFeaturesEstimator(Estimator):
    """Takes the landmarks; ``gamma`` is one over the number of features times the variance of all their values where it isn't given."""

    def __init__(self, landmarks: int = LANDMARKS, gamma: float | None = None):
        super().__init__()
        self.landmarks, self.gamma = landmarks, gamma

    def _fit(self, df: DataFrame) -> KernelFeatures:
        rows = df.select(vector_to_array("features").alias("x"))
        gamma = self.gamma
        if gamma is None:
            total = lambda f: F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + f(v)))
            n, one, two = rows.agg(F.sum(F.size("x")), total(lambda v: v), total(lambda v: v * v)).first()
            width, spread = len(rows.first()["x"]), two / n - (one / n) ** 2
            gamma = 1.0 / (width * spread) if spread > 0 else 1.0
        chosen = rows.distinct().orderBy(F.xxhash64("x"), "x").limit(self.landmarks).collect()  # LANDMARKS rows
        return KernelFeatures(np.array([r.x for r in chosen], float), gamma)


def minimised(value_and_slope, start: np.ndarray, iterations: int, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with halving steps; ``value_and_slope`` of a point gives both."""
    x, (f, g) = start, value_and_slope(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.abs(g).max() < tolerance:
            break
        q, held = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            q -= a * y
            held.append(a)
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(held), strict=True):
            q += (a - y @ q / (s @ y)) * s
        step, slope = 1.0, -(q @ g)
        while True:
            new = x - step * q
            f_new, g_new = value_and_slope(new)
            if f_new <= f + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if (new - x) @ (g_new - g) > 1e-12:
            past = [*past, (new - x, g_new - g)][-memory:]
        x, f, g = new, f_new, g_new
    return x


class KernelMachineModel(Transformer):
    def __init__(self, features: KernelFeatures, weights: np.ndarray, labels: np.ndarray):
        super().__init__()
        self.features, self.weights, self.labels = features, weights, labels

    def _transform(self, df: DataFrame) -> DataFrame:
        landmarks, gamma, labels = self.features.landmarks, self.features.gamma, self.labels
        weights, offset = self.features.whiten @ self.weights[:-1], self.weights[-1]

        @F.pandas_udf(T.DoubleType())
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(labels[(np.exp(-gamma * _squares(np.stack(x.to_list()), landmarks)) @ weights + offset).argmax(axis=1)] if len(x) else [], dtype=float)

        return df.withColumn("prediction", predicted(vector_to_array("features")))


class KernelMachine(Estimator):
    """Support vector machines with the Gaussian kernel, one against the rest; ``cost`` weighs the sum of all errors against the margin. Rows: features (vector), label (double)."""

    def __init__(self, cost: float = 1.0, landmarks: int = LANDMARKS, gamma: float | None = None, iterations: int = 40):
        super().__init__()
        self.cost, self.features, self.iterations = cost, KernelFeaturesEstimator(landmarks, gamma), iterations

    def _fit(self, df: DataFrame) -> KernelMachineModel:
        features = self.features.fit(df)
        labels = np.array(sorted(r.label for r in df.select("label").distinct().collect()), float)  # classes
        width, k = features.whiten.shape[1] + 1, len(labels)

        def blocks(frames):
            for frame in frames:
                for a in range(0, len(frame), BLOCK_ROWS):
                    part = frame.iloc[a : a + BLOCK_ROWS]
                    yield pd.DataFrame({"x": [np.stack(part["x"].to_list()).ravel()], "y": [part["label"].to_numpy(float)]})

        rows = features.transform(df).select(vector_to_array("kernel").alias("x"), F.col("label").cast("double").alias("label"))
        data = stored(rows.mapInPandas(blocks, "x array<double>, y array<double>"), "kernel-rows")
        n = int(data.agg(F.sum(F.size("y"))).first()[0] or 0)
        weight = 1.0 / (self.cost * max(1, n))

        def value_and_slope(flat: np.ndarray) -> tuple[float, np.ndarray]:
            w = flat.reshape(width, k)

            def run(frames):
                slope, loss = np.zeros((width, k)), 0.0
                for frame in frames:
                    for x, y in zip(frame["x"], frame["y"], strict=True):
                        x = np.c_[np.asarray(x).reshape(len(y), width - 1), np.ones(len(y))]
                        side = np.where(np.asarray(y)[:, None] == labels[None, :], 1.0, -1.0)
                        short = 1 - side * (x @ w)
                        loss += np.where(short > SMOOTH, short - SMOOTH / 2, np.maximum(short, 0) ** 2 / (2 * SMOOTH)).sum()
                        slope -= x.T @ (side * np.clip(short / SMOOTH, 0, 1))
                yield pd.DataFrame({"i": np.arange(-1, width * k), "v": np.r_[loss, slope.ravel()]})

            sums = data.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
            inner = w.copy()
            inner[-1] = 0  # the offset is free
            return sums[0] / n + weight / 2 * (inner**2).sum(), sums[1:] / n + weight * inner.ravel()

        weights = minimised(value_and_slope, np.zeros(width * k), self.iterations).reshape(width, k)
        return KernelMachineModel(features, weights, labels)
