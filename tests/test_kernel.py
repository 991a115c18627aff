import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomgrid.operators import kernel, learn


def exact_machine(x, y, gamma, cost, rounds=300):
    """Dual coordinate ascent over the whole kernel matrix; 1 is added to the kernel for the offset."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)) + 1
    a, f = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(rounds):
        for i in range(len(x)):
            new = np.clip(a[i] + (1 - y[i] * f[i]) / k[i, i], 0, cost)
            f += (new - a[i]) * y[i] * k[i]
            a[i] = new
    return lambda z: np.sign((np.exp(-gamma * ((z[:, None] - x[None]) ** 2).sum(-1)) + 1) @ (a * y))


def rings(rng, n):
    r, t = np.where(rng.random(n) < 0.5, 1.0, 2.0), rng.random(n) * 2 * np.pi
    return np.c_[r * np.cos(t), r * np.sin(t)] + rng.normal(0, 0.3, (n, 2)), np.where(r > 1.5, 1.0, 0.0)


def test_kernel_machine_against_an_exact_one(spark):
    rng = np.random.default_rng(8)
    (x, y), (z, w) = rings(rng, 400), rings(rng, 1000)
    frame = lambda a, b: spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(a, b, strict=True)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    gamma = 1 / (2 * x.var())
    want = (exact_machine(x, 2 * y - 1, gamma, 1.0)(z) == 2 * w - 1).mean()
    model = kernel.KernelMachine(landmarks=80).fit(frame(x, y))
    got = model.transform(frame(z, w)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    linear = learn.models()["linear_svm"].fit(frame(x, y)).transform(frame(z, w)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert want > 0.9 and abs(got - want) <= 0.02 and linear < 0.7
    features = model.features
    k = features.transform(frame(x[:40], y[:40])).select("kernel").collect()
    inner = np.array([r.kernel.toArray() for r in k])
    assert np.abs(inner @ inner.T - np.exp(-gamma * ((x[:40, None] - x[None, :40]) ** 2).sum(-1))).max() < 0.01


def test_three_classes(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (80, 2)) for c in ((0, 0), (2, 0), (0, 2))])
    rows = spark.createDataFrame([(v.tolist(), float(10 + i // 80)) for i, v in enumerate(x)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    out = kernel.KernelMachine(landmarks=40, iterations=25).fit(rows).transform(rows)
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95
    assert kernel.minimised(lambda v: (((v - 3) ** 2 * [1, 50]).sum(), 2 * (v - 3) * [1, 50]), np.zeros(2), 50).round(3).tolist() == [3, 3]
