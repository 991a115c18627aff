"""Stratified folds, four classifiers, feature ranking and robust candidates."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import KernelMachine


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3) -> DataFrame:
    """``fold``: rows of each label dealt in order of key. A labelled training set is small; a label's rows pass through one task."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1) % k).cast("int"))


def models(seed: int = 42) -> dict:
    """Estimators by name. Spark's support vector machine is linear; the kernel one has the Gaussian kernel as features before it."""
    return {
        "random_forest": RandomForestClassifier(numTrees=100, seed=seed),
        "kernel_svm": KernelMachine(),
        "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=30)),
        "gaussian_nb": NaiveBayes(modelType="gaussian"),
    }


def cross_validate(df: DataFrame, k: int = 3, seed: int = 42, names: list[str] | None = None) -> DataFrame:
    """(model, fold, accuracy, f1) for rows (features vector, label double, fold), with a most-frequent baseline."""
    rows = []
    score = lambda out, metric: float(MulticlassClassificationEvaluator(metricName=metric).evaluate(out))
    df = df.select("features", F.col("label").cast("double").alias("label"), "fold").persist()
    for fold in range(k):
        train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        if train.isEmpty() or test.isEmpty():
            continue
        for name, estimator in models(seed).items():
            if names is None or name in names:
                out = estimator.fit(train).transform(test)
                rows.append((name, fold, score(out, "accuracy"), score(out, "f1")))
        most = train.groupBy("label").count().orderBy(F.col("count").desc(), "label").first()["label"]
        out = test.withColumn("prediction", F.lit(most))
        rows.append(("most_frequent", fold, score(out, "accuracy"), score(out, "f1")))
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, fold int, accuracy double, f1 double")


def summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_sd"), F.avg("f1").alias("f1"), F.stddev_pop("f1").alias("f1_sd"))


def discriminative_power(long: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """(feature, power): variance over classes of the class means, from rows (label, feature, value)."""
    means = long.groupBy(label, feature).agg(F.avg(value).alias("mean"))
    return means.groupBy(feature).agg(F.var_pop("mean").alias("power"))


def forest_importances(df: DataFrame, seed: int = 42) -> DataFrame:
    """(feature index, importance) of a forest fitted on all rows (features, label)."""
    model = RandomForestClassifier(numTrees=100, seed=seed).fit(df)
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(model.featureImportances.toArray())], "feature int, importance double")


def ranked(df: DataFrame, value: str, key: str, top: int | None = None) -> DataFrame:
    """``rank`` by descending value, ties by key; one row for each feature passes through."""
    out = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), key)))
    return out.where(F.col("rank") <= top) if top else out


def robust_candidates(a: DataFrame, a_value: str, b: DataFrame, b_value: str, key: str, top: int = 200) -> DataFrame:
    """Features in the top of both rankings, with both ranks."""
    x = ranked(a, a_value, key, top).select(key, F.col("rank").alias("rank_a"))
    return x.join(ranked(b, b_value, key, top).select(key, F.col("rank").alias("rank_b")), key)


def class_patterns(candidates: DataFrame, long: DataFrame, label: str, feature: str, value: str, labels: list) -> DataFrame:
    """Candidates (feature, rank_a, rank_b) with their mean rank and the mean of each class, as columns class_<label>; the best first."""
    chosen = long.join(candidates.select(feature), feature, "left_semi")
    means = chosen.groupBy(feature).pivot(label, labels).agg(F.avg(value))
    named = means.select(feature, *(F.col(f"`{x}`").alias(f"class_{x}") for x in labels))
    return candidates.withColumn("mean_rank", (F.col("rank_a") + F.col("rank_b")) / 2).join(named, feature).orderBy("mean_rank", feature)


def cumulative_share(rankings: DataFrame, value: str, ks: list[int]) -> DataFrame:
    """(k, share) of the total within the first k ranks."""
    one = rankings.agg(F.sum(value).alias("t"), *(F.sum(F.when(F.col("rank") <= k, F.col(value))).alias(f"s{k}") for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / F.col("t")).alias("share")) for k in ks))).alias("r")).select("r.*")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_pipeline(df: DataFrame, name: str, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[models(seed)[name]]).fit(df)
