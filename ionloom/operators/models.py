"""Rankers and their tuning: boosted trees, logistic regression with temperature, weight search on a grid."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import PART_ROWS


def class_weights(unseen: Column, w: float, library: Column | None = None, hold: float = 0.85, boost: float = 10.0) -> Column:
    """w for rows of unseen structures, 1 - w for the others; a library match of at least `hold` adds `boost`."""
    base = F.when(unseen, w).otherwise(1 - w)
    return base if library is None else base + F.when(F.coalesce(library, F.lit(0.0)) >= hold, boost).otherwise(0.0)


def _known(df: DataFrame, features: list[str]) -> None:
    if missing := [c for c in features if c not in df.columns]:
        raise ValueError(f"missing features: {', '.join(missing)}")


def _features(df: DataFrame, features: list[str]) -> DataFrame:
    _known(df, features)
    # a missing value is 0, as evidence that isn't there
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df.na.fill(0.0, features))


def _fitted(train: DataFrame, features: list[str], label: str, estimators: list) -> list:
    """Models of one assembled table, which is kept while they are fitted."""
    weights = {e.getWeightCol() for e in estimators if e.isSet("weightCol")}
    rows = _features(train, features).select("_x", F.col(label).cast("double").alias(label), *weights).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [e.fit(rows) for e in estimators]
    finally:
        rows.unpersist()


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of df in partitions whose number grows with its rows, so that what a task reads and keeps doesn't grow with the table or with its files. They are ordered
    in each partition, so that a sample drawn by place is the same whatever order a shuffle brings them in."""
    rows = df.select(*columns)
    least = df.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-df.count() // PART_ROWS))).sortWithinPartitions(*columns)


def fit_boosted(train: DataFrame, features: list[str], label: str, weight: str, seeds: list[int], rounds: int = 20, depth: int = 4) -> list:
    """One boosted-tree model per seed."""
    _known(train, features)
    return _fitted(dealt(train, [*features, label, weight]), features, label, [GBTClassifier(featuresCol="_x", labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=depth, seed=s, subsamplingRate=0.8) for s in seeds])


def equal_rows(df: DataFrame, columns: list[str], count: str) -> DataFrame:
    """One row for all rows that are equal in `columns`, with their number as a weight: a sum over rows, as a log loss is, is then a sum over fewer rows."""
    return df.groupBy(*columns).agg(F.count("*").cast("double").alias(count))


def fit_logistic(train: DataFrame, features: list[str], label: str, ridge: float = 1e-3, weight: str | None = None):
    """A logistic regression; rows count `weight` times if it is given."""
    how = {} if weight is None else {"weightCol": weight}
    return _fitted(train, features, label, [LogisticRegression(featuresCol="_x", labelCol=label, regParam=ridge, maxIter=50, **how)])[0]


def predict(df: DataFrame, models: list, features: list[str], name: str = "p") -> DataFrame:
    """The mean over models of the probability of label 1."""
    rows, total = _features(df, features), F.lit(0.0)
    for i, m in enumerate(models):
        rows = m.setPredictionCol(f"_c{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_p{i}").transform(rows)
        total = total + vector_to_array(f"_p{i}")[1]
    return rows.withColumn(name, total / len(models)).select(*df.columns, name)


def linear(features: list[tuple[str, float]], bias: float) -> Column:
    """sigmoid(w x + b) with given weights; a missing feature counts 0."""
    z = F.lit(float(bias))
    for c, w in features:
        z = z + w * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def gated_order(df: DataFrame, group: str, p: str, key: str, gate: float) -> DataFrame:
    """Lists whose best p reaches the gate are ordered by p, the others keep their ranks."""
    w = Window.partitionBy(group)
    by = F.row_number().over(w.orderBy(F.desc(F.round(p, 12)), "rank", key))
    return df.withColumns({"_b": F.max(p).over(w), "_n": by}).withColumn("rank", F.when(F.col("_b") >= gate, F.col("_n")).otherwise(F.col("rank"))).drop("_b", "_n")


def temperature_losses(df: DataFrame, logit: str, label: str, grid: list[float]) -> DataFrame:
    """(temperature, loss): the mean log loss of sigmoid(logit / T) for each T of the grid, in one pass."""
    p = lambda t: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-F.col(logit) / t))))
    loss = lambda t: -F.avg(F.when(F.col(label) == 1, F.ln(p(t))).otherwise(F.ln(1 - p(t))))
    every = df.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)])
    return every.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(grid)])).alias("x")).select("x.*")


def simplex(steps: int) -> list[tuple[float, float, float]]:
    """Weights of three models on a grid that sum to 1."""
    return [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]


def weight_search(df: DataFrame, group: str, fold: str, truth: str, scores: list[str], grid: list[tuple], k: int = 25) -> DataFrame:
    """(fold, w, mrr): for every weighting of the grid the MRR@k of each fold's groups; the truth's rank is pessimistic.

    The grid is an array in each row (its size is a parameter), so the rows of a list are read and shuffled once: for each
    list the scores of the truth are set against those of the others. A group without truth counts 0.
    """
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in grid])
    value = lambda w: F.round(sum((w[i] * F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(scores)), F.lit(0.0)), 12)
    rows = df.withColumn("_v", F.transform(weights, value))
    best = rows.groupBy(fold, group).agg(*[F.max(F.when(F.col(truth), F.col("_v")[i])).alias(f"t{i}") for i in range(len(grid))])
    joined = rows.join(best, [fold, group])
    above = joined.groupBy(fold, group).agg(*[F.when(F.first(f"t{i}").isNotNull(), 1 + F.count_if(~F.col(truth) & (F.col("_v")[i] >= F.col(f"t{i}")))).alias(f"r{i}") for i in range(len(grid))])
    rr = lambda c: F.avg(F.when(F.col(c) <= k, 1 / F.col(c)).otherwise(0.0))
    out = above.groupBy(fold).agg(*[rr(f"r{i}").alias(f"m{i}") for i in range(len(grid))])
    return out.select(fold, F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.col(f"m{i}").alias("mrr")) for i in range(len(grid))])).alias("x")).select(fold, "x.*")


def cross_validated(found: DataFrame, fold: str) -> DataFrame:
    """(fold, w, train_mrr, mrr): the weighting with the best mean over the other folds (ties to the first) and its value on the fold itself."""
    w = Window.partitionBy("w")
    others = (F.sum("mrr").over(w) - F.col("mrr")) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    rows = found.withColumn("train_mrr", F.round(others, 12))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("train_mrr"), "w"))).where("_n = 1").drop("_n")


def newton_folds(df: DataFrame, features: list[str], label: str, fold: str, folds: int, steps: int = 8, ridge: float = 1e-3) -> list[list[float]]:
    """For each fold the logistic regression (bias first) of all rows outside it, all folds together by Newton steps from 0: a step is one aggregate over df of
    the gradients and Hessians of every fold, without a shuffle of rows. ridge weighs the squares of the weights (not of the bias), as a sum beside the log loss of all rows. Missing features are 0."""
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]]
    rows = df.select(F.col(fold).alias("_k"), F.col(label).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    n, w = len(x), [[0.0] * len(x) for _ in range(folds)]
    at = [F.col(f"_x{i}") for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    for _ in range(steps):
        sums = []
        for k in range(folds):
            p = 1 / (1 + F.exp(-sum((at[i] * w[k][i] for i in range(1, n)), at[0] * w[k][0])))
            own = lambda c, k=k: F.sum(F.when(F.col("_k") != k, c).otherwise(0.0))
            sums += [own(at[i] * (F.col("_y") - p)).alias(f"g{k}_{i}") for i in range(n)] + [own(at[i] * at[j] * p * (1 - p)).alias(f"h{k}_{i}_{j}") for i, j in pairs]
        found = rows.agg(*sums).first()
        for k in range(folds):
            g = np.array([(found[f"g{k}_{i}"] or 0.0) - (ridge * w[k][i] if i else 0.0) for i in range(n)])
            h = np.zeros((n, n))
            for i, j in pairs:
                h[i, j] = h[j, i] = found[f"h{k}_{i}_{j}"] or 0.0
            h += np.diag([1e-12] + [ridge] * (n - 1))
            w[k] = (np.array(w[k]) + np.linalg.solve(h, g)).tolist()
    return w


def held_out_loss(df: DataFrame, features: list[str], label: str, fold: str, weights: list[list[float]]) -> DataFrame:
    """(fold, n, loss): the mean log loss of each fold under the weights fitted without it."""
    z = F.lit(None).cast("double")
    for k, w in enumerate(weights):
        own = F.lit(w[0])
        for c, v in zip(features, w[1:], strict=True):
            own = own + v * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        z = F.when(F.col(fold) == k, own).otherwise(z)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-z))))
    return df.groupBy(fold).agg(F.count("*").alias("n"), (-F.avg(F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("loss"))
