"""The forward pass of a small network over rows: values are (id, i, x), absent ones are 0, and a layer is a join with its weights and a sum.

Sparse inputs such as binned spectra stay sparse: only bins that are there meet weights. Weights are (i, o, w), biases (o, b). They are broadcast up to
BROADCAST weights, beyond that joined by shuffle; an id has as many rows as a layer has outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST = 1_000_000


def linear(values: DataFrame, ids: DataFrame, weights: DataFrame, bias: DataFrame, key: str) -> DataFrame:
    """(key, i, x): W x + b for every id of ids, those without values included. Weights of one (i, o) add up."""
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df
    sums = values.join(few(weights), "i").groupBy(key, "o").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    outputs = bias.groupBy().agg(F.array_sort(F.collect_list(F.struct("o", "b"))).alias("out")).first()["out"]  # a layer's outputs
    every = ids.select(key, F.explode(F.array(*[F.struct(F.lit(r["o"]).alias("o"), F.lit(float(r["b"])).alias("b")) for r in outputs])).alias("e")).select(key, "e.*")
    return every.join(sums, [key, "o"], "left").select(key, F.col("o").alias("i"), (F.col("b") + F.coalesce("s", F.lit(0.0))).alias("x"))


def layer_norm(values: DataFrame, key: str, eps: float = 1e-5) -> DataFrame:
    """Each id's values less their mean, over their standard deviation."""
    w = Window.partitionBy(key)
    return values.withColumn("x", (F.col("x") - F.avg("x").over(w)) / F.sqrt(F.var_pop("x").over(w) + eps))


def silu(values: DataFrame) -> DataFrame:
    return values.withColumn("x", F.col("x") / (1 + F.exp(-F.col("x"))))


def residual(values: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """values plus those of a block of the same width."""
    return values.join(block.withColumnRenamed("x", "_x"), [key, "i"]).withColumn("x", F.col("x") + F.col("_x")).drop("_x")


def sigmoid(values: DataFrame) -> DataFrame:
    return values.withColumn("x", 1 / (1 + F.exp(-F.col("x"))))
