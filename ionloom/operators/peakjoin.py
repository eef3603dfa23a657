"""Peaks matched with peaks as rows: a tolerance join and a one-to-one choice, without arrays of a spectrum's peaks.

The greedy matching takes pairs in a total order and drops what shares a peak with a taken one. A pair that is the best left of both its
peaks is taken whatever happens elsewhere, so all such pairs can be taken at once: a round takes them and drops their rivals, and
rounds give the greedy matching exactly. Most pairs go in a few rounds; a chain in which each pair waits for the next one would
need a round for each, so what is left after ROUNDS is walked in order, run by run. A run is a stretch of pairs linked by shared
peaks in m/z; pairs of different runs never compete.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch
from .bandjoin import absolute_join

ROUNDS = 6


def tolerance_pairs(left: DataFrame, right: DataFrame, on: list[str], mz: str, ref: str, tol: float) -> DataFrame:
    """Rows of left and right of the same `on` with |mz - ref| <= tol, with both sides' columns and gap. The join is on `on` and a bucket of m/z, so one spectrum's peaks spread over tasks."""
    return absolute_join(left, right, mz, ref, tol, on).withColumn("gap", F.abs(F.col(mz) - F.col(ref)))


def one_to_one(pairs: DataFrame, on: list[str], left: str, right: str, order: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """The greedy matching of pairs within `on`: the first pair in order, ties to the smaller left and right value, then the first whose left and right are both free, and so on.

    left and right name the m/z of the two peaks, which tell peaks of one side apart. Rows of one (on, left, right) count once. Rounds are
    written to the shared folder.
    """
    spark = pairs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"peaks-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    a, b = Window.partitionBy(*on, left), Window.partitionBy(*on, right)
    once = pairs.withColumn("_place", place).dropDuplicates([*on, left, right])
    open_, taken = kept(once, "open"), []
    for _ in range(rounds):
        marked = open_.withColumn("_best", F.min("_place").over(a) == F.col("_place")).withColumn("_best", F.col("_best") & (F.min("_place").over(b) == F.col("_place")))
        marked = kept(marked.withColumn("_gone", F.max("_best").over(b)).withColumn("_gone", F.col("_gone") | F.max("_best").over(a)), "round")
        taken.append(marked.where("_best").drop("_best", "_gone"))
        open_ = marked.where(~F.col("_gone")).drop("_best", "_gone")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, taken).drop("_place")
    return reduce(DataFrame.unionByName, [*taken, _walked(open_, on, left, right)]).drop("_place")


def _walked(pairs: DataFrame, on: list[str], left: str, right: str) -> DataFrame:
    """The greedy matching of pairs by one walk through each run."""
    w = Window.partitionBy(*on).orderBy(F.least(left, right))
    far = F.max(F.greatest(left, right)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = pairs.withColumn("_new", F.coalesce((F.least(left, right) > far).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    columns = pairs.columns

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(rows)), key=lambda i, p=[tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in rows["_place"]]: p[i])
        x, y, mine, theirs, keep = rows[left].to_numpy(), rows[right].to_numpy(), set(), set(), []
        for i in order:
            if x[i] not in mine and y[i] not in theirs:
                mine.add(x[i])
                theirs.add(y[i])
                keep.append(i)
        return rows.iloc[keep][columns]

    return runs.groupBy(*on, "_run").applyInPandas(walk, pairs.schema)


def matched_cosine(matches: DataFrame, pairs: DataFrame, norms: DataFrame, a: str, b: str, product: str = "product") -> DataFrame:
    """(a, b, score, matches) of pairs: the products of matches over both norms; norms is (id, norm) of all spectra."""
    sums = matches.groupBy(a, b).agg(F.sum(product).alias("_s"), F.count("*").cast("int").alias("matches"))
    both = pairs.select(a, b).join(norms.select(F.col("id").alias(a), F.col("norm").alias("_a")), a).join(norms.select(F.col("id").alias(b), F.col("norm").alias("_b")), b)
    score = F.when(F.col("_a") * F.col("_b") > 0, F.coalesce("_s", F.lit(0.0)) / (F.col("_a") * F.col("_b"))).otherwise(0.0)
    return both.join(sums, [a, b], "left").select(a, b, score.alias("score"), F.coalesce("matches", F.lit(0)).alias("matches"))
