"""Mixing sources to target weights by Poisson replication.

A source of n characters whose target share of the mix is w is repeated w T / n times on average (T: characters wanted).
Each document gets its own number of copies by inverting the Poisson distribution of that mean at a uniform number
hashed from a seed and the document, so the result depends on nothing else. Copies are shuffled by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hide, maybe_broadcast, shown, table

SEED = "mix-1"
#: Target weights are the source sizes to this power: 1 keeps the mix, 0 makes all sources equal.
FLATTEN = 0.5
#: A larger mean is the sum of several draws of at most this mean.
LARGEST = 500.0


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def target_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(source, size, rate) of each source, null being one. weights has (source, weight); a source it lacks gets rate 0. Without it they are size ** flatten. total: characters wanted, by default as many as there are."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(flatten)))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sums = weighed.where("size > 0").agg(F.sum("size").alias("all"), F.sum("weight").alias("w")).first()
    wanted = float(total if total is not None else sums["all"] or 0)
    rate = F.col("weight") / float(sums["w"] or 1) * wanted / F.col("size")
    return weighed.select("source", "size", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def _table(rates: DataFrame) -> DataFrame:
    """(source, draws, cdf): the Poisson distribution function of each source's draws, as far as doubles tell it from 1."""
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST), F.lit(1)).cast("int")
    rates = rates.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 25).cast("int")
    p0 = F.exp(-F.col("mean"))
    start = F.struct(p0.alias("p"), p0.alias("sum"), F.array(p0).alias("cdf"))

    def step(acc, j):
        p = acc["p"] * F.col("mean") / j
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + p)).alias("cdf"))

    return rates.select("source", "draws", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"]).alias("cdf"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: str = SEED, flatten: float = FLATTEN) -> DataFrame:
    """docs with each row as often as drawn, copy (from 1) and shuffle_key; columns of those names are replaced.

    A document is told apart by its doc_id, or by its text if that is null, so repeated rows get the same number of copies.
    The rates are broadcast if there are few sources.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = _table(target_rates(docs, weights, total, flatten)).withColumnRenamed("source", "rated")
    rows, names = hide(docs)
    own = {c: F.col(f"`{names[c]}`") for c in ("doc_id", "source", "text")}
    who = F.coalesce(own["doc_id"].cast("string"), F.md5(F.coalesce(own["text"], F.lit(""))))
    rows = rows.withColumn("who", who).join(maybe_broadcast(rates), own["source"].eqNullSafe(F.col("rated")))
    # each draw is hashed once, then compared with the distribution
    drawn = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: uniform(seed, F.col("who"), i))
    count = F.aggregate(F.col("drawn"), F.lit(0), lambda a, x: a + F.size(F.filter("cdf", lambda c: c <= x)))
    rows = rows.withColumn("drawn", drawn).withColumn("n", count).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "who", F.col("copy").cast("string")))
    return rows.select(*shown(names), "copy", key.alias("shuffle_key"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """A global shuffle: rows go to partitions by their key and are sorted by it there."""
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the mix; the texts take part in its sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return shuffled(replicate(docs).drop("text"))


QUERIES = {"op6_mixing": op6_mixing}

ORACLE = {
    "op6_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS who, coalesce(length(text), 0) AS n FROM documents),
     z AS (SELECT source, CAST(sum(n) AS DOUBLE) AS size FROM d GROUP BY source),
     t AS (SELECT sum(size) AS total, sum(pow(size, 0.5)) AS w FROM z WHERE size > 0),
     r AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / w * total / size ELSE 0 END AS mean FROM z, t),
     u AS (SELECT d.doc_id, d.source, d.who, r.mean, CAST(CAST('0x' || substr(md5('mix-1|' || d.who || '|1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS x FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
     p AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, range(0, 200) AS g(k) WHERE mean > 0),
     c AS (SELECT u.doc_id, u.source, u.who, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.x) AS n FROM u WHERE u.mean > 0)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('mix-1|order|' || who || '|' || copy) AS shuffle_key
FROM (SELECT doc_id, source, who, unnest(range(1, n + 1)) AS copy FROM c WHERE n > 0)
"""
}
