"""From query masses and a pool of structures to ranked candidate lists.

python -m jobs.candidate_lists --config jobs/candidate_lists.json --queries TABLE --pool TABLE --output DIR

The windows of all queries are merged and cut out of the pool; of each structure (key and nominal mass) the lightest row stays, ties
to the better source; the result is written in order of mass. Each query then meets the candidates in its window, ranked by
closeness and popularity, one row a key; lists that are short are filled with the keys most frequent in the pool. The lists are held
against their contract before the job ends well.

Below --output: candidates/block=.. (mass in hundreds; pid, key, mass, source), lists/pol=.. (sid, rank, key, score, src: 0 window, 1 filler) and
checks (rule, broken). All three are overwritten as a whole, so a rerun over the same tables gives the same rows.

Queries are rows of the table `part` (sid p_partkey, precursor p_retailprice, polarity p_size % 2), the pool is `orders` (pid o_orderkey, key
o_custkey, mass o_totalprice / 500, source o_orderpriority).
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import bandjoin, fuse, rank, split
from ionloom.session import session

log = logging.getLogger("jobs.candidate_lists")

#: What a configuration may set, with defaults. Sources are listed from the best; one that isn't listed comes last.
DEFAULTS = {"ppm": 25.0, "least_width": 0.05, "sigma_ppm": 10.0, "popularity": 0.1, "n": 25, "sources": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def settings(config: dict) -> dict:
    """config over DEFAULTS; ValueError for a name that isn't there or a width that isn't positive."""
    if unknown := set(config) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found = DEFAULTS | config
    if min(found[k] for k in ("ppm", "least_width", "sigma_ppm", "n")) <= 0:
        raise ValueError("ppm, least_width, sigma_ppm and n are positive")
    return found


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("p_retailprice") > 0)
    return rows.select(F.col("p_partkey").alias("sid"), F.col("p_retailprice").alias("precursor"), (F.col("p_size") % 2).alias("pol"))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("o_custkey").isNotNull() & (F.col("o_totalprice") > 0))
    return rows.select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("key"), (F.col("o_totalprice") / 500).alias("mass"), F.col("o_orderpriority").alias("source"))


def _width(config: dict) -> Column:
    return F.greatest(F.lit(config["least_width"]), F.col("precursor") * config["ppm"] * 1e-6)


def extract(queries: DataFrame, pool: DataFrame, config: dict) -> DataFrame:
    """The structures of pool in any query's window: (pid, key, mass, source, block), the lightest row of each, ties to the better source."""
    w = _width(config)
    windows = bandjoin.union_intervals(queries.select((F.col("precursor") - w).alias("lo"), (F.col("precursor") + w).alias("hi")), "lo", "hi")
    inside = bandjoin.in_intervals(pool, windows, "mass", 4 * config["least_width"])
    place = F.coalesce(F.array_position(F.array(*map(F.lit, config["sources"])), F.col("source")), F.lit(0))
    inside = inside.withColumns({"nominal": F.floor("mass"), "place": F.when(place == 0, len(config["sources"]) + 1).otherwise(place)})
    return rank.first_by(inside, ["key", "nominal"], [F.asc("mass"), F.asc("place"), F.asc("pid")]).select("pid", "key", "mass", "source", F.floor(F.col("mass") / 100).cast("int").alias("block"))


def ranked(queries: DataFrame, candidates: DataFrame, popular: DataFrame, config: dict) -> DataFrame:
    """(sid, rank, key, score, src) of each query: its n best keys by closeness in mass and popularity, then the most frequent keys of the pool.

    Queries of one precursor have one list, which is made once.
    """
    w = _width(config)
    known = candidates.select("key", "mass").join(popular, "key")
    met = bandjoin.bounds_join(queries.select("precursor").distinct(), known, F.col("precursor") - w, F.col("precursor") + w, "mass", 4 * config["least_width"])
    error = (F.col("mass") / F.col("precursor") - 1) * 1e6 / config["sigma_ppm"]
    near = met.groupBy("precursor", "key", "count").agg(F.max(F.exp(-0.5 * error * error)).alias("near"))
    scored = near.withColumn("score", F.round(F.col("near") + config["popularity"] * F.log1p("count"), 6))
    best = rank.top_k(scored, ["precursor"], [F.desc("score"), F.asc("key")], config["n"]).select("precursor", "key", "score", "rank")
    best = queries.select("sid", "precursor").join(best, "precursor").drop("precursor")
    frequent = [r.key for r in popular.orderBy(F.desc("count"), "key").limit(config["n"]).collect()]  # n keys
    filler = queries.select("sid", F.posexplode(F.array(*map(F.lit, frequent)).cast("array<bigint>")).alias("rank", "key"))
    lists = fuse.backfill([best, filler], "sid", "key", config["n"])
    return lists.join(best.select("sid", "key", "score"), ["sid", "key"], "left").select("sid", "rank", "key", "score", "src")


def build(spark: SparkSession, queries: str, pool: str, output: str, config: dict | None = None) -> DataFrame:
    """Write candidates, lists and checks below output, and return them as they stand there, told apart by kind. ValueError if lists break their contract."""
    config = settings(config or {})
    asked = read_queries(spark, queries)
    rows = read_pool(spark, pool)
    found = extract(asked, rows, config)
    found.repartitionByRange("mass").sortWithinPartitions("mass").write.mode("overwrite").partitionBy("block").parquet(f"{output}/candidates")
    candidates = spark.read.schema("pid long, key long, mass double, source string, block int").parquet(f"{output}/candidates")
    popular = rows.groupBy("key").agg(F.count("*").alias("count"))
    lists = ranked(asked, candidates, popular, config).join(asked.select("sid", "pol"), "sid")
    lists.write.mode("overwrite").partitionBy("pol").parquet(f"{output}/lists")
    lists = spark.read.schema("sid long, rank int, key long, score double, src int, pol int").parquet(f"{output}/lists")
    split.check_lists(lists, asked, "sid", "key", config["n"]).coalesce(1).write.mode("overwrite").parquet(f"{output}/checks")
    checks = spark.read.parquet(f"{output}/checks")
    log.info("read %d queries and %d rows of the pool, wrote %d candidates and %d rows of lists", asked.count(), rows.count(), candidates.count(), lists.count())
    if broken := {r.rule: r.broken for r in checks.where("broken > 0").collect()}:
        raise ValueError(f"lists break their contract: {broken}")
    parts = [x.withColumn("kind", F.lit(kind)) for kind, x in (("candidate", candidates), ("list", lists), ("check", checks))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("config", "queries", "pool", "output"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("candidate_lists")
    try:
        config = spark.read.option("multiLine", True).json(args.config).first().asDict()
        build(spark, args.queries, args.pool, args.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
