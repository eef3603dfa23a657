"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ionloom import catalog, catalog_chem, catalog_evidence, catalog_io, catalog_relations, catalog_scores  # noqa: F401 - register queries
from ionloom.catalog import _arrays, _spectra, _t, _words, queries
from ionloom.operators import bandjoin, fuse, network, peaks, rank, similarity

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "library_search", "ppm_band_join", "adaptive_window", "interval_union", "interval_semi_join", "filter_chain", "entropy_weighting", "bin_spectrum",
    "merge_close_peaks", "entropy_similarity", "greedy_cosine", "modified_cosines", "fp_tanimoto_topk", "profile_scores", "rrf_fusion", "slot_merge",
    "rank_features", "ranker_features", "final_fusion", "network_edges", "neighbor_propagation", "analog_features", "evidence_agg", "spectral_fusion",
    "evidence_scatter", "formula_rerank", "explained_levels", "weight_grid", "reference_tiers", "candidate_sets", "complementarity",
]


def rerank_400_by_25(spark, d):
    """The published workload's shape: 400 queries of 25 candidates, five channels, a similarity graph of the queries, a rerank by it."""
    ids = _spectra(spark, d).orderBy("sid").limit(400).select("sid", "precursor")
    spectra = ids.join(_arrays(spark, d), "sid").withColumn("unit", peaks.unit_normalise(peaks.powered(F.col("peaks"), "sqrt")))
    pool = _t(spark, d, "embeddings").select("vec_id", _words("embedding").alias("features"), F.col("embedding").cast("array<double>").alias("z"))
    pairs = bandjoin.block_join(ids, pool.select("vec_id"), "sid", "vec_id")
    own = rank.top_k(pairs, ["sid"], [F.xxhash64("sid", "vec_id"), F.asc("vec_id")], 25).select("sid", F.col("vec_id").alias("key"))
    rows = own.join(spectra, "sid").join(pool.withColumnRenamed("vec_id", "key"), "key")
    mass = F.col("precursor") * (1 + (F.col("key") % 21 - 10) * 1e-6)
    frag = similarity.explained_levels(F.col("peaks"), [(F.transform("z", lambda x: F.abs(x) * 1000), 1.0)], [1.0, -1.0], 5.0)
    terms = [(similarity.cosine(F.col("z"), F.transform("z", lambda x: F.abs(x))), 1.6343, False), (frag, 1.6024, False), (F.exp(-F.abs(F.col("z")[0])), 0.75, True), (F.exp(-0.5 * F.pow((mass / F.col("precursor") - 1) * 1e6 / 3.5, 2)), 0.5, True), (F.exp(-F.abs(F.col("z")[1])), 0.3, True)]
    scored = rows.select("sid", "key", "features", fuse.channels(terms).alias("score"))
    lists = scored.withColumn("rank", F.row_number().over(rank.Window.partitionBy("sid").orderBy(F.desc("score"), "key")))
    cosine = lambda a, b: similarity.walk_cosine(F.col(f"{a}.unit"), F.col(f"{b}.unit"), 0.5)
    network.NODES = 50  # 400 nodes as a grid of 64 cells
    graph = network.edges(spectra.select("sid", "unit", F.lit(0).alias("stratum")), "sid", "stratum", cosine, 0.3, 6)
    support = network.propagate(graph, lists.select("sid", "key", "rank", "features"), "sid", similarity.tanimoto)
    return network.rerank(lists, support, "sid", 0.5, F.col("sid") % 2 == 0)


def main() -> None:
    n = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", n).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds, failed = queries() | {"rerank_400_by_25": rerank_400_by_25}, {}, {}
    found["rank_features"](spark, SF).write.format("noop").mode("overwrite").save()  # warm-up
    for name in [*HEADLINE, "rerank_400_by_25"]:
        began = time.perf_counter()
        try:
            found[name](spark, SF).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - one failing query leaves the others their figures
            failed[name] = str(e).strip().splitlines()[0][:200] if str(e).strip() else type(e).__name__
            continue
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "failed": failed, "sf": SF}))


if __name__ == "__main__":
    main()
