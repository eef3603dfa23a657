import random

import pytest
from pyspark.sql import functions as F

from ionloom.functions import chem
from ionloom.operators import bandjoin, fuse, network, peaks, similarity


def _p(spark, mz, it):
    df = spark.createDataFrame([(mz, it)], "mz array<double>, it array<double>")
    return df.withColumn("p", peaks.make(F.col("mz"), F.col("it")))


def test_masses_and_formulas(spark):
    df = spark.createDataFrame([(195.08765, "[M+H]+"), (300.0, "[M+Na]+"), (300.0, "?")], "mz double, a string")
    a, b, c = (r[0] for r in df.select(chem.neutral_mass(F.col("mz"), F.col("a"))).collect())
    assert abs(a - 194.08037) < 1e-3 and abs(b - (300 - 22.989218)) < 1e-4 and c is None
    df = spark.createDataFrame([("C6H6",), ("C6H5Cl",), ("C6H5Br",)], "f string")
    r = [x[0] for x in df.select(chem.isotope_ratios(F.col("f"))).collect()]
    assert abs(r[0].m1 - 0.065) < 0.005 and abs(r[1].m2 - 0.326) < 0.01 and abs(r[2].m2 - 0.975) < 0.015
    out = spark.createDataFrame([("CN1C=NC2=C1C(=O)N(C(=O)N2C)C",), ("C(",), (None,)], "s string").select(chem.smiles_formula("s").alias("x")).select("x.*").collect()
    assert out[0].formula == "C8H10N4O2" and abs(out[0].mass - 194.08037) < 1e-3 and out[1].formula is None and out[2].formula is None


def test_mass_prior(spark):
    r = spark.range(1).select(chem.mass_prior(F.lit(300.0), F.lit(300.0 * (1 - 1.5e-6))), chem.mass_prior(F.lit(300.0), F.lit(300.0 * (1 + 8e-6)))).first()
    assert r[0] > 0.999 and r[1] < 0.05


def test_pooling_merges_anchored_clusters(spark):
    df = _p(spark, [80.0, 100.001, 100.002, 150.0, 200.0], [0.8, 0.2, 0.5, 0.4, 1.0])
    out = df.select(peaks.pool(F.col("p"), 0.01)).first()[0]
    assert len(out) == 4 and abs(out[1].mz - 100.0015) < 1e-3 and out[1].it == 0.5


def test_losses_and_doublets(spark):
    df = _p(spark, [100.0, 200.0, 281.989, 300.0], [0.1, 0.3, 0.8, 1.0])
    assert "H2O" in df.select(chem.losses(F.col("p"), F.lit(300.0))).first()[0]
    df = _p(spark, [100.0, 150.0, 200.0, 201.997, 250.0], [0.2, 0.15, 1.0, 0.32, 0.05])
    assert df.select(chem.has_doublet(F.col("p"), F.lit(250.0), 1.99705, 0.24, 0.40)).first()[0]
    assert not df.select(chem.has_doublet(F.col("p"), F.lit(250.0), 1.997954, 0.8, 1.2)).first()[0]


@pytest.mark.parametrize("mz", [[], [100.0], [100.0, 200.0, 300.0]])
def test_entropy_similarity_properties(spark, mz):
    df = _p(spark, mz, [1.0] * len(mz)).withColumn("q", peaks.clean(F.col("p")))
    r = df.select(similarity.entropy_similarity(F.col("q"), F.col("q"), 0.01)).first()[0]
    assert r == pytest.approx(1.0 if mz else 0.0)


def test_slot_merge_equals_step_by_step(spark):
    rng = random.Random(5)
    rows_a, rows_b, want = [], [], {}
    slots, n = [2, 4, 9], 10
    for g in range(40):
        a, b = rng.sample(range(30), rng.randint(0, 12)), rng.sample(range(30), rng.randint(0, 12))
        rows_a += [(g, k, i + 1) for i, k in enumerate(a)]
        rows_b += [(g, k, i + 1) for i, k in enumerate(b)]
        new, base, out = [k for k in b if k not in a], list(a), []
        while len(out) < n and (new or base):
            take = new if (len(out) + 1 in slots and new) or not base else base
            out.append(take.pop(0))
        want |= {(g, k): i + 1 for i, k in enumerate(out)}
    a, b = (spark.createDataFrame(r, "g int, key int, rank int") for r in (rows_a, rows_b))
    assert {(r.g, r.key): r["rank"] for r in fuse.slot_merge(a, b, "g", "key", slots, n).collect()} == want


def test_network_rerank_keeps_protected_leader(spark):
    lists = spark.createDataFrame([(1, k, k) for k in range(1, 6)] + [(2, k, k) for k in range(1, 6)], "node int, key int, rank int")
    support = spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0)], "node int, key int, support double")
    out = network.rerank(lists, support, "node", 5.0, F.col("node") == 1).collect()
    first = {r.node: r.key for r in out if r["rank"] == 1}
    assert first == {1: 1, 2: 5} and len(out) == 10


def test_nearest_values_with_many_ties(spark):
    rng = random.Random(3)
    rows = [(i, float(v), g) for i, (v, g) in enumerate([(5, "a")] * 10 + [(rng.randrange(6), "b") for _ in range(40)] + [(1, "c")], 1)]
    got = {(r.key, r.rank): r.other for r in bandjoin.nearest_values(spark.createDataFrame(rows, "key long, v double, g string"), "key", "v", "g", 3).collect()}
    want = {}
    for key, v, g in rows:
        near = sorted((abs(v - w), other) for other, w, h in rows if h == g and other != key)[:3]
        want |= {(key, n): other for n, (_, other) in enumerate(near, 1)}
    assert got == want and [got[10, n] for n in (1, 2, 3)] == [1, 2, 3]


def test_correlation_of_constant_groups(spark):
    from ionloom.operators import evidence, rank

    rows = [("flat", 1, 2.0, 1.0), ("flat", 2, 2.0, 3.0), ("up", 1, 1.0, 2.0), ("up", 2, 2.0, 4.0), ("one", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, a double, b double")
    got = {r.g: r.r for r in df.groupBy("g").agg(evidence.safe_corr("a", "b").alias("r")).collect()}
    assert got["flat"] == 0 and got["one"] == 0 and abs(got["up"] - 1) < 1e-12
    names = {n: "b" for n in ("ap", "a1", "best", "top", "mean", "top_sim")}
    features = rank.ranker_features(df.withColumn("bits", F.lit(4)), ["g"], "k", "a", "b", "bits", "b", names)
    assert {(r.g, r.k): round(r.lib_corr, 9) for r in features.collect()} == {("flat", 1): 0, ("flat", 2): 0, ("up", 1): 1, ("up", 2): 1, ("one", 1): 0}


def test_pooled_rows_equal_pooled_arrays(spark):
    """Dense, sparse and repeated peaks, keys that begin late, runs of exactly the tolerance over the bounds of cells, and cells that the cluster before covers."""
    rng = random.Random(5)
    rows = [(g, round(rng.uniform(1, top), d), float(rng.randint(1, 9))) for g, n, top, d in (("a", 3000, 100, 4), ("b", 40, 900, 4), ("c", 500, 60, 1), ("d", 1, 50, 4)) for _ in range(n)]
    rows += [("e", 0.5 * i, 1.0 + i % 3) for i in range(200)] + [("f", 15.75, 2.0), ("f", 16.0, 1.0), ("f", 16.25, 3.0), ("f", 33.0, 1.0)] + [("g", 16.0 + x, 1.0) for x in (-0.25, 0.25, 0.5, 16.1)] + [("h", None, 1.0), ("h", 700.0, 4.0), ("i", 9.0, None), ("i", 9.1, 2.0)]
    df = spark.createDataFrame(rows, "g string, mz double, it double")
    arrays = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("mz", "it"))).alias("p")).select("g", F.explode(peaks.pool(F.col("p"), 0.5)).alias("c")).select("g", "c.mz", "c.it")
    plain = lambda x: sorted(map(tuple, x.collect()), key=str)
    found = plain(peaks.pooled(df, "g", 0.5, df))
    assert found == plain(arrays) and len(found) > 300
