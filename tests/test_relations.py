"""Peak matching as rows, band joins on dense values, and graphs, searches and models as relations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import bandjoin, peakjoin


def greedy(pairs):
    """The definition: pairs (k, l, r) in order, each if both its ends are free."""
    mine, theirs, out = set(), set(), set()
    for k, x, y in sorted(pairs):
        if x not in mine and y not in theirs:
            mine.add(x)
            theirs.add(y)
            out.add((x, y))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_rounds_give_the_greedy_matching(spark, rounds):
    rng = random.Random(5)
    rows = [(g, float(x), float(y), float(rng.randint(1, 4))) for g in range(12) for x in range(14) for y in range(14) if abs(x - y) <= 3 and rng.random() < 0.6]
    df = spark.createDataFrame(rows + rows[:20], "g int, x double, y double, p double")
    got = peakjoin.one_to_one(df, ["g"], "x", "y", [-F.col("p")], rounds).collect()
    for g in range(12):
        assert {(r.x, r.y) for r in got if r.g == g} == greedy([(-p, x, y) for h, x, y, p in rows if h == g])


def test_long_chain_and_many_peaks(spark):
    """100,000 peaks each side in which every pair waits for the next one: rounds alone would take as many."""
    n = 100_000
    a = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("mz"), (F.col("id") + 1.0).alias("it"))
    b = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") + 0.5).alias("ref"), (F.col("id") + 1.0).alias("ref_it"))
    near = peakjoin.tolerance_pairs(a, b, ["g"], "mz", "ref", 0.6).select("g", "mz", "ref", (F.col("it") * F.col("ref_it")).alias("p"))
    assert near.count() == 2 * n - 1
    got = peakjoin.one_to_one(near, ["g"], "mz", "ref", [-F.col("p")])
    assert got.count() == n and got.where("ref - mz <> 0.5").isEmpty()


def test_no_pairs(spark):
    df = spark.createDataFrame([], "g int, x double, y double, p double")
    assert peakjoin.one_to_one(df, ["g"], "x", "y", [-F.col("p")]).count() == 0


def test_dense_values_are_split(spark):
    left = spark.range(600).select(F.col("id").alias("l"), F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.col("id") / 3.0).alias("t"))
    right = spark.range(6_000).select(F.col("id").alias("r"), F.when(F.col("id") % 10 < 3, 500.0).otherwise((F.col("id") * 7919 % 6_000) / 20.0).alias("v"))
    bands = (F.col("t") - 0.02, F.col("t") + 0.02)
    a, b = bandjoin.dealt(left, right, *bands, "v", "l", "r", 64)
    cell = ["_r", "_x", "_y"]
    both = a.groupBy(*cell).agg(F.count("*").alias("n")).join(b.groupBy(*cell).agg(F.count("*").alias("m")), cell)
    n, m = both.agg(F.max("n"), F.max("m")).first()
    assert m <= 3.5 * 6_000 / 64 and n <= 6 * 600 / 64  # a third of all rows has one value
    got = {tuple(x) for x in bandjoin.ranged_join(left, right, *bands, "v", "l", "r", 64).select("l", "r").collect()}
    values = {}
    for r, v in right.collect():
        values.setdefault(v, []).append(r)
    want = {(x, r) for x, t in left.collect() for v in values if t - 0.02 <= v <= t + 0.02 for r in values[v]}
    assert got == want and len(got) > 300_000


def test_band_edges_nulls_and_groups(spark):
    left = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 2.0, 1.0, "a"), (3, None, 2.0, "a"), (4, -9.0, 99.0, "b")], "l int, lo double, hi double, g string")
    right = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, None, "a"), (4, 2.5, "a"), (5, 2.0, "b"), (6, 2.0, None)], "r int, v double, g string")
    for ranges in (1, 2, 50):
        got = bandjoin.ranged_join(left, right, F.col("lo"), F.col("hi"), "v", "l", "r", ranges, ["g"]).select("l", "r").collect()
        assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (4, 5)]


def spectra_of(spark, sets):
    rows = [(k, g, [(b, float(1 + (b + k) % 3)) for b in sorted(bins)]) for k, g, bins in sets]
    return spark.createDataFrame(rows, "id int, g string, v array<struct<bin:int,x:double>>")


def test_index_of_bins_misses_no_edge(spark, monkeypatch):
    from ionloom.operators import network

    rng = random.Random(8)
    sets = [(k, "ab"[k % 2], set(rng.sample(range(60), rng.randint(3, 20))) | ({1000, 1001} if k % 3 else set())) for k in range(160)]
    sets += [(500 + k, "a", set(range(2000, 2012))) for k in range(30)]  # copies
    df = spectra_of(spark, sets)
    want = {}
    for k, g, x in sets:
        for m, h, y in sets:
            if k != m and g == h and len(x & y) >= 6:
                a, b = ({q: float(1 + (q + n) % 3) for q in z} for n, z in ((k, x), (m, y)))
                w = sum(a[q] * b[q] for q in x & y) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
                if w >= 0.45:
                    want[k, m] = (len(x & y), round(w, 9))
    assert len(want) > 900
    for block in (4096, 7):  # with long postings whole, and dealt over a grid of blocks
        monkeypatch.setattr(network, "BLOCK", block)
        got = {(r.src, r.dst): (r.common, round(r.w, 9)) for r in network.binned_edges(df, "id", "g", "v", 0.45, 6).collect()}
        assert got == want
    bins = df.withColumn("b", F.col("v.bin"))
    for shared in (1, 3, 6):
        found = {tuple(r) for r in network.candidates(bins, "id", "g", "b", 6, shared).collect()}
        assert {p for p in want if p[0] < p[1]} <= found


def test_few_pairs_are_candidates(spark):
    """At the registered query's setting less than a twentieth of the pairs of an adduct are looked at."""
    from ionloom import catalog
    from ionloom.operators import network

    sf = "/root/testdata/sf0.01"
    v = catalog._peaks(spark, sf).groupBy("sid").agg(F.collect_set(F.floor(F.col("mz") / 2).cast("int")).alias("b")).join(catalog._spectra(spark, sf).select("sid", "adduct"), "sid")
    pairs = v.groupBy("adduct").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert 0 < network.candidates(v, "sid", "adduct", "b", 6).count() < 0.05 * pairs


def test_explained_levels_by_definition(spark):
    from ionloom.operators import peaks, similarity

    rng = random.Random(4)
    rows = []
    for i in range(40):
        mz = sorted({round(rng.uniform(10, 60), 2) for _ in range(rng.randint(0, 12))})
        masses = [[round(rng.uniform(10, 60), 2) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        rows.append((i, mz, [round(rng.uniform(1, 9), 2) for _ in mz], masses[0] + masses[0][:2], masses[1] if i else None))
    df = spark.createDataFrame(rows, "i int, mz array<double>, it array<double>, a array<double>, b array<double>").withColumn("p", peaks.make(F.col("mz"), F.col("it")))
    got = {r.i: r.s for r in df.select("i", similarity.explained_levels(F.col("p"), [(F.col("a"), 1.0), (F.col("b"), 0.5)], [1.0, -1.0], 0.5).alias("s")).collect()}
    for i, mz, it, a, b in rows:
        if b is None:
            assert got[i] is None
            continue
        best = [max([w for masses, w in ((a, 1.0), (b, 0.5)) if any(abs(m - c - x) <= 0.5 for x in masses for c in (1.0, -1.0))], default=0.0) for m in mz]
        whole = sum(x**0.5 for x in it)
        assert abs(got[i] - (sum(w * x**0.5 for w, x in zip(best, it, strict=True)) / whole if whole else 0.0)) < 1e-9


def test_trees_are_walked(spark):
    from ionloom.operators import ensembles

    trees = [(0, 1, "a", 0.5, None), (0, 2, None, None, 1.0), (0, 3, "b", 2.0, None), (0, 6, None, None, 10.0), (0, 7, None, None, 100.0), (1, 1, None, None, 0.25)]
    table = spark.createDataFrame(trees, ensembles.TREES)
    df = spark.createDataFrame([(0.5, 9.0), (0.6, 2.0), (0.6, 2.1), (None, None)], "a double, b double")
    assert [r.score for r in ensembles.scores(df, table, ["b", "a"], base=1000.0).collect()] == [1001.25, 1010.25, 1100.25, 1001.25]
    assert [r.score for r in ensembles.scores(df, table.limit(0), ["a"], base=2.0).collect()] == [2.0] * 4
    with pytest.raises(ValueError):
        ensembles.scores(df, table, ["a"])


def test_grown_trees_lessen_the_error(spark):
    from ionloom.operators import ensembles

    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.floor(F.col("id") / 20) % 2).cast("double").alias("b"), F.lit(3.0).alias("c"))
    df = df.withColumn("y", F.when(F.col("a") > 9.5, 5.0).otherwise(1.0) + F.when(F.col("b") > 0, 0.5).otherwise(0.0))
    trees, base = ensembles.boost(df, ["a", "b", "c"], "y", 3, 2, 1.0)
    left = ensembles.scores(df, trees, ["a", "b", "c"], "f", base).select(F.max(F.abs(F.col("y") - F.col("f")))).first()[0]
    assert left < 1e-6 and {r.feature for r in trees.collect()} <= {"a", "b", None}
    assert len(ensembles.grow(df.withColumn("k", F.lit(1.0)), ["c"], "k", 2)) == 1  # nothing splits a constant


def test_layers_keep_ids_without_values(spark):
    from ionloom.operators import layers

    ids = spark.createDataFrame([(1,), (2,)], "id int")
    values = spark.createDataFrame([(1, 0, 2.0), (1, 9, 5.0)], "id int, i int, x double")
    weights = spark.createDataFrame([(0, 0, 3.0), (0, 1, -1.0), (4, 1, 7.0)], "i int, o int, w double")
    bias = spark.createDataFrame([(0, 0.5), (1, 0.25)], "o int, b double")
    out = layers.linear(values, ids, weights, bias, "id")
    assert {(r.id, r.i): r.x for r in out.collect()} == {(1, 0): 6.5, (1, 1): -1.75, (2, 0): 0.5, (2, 1): 0.25}
    normed = {(r.id, r.i): round(r.x, 3) for r in layers.layer_norm(out, "id").collect()}
    assert normed == {(1, 0): 1.0, (1, 1): -1.0, (2, 0): 1.0, (2, 1): -1.0}


def test_newton_steps_end_at_the_optimum(spark):
    import numpy as np

    from ionloom.operators import models

    rng = random.Random(6)
    rows = [(i % 3, float(rng.random() < 0.3 + 0.4 * (i % 2)), float(i % 2), rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, y double, a double, b double")
    for k, w in enumerate(models.newton_folds(df, ["a", "b"], "y", "k", 3, ridge=0.5)):
        x = np.array([[1.0, a, b] for f, _, a, b in rows if f != k])
        y = np.array([y for f, y, _, _ in rows if f != k])
        p = 1 / (1 + np.exp(-x @ np.array(w)))
        assert np.abs(x.T @ (y - p) - 0.5 * np.array([0, *w[1:]])).max() < 1e-8


def test_large_strata_are_dealt(spark, monkeypatch):
    from ionloom.operators import network

    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 29).cast("double").alias("v"))
    score = lambda a, b: 1 / (1 + F.abs(F.col(f"{a}.v") - F.col(f"{b}.v")))
    want = sorted(map(tuple, network.edges(df, "id", "g", score, 0.5).collect()))
    monkeypatch.setattr(network, "NODES", 40)
    assert sorted(map(tuple, network.edges(df, "id", "g", score, 0.5).collect())) == want and len(want) > 4000


def test_clustered_layout(spark, tmp_path):
    from ionloom.sources import clustered

    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 100.0).when(F.col("id") % 50 != 1, F.col("id") / 10.0).alias("v"))
    path = str(tmp_path / "t")
    clustered.write_clustered(df, path, "v", "id", 20)
    bounds = spark.read.parquet(f"{path}/bounds")
    assert bounds.agg(F.sum("n")).first()[0] == 5000 and bounds.count() >= 15
    assert bounds.agg(F.max("n")).first()[0] < 1000  # a third of the rows has one value
    windows = spark.createDataFrame([(20.0, 20.5), (20.4, 21.0), (400.0, 400.0), (-5.0, -4.0)], "lo double, hi double")
    rows, share = clustered.read_windows(spark, path, "v", windows, 1.0)
    want = df.where("v between 20 and 21 or v = 400")
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in want.collect()) and share <= 0.25
    assert clustered.read_windows(spark, path, "v", windows.where("lo < 0"), 1.0)[0].count() == 0


def test_changed_files_are_told(spark, tmp_path):
    from ionloom.sources import tables

    at = str(tmp_path / "t")
    df = spark.range(10).withColumn("part", F.col("id") % 3)
    df.write.partitionBy("part").parquet(at)
    tables.manifest(spark, at).write.parquet(f"{at}-manifest")
    before = spark.read.parquet(f"{at}-manifest")
    assert before.count() and tables.changed(before, tables.manifest(spark, at)).isEmpty()
    df.where("part = 1").drop("part").coalesce(1).write.mode("overwrite").parquet(f"{at}/part=1")
    found = tables.changed(before, tables.manifest(spark, at)).collect()
    assert {r.what for r in found} == {"missing", "new"} and all("part=1" in r.path for r in found)


def test_grid_join_makes_every_pair_once(spark):
    a = spark.range(200).select(F.col("id").alias("x"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 5).alias("g"))
    b = spark.range(90).select(F.col("id").alias("y"), (F.col("id") % 2).alias("g"))
    want = sorted(map(tuple, a.join(b, "g").select("x", "y").collect()))
    for rows in (7, 1024):
        assert sorted(map(tuple, bandjoin.grid_join(a, b, ["g"], "x", "y", rows).select("x", "y").collect())) == want


def test_saved_boosters_as_tables(spark, tmp_path):
    from ionloom.operators import ensembles, models

    df = spark.range(500).selectExpr("cast(id % 23 as double) a", "cast(id % 7 as double) b", "cast((id % 23 > 9) != (id % 7 > 4) as double) y", "1.0D w")
    model = models.fit_boosted(df, ["a", "b"], "y", "w", [1], rounds=4, depth=3)
    model[0].write().save(str(tmp_path / "m"))
    trees = ensembles.saved_trees(spark, str(tmp_path / "m"), ["a", "b"])
    rows = ensembles.scores(models.predict(df, model, ["a", "b"]), trees, ["b", "a"], "s")
    assert trees.select("tree").distinct().count() == 4
    assert rows.select(F.max(F.abs(1 / (1 + F.exp(-2 * F.col("s"))) - F.col("p")))).first()[0] < 1e-9


def test_block_scores_meet_every_other_row_once(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8)).round(3)
    vectors[40:] = vectors[7]  # a large group of copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(60, None)], "i long, v array<double>").repartition(5)
    asked = rows.where("i % 7 = 0").withColumnRenamed("i", "q")
    score = lambda a, b: {"s": a @ b.T}
    want = {(q, i): vectors[q] @ vectors[i] for q in range(0, 60, 7) for i in range(60) if q != i}
    for sizes in ((512, 8192), (3, 7)):
        got = {(r.q, r.i): r.s for r in bandjoin.block_scores(asked, rows, "q", "i", "v", score, ["s"], None, *sizes).collect()}
        assert {k for k, v in got.items() if v is None} == {(q, 60) for q in range(0, 60, 7)}
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, v in got.items() if v is not None}
        led = bandjoin.block_scores(asked, rows, "q", "i", "v", score, ["s"], (4, 0.1), *sizes).withColumn("s", F.round("s", 1))
        best = {q: sorted((-round(float(v), 1), i) for (p, i), v in want.items() if p == q)[:4] for q in range(0, 60, 7)}
        found = {q: sorted((-r.s, r.i) for r in led.where(f"q = {q}").collect())[:4] for q in best}
        assert found == best


def test_copies_are_scored_once_and_lose_no_pair(spark):
    rows = [(i, 500.0, [1.0, 2.0]) for i in range(30)] + [(i, 500.0 + i % 3 * 0.015, [float(i)]) for i in range(30, 40)] + [(40, 700.0, [1.0])]
    df = spark.createDataFrame(rows, "sid long, m double, p array<double>").repartition(6)
    classes, members = bandjoin.in_classes(df, "sid", ["m", "p"])
    assert (classes.count(), members.count()) == (12, 41)
    pairs = bandjoin.class_pairs(classes, "m", F.col("m") - 0.02, F.col("m") + 0.02).where("rep < r_last").select("rep", "r_rep")
    assert pairs.where("rep = 0 and r_rep = 0").count() == 1
    got = sorted(map(tuple, bandjoin.expanded(pairs, members, "sid", "oid").select("sid", "oid").collect()))
    assert got == sorted((a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x - 0.02 <= y <= x + 0.02)


def test_adaptive_join_counts_each_target_once(spark):
    rng = random.Random(4)
    masses = [(i, 500 * (1 + rng.uniform(-700, 700) * 1e-6)) for i in range(30)]
    queries = [(i, 500.0 + i % 3 * 0.02) for i in range(9)]
    left, right = spark.createDataFrame(queries, "q long, t double"), spark.createDataFrame(masses, "i long, m double")
    found = bandjoin.adaptive_join(left, right, "t", "m", [50, 200, 600], 3, "q")
    inside = lambda t, p: {i for i, m in masses if t * (1 - p * 1e-6) <= m <= t * (1 + p * 1e-6)}
    tier = lambda t: next((p for p in (50, 200) if len(inside(t, p)) >= 3), 600)
    assert {(r.q, r.i, r.tier) for r in found.collect()} == {(q, i, float(tier(t))) for q, t in queries for i in inside(t, tier(t))}
    # pairs aren't sorted by query: the only window is over the queries
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_complementarity_over_blocks_equals_brute_force(spark, monkeypatch):
    from ionloom.operators import evidence

    monkeypatch.setattr(evidence, "SPECTRA", 4)
    rng = random.Random(3)
    sets = [(m, 100 * m + i, rng.sample(range(20), rng.randint(1, 8))) for m in range(3) for i in range(1 + 10 * m)]
    got = {r.m: r for r in evidence.complementarity(spark.createDataFrame(sets, "m long, s long, b array<int>"), "m", "s", "b").collect()}
    assert set(got) == {1, 2}
    for m, r in got.items():
        own = [set(b) for k, _, b in sets if k == m]
        pairs = [len(a & b) / len(a | b) for i, a in enumerate(own) for b in own[:i]]
        assert (r.spectra, r.pairs) == (len(own), len(pairs))
        assert r.jaccard == pytest.approx(sum(pairs) / len(pairs))
        assert r.complementarity == pytest.approx(len(set().union(*own)) / (sum(map(len, own)) / len(own)))


def test_blocking_never_broadcasts_exploded_keys(spark):
    from ionloom.operators import linkage

    df = spark.createDataFrame([(1, "ann b"), (2, "ann c")], "i long, n string")
    side = lambda c: df.select(F.col("i").alias(c), linkage.block_keys(F.col("n"), least=3).alias("keys"))
    out = linkage.block(side("l"), side("r"), "keys", "l", "r", {"token": 5}, F.col("l") != F.col("r"))
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 1)]
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_analogs_over_blocks_equal_pairs(spark, monkeypatch):
    from ionloom.operators import evidence

    monkeypatch.setattr(evidence, "ANALOGS", 5)
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.random() < 0.5 for _ in range(16)], i % 7 / 7) for i in range(40)] + [(40, 9, [True] * 16, 0.5)]
    got = {r.i: r for r in evidence.analogs_by_blocks(spark.createDataFrame(rows, "i long, g int, b array<boolean>, s double"), "i", "g", "b", "s").collect()}
    assert set(got) == set(range(40))
    for i, g, a, _ in rows[:40]:
        near = [(sum(x & y for x, y in zip(a, b, strict=True)) / (sum(x | y for x, y in zip(a, b, strict=True)) + 1e-9), s) for j, h, b, s in rows if h == g and j != i]
        want = [max(t * s**3 for t, s in near), max(t * s for t, s in near), max(t for t, _ in near), max(t * s**6 for t, s in near), sum(t * s for t, s in near) / sum(s for _, s in near)]
        assert [got[i].ts3, got[i].ts, got[i].t, got[i].ts6, got[i].t_mean] == [pytest.approx(x) for x in want]


def test_equal_bands_meet_the_other_side_once(spark, tmp_path):
    from ionloom.operators import bandjoin

    left = spark.range(1000).select(F.col("id").alias("sid"), (F.col("id") % 2).alias("g"), (500.0 + F.col("id") % 3).alias("m"))
    right = spark.range(2000).select(F.col("id").alias("pid"), (F.col("id") % 2).alias("g"), (500.0 + F.col("id") % 100 / 1000.0).alias("mass"))
    want = left.crossJoin(right.withColumnRenamed("g", "g2")).where("abs(mass - m) <= 0.0505 and g = g2").count()
    joins = [
        bandjoin.absolute_join(left, right, "m", "mass", 0.0505, ["g"]),
        bandjoin.bounds_join(left, right, F.col("m") - 0.0505, F.col("m") + 0.0505, "mass", 0.2, ["g"]),
        bandjoin.ranged_join(left, right, F.col("m") - 0.0505, F.col("m") + 0.0505, "mass", "sid", "pid", 8, ["g"]),
        bandjoin.ppm_join(left, right, "m", "mass", 101, ["g"]),
    ]
    for i, joined in enumerate(joins):
        assert sorted(joined.columns) == ["g", "m", "mass", "pid", "sid"]
        path = f"{tmp_path}/{i}"
        joined.select("sid", "pid").write.parquet(path)
        got = spark.read.parquet(path)
        assert got.count() == got.distinct().count() == want
        # rows of equal bands stand in a few lists that repeat: less than a byte for each pair
        assert sum(f.stat().st_size for f in (tmp_path / str(i)).glob("*.parquet")) < want


def test_pairs_are_products_of_blocks(spark, monkeypatch):
    from ionloom.operators import network, similarity

    monkeypatch.setattr(network, "SIDE", 30)
    monkeypatch.setattr(network, "STRIPE", 16)
    rng = random.Random(3)
    rows = [(k, k % 2, [rng.getrandbits(64) - (1 << 63)]) for k in range(200)] + [(200 + k, 0, [7]) for k in range(9)] + [(300, 0, [0]), (301, 0, None), (302, None, [7])]
    df = spark.createDataFrame(rows, "id long, g int, fp array<long>")
    tanimoto = lambda a, b: similarity.tanimoto(F.col(f"{a}.fp"), F.col(f"{b}.fp"))
    want = sorted(map(tuple, network.edges(df, "id", "g", tanimoto, 0.45).collect()))
    assert sorted(map(tuple, network.bit_edges(df, "id", "g", "fp", 0.45).collect())) == want and len(want) > 72
    right = df.select(F.col("id").alias("key"), "g", "fp")
    pairs = df.alias("a").join(right.alias("b"), F.col("a.g") == F.col("b.g")).select("a.id", "b.key", tanimoto("a", "b").alias("s")).where("s is not null")
    best = {}
    for r in pairs.collect():
        best.setdefault(r.id, []).append((-round(r.s, 9), r.key))
    got = {(r.id, r["rank"]): r.key for r in network.nearest_bits(df, right, "id", "key", "g", "fp", 5).collect()}
    assert got == {(i, n + 1): k for i, x in best.items() for n, (_, k) in enumerate(sorted(x)[:5])}
    # a few wide bins, SLICE of them at a time
    monkeypatch.setattr(network, "SLICE", 7)
    monkeypatch.setattr(network, "candidates", None)  # pairs of an index are no longer shuffled
    sets = [(k, "ab"[k % 2], set(rng.sample(range(40), 12))) for k in range(150)]
    v = spectra_of(spark, sets)
    found = {(r.src, r.dst): r.common for r in network.binned_edges(v, "id", "g", "v", 0.0, 6).collect()}
    assert found == {(k, m): len(x & y) for k, g, x in sets for m, h, y in sets if k != m and g == h and len(x & y) >= 6}


def test_cosines_are_ordered_where_they_are_made(spark, monkeypatch):
    from ionloom.operators import network

    left = spark.range(70).select("id", (F.col("id") % 3).alias("g"), F.array(F.col("id") % 5 - 2.0, F.col("id") % 7 - 3.0).alias("a"))
    right = spark.range(90).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"), F.array(F.col("id") % 4 - 1.0, F.col("id") % 6 - 2.0).alias("b"))
    ordered = network.ordered_cosines(left, right, "id", "key", "g", "a", "b")
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Window") == 0
    want = {}
    for i, g, a in left.collect():
        cos = [(-round(0.0 if not any(a) or not any(b) else (a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) * (b[0] ** 2 + b[1] ** 2)) ** 0.5, 9), k) for k, h, b in right.collect() if g == h]
        want |= {(i, n + 1): k for n, (_, k) in enumerate(sorted(cos))}
    assert {(r.id, r["rank"]): r.key for r in ordered.collect()} == want


def test_partitions_grow_with_a_table(spark, monkeypatch):
    from ionloom import catalog
    from ionloom.sources import tables

    monkeypatch.setattr(tables, "PART_ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), "id")
    rows = tables.together(df, df, "g")
    assert rows.rdd.getNumPartitions() == 10
    assert rows.select("g", F.spark_partition_id().alias("p")).distinct().count() == 50
    monkeypatch.setattr(tables, "PART_ROWS", 1000)
    assert "REPARTITION_BY_NUM" in catalog.queries()["window_quota_peaks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
