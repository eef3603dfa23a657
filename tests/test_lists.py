import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ionloom.operators import evidence, fuse, models, peaks

SF = "/root/testdata/sf0.001"


def test_gated_slots_equal_step_by_step(spark):
    rng, rows, want = random.Random(3), [], []
    for g in range(60):
        base, variants, filler = (rng.sample(range(20), rng.randint(0, 9)) for _ in range(3))
        slots = rng.sample(range(1, 11), rng.randint(0, 4))
        rows.append((g, base, variants, filler, slots))
        out, left = [], [list(base), list(variants), list(filler)]
        for at in range(1, 11):
            for source in ([left[1]] if at in slots else []) + left:
                while source and source[0] in out:
                    source.pop(0)  # a duplicate goes, the place stays free
                if source:
                    out.append(source.pop(0))
                    break
        want.append(out)
    df = spark.createDataFrame(rows, "g int, base array<int>, variants array<int>, filler array<int>, slots array<int>")
    got = fuse.gated_slots(df, "base", "variants", "filler", F.col("slots"), 10).orderBy("g").collect()
    assert [r["items"] for r in got] == want


def test_promotion(spark):
    lists = spark.createDataFrame([(g, k, k) for g in range(4) for k in (1, 2, 3)], "g int, key int, rank int")
    tiers = spark.createDataFrame([(0, 3, "gold", False), (1, 3, "silver", False), (2, 9, "gold", True), (3, 2, "none", False)], "g int, key int, tier string, protected boolean")
    got = {}
    for r in fuse.promote(lists, tiers, "g", "key", "protected").orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append(r.key)
    assert got == {0: [3, 1, 2], 1: [1, 3, 2], 2: [1, 9, 2, 3], 3: [1, 2, 3]}


def test_aligned_frames_must_hold_the_same_keys(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (2, 6)], "k int, b int")
    assert {tuple(r) for r in evidence.aligned([a, b], ["k"]).collect()} == {(1, 2, 5), (2, 3, 6)}
    with pytest.raises(Exception, match="different keys"):
        evidence.aligned([a, b.where("k = 1")], ["k"]).collect()


def test_reference_tiers(spark):
    rows = [(1, 7, 0.9, 5), (1, 6, 0.9, 5), (2, 7, 0.75, 3), (3, 7, 0.6, 3), (4, 7, 0.99, 2), (5, 7, 0.9, 3)]
    df = spark.createDataFrame(rows, "q int, key int, score double, matches int")
    got = {r.q: (r.key, r.tier) for r in evidence.reference_tiers(df, "q").collect()}
    assert got == {1: (6, "gold"), 2: (7, "silver"), 3: (7, "none"), 5: (7, "silver")}


def test_jitter_repeats_and_stays_close(spark):
    df = spark.createDataFrame([([100.0, 200.0], [0.5, 1.0])], "mz array<double>, it array<double>").withColumn("p", peaks.make(F.col("mz"), F.col("it")))
    a, b, c = df.select(peaks.jittered(F.col("p"), 1), peaks.jittered(F.col("p"), 1), peaks.jittered(F.col("p"), 2)).first()
    assert a == b != c and max(x.it for x in a) == 1.0 and abs(a[0].it - 0.5) < 0.3


def test_models_learn(spark):
    rows = [(i, float(i % 10), float(i % 3), 1.0 if i % 10 > 5 else 0.0, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a double, b double, y double, w double")
    for m in ([models.fit_logistic(df, ["a", "b"], "y")], models.fit_boosted(df, ["a", "b"], "y", "w", [1, 2], rounds=3, depth=2)):
        assert models.predict(df, m, ["a", "b"]).where("(p > 0.5) <> (y = 1)").count() == 0
    with pytest.raises(ValueError, match="missing features: c"):
        models.fit_logistic(df, ["a", "c"], "y")


def test_partitions_of_a_fit_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 50)
    df = spark.range(0, 1000, 1, 2).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 11 > 4 as double) y", "1.0D w")
    rows = models.dealt(df, ["a", "y", "w"])
    sizes = [len(x) for x in rows.rdd.glom().collect()]
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) <= 60
    at = [models.fit_boosted(x, ["a"], "y", "w", [1], rounds=2, depth=2)[0].toDebugString.split("\n")[1:] for x in (df, df)]
    assert at[0] == at[1]


def test_equal_rows_fit_as_all_rows(spark):
    df = spark.range(3000).selectExpr("cast(id % 7 as double) a", "cast(id % 3 as double) b", "cast(id % 11 > 4 as double) y").where("a < 6 or b > 0")
    few = models.equal_rows(df, ["a", "b", "y"], "n")
    assert few.count() <= 42 and few.agg(F.sum("n")).first()[0] == df.count()
    one, all_ = models.fit_logistic(few, ["a", "b"], "y", weight="n"), models.fit_logistic(df, ["a", "b"], "y")
    assert one.coefficients.toArray() == pytest.approx(all_.coefficients.toArray(), abs=1e-4) and one.intercept == pytest.approx(all_.intercept, abs=1e-4)


def test_cross_validated_choice(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.2), (1, 1, 0.3), (2, 0, 0.2), (2, 1, 0.8)], "fold int, w int, mrr double")
    got = {r.fold: r.w for r in models.cross_validated(df, "fold").collect()}
    assert got == {0: 1, 1: 0, 2: 0}


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline" and n not in entry.oracle_sql()])
def test_queries_without_sql_run(spark, name):
    """Fitted models: a probability for every row."""
    found = entry.queries()[name](spark, SF)
    assert found.count() > 0 and found.dropna().count() == found.count()
