import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ionloom.functions import isomers, isotopes
from ionloom.functions.chem import hill_formula, read_smiles
from ionloom.operators import peaks

SMILES = ["CCO", "CC(=O)C", "Cc1ccccc1O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "OC(=O)c1ccc(Cl)cc1", "c1ccc2c(c1)cc[nH]2", "CCCc1ccccc1", "c1ccccc1-c1ccccc1"]


@pytest.mark.parametrize("s", SMILES)
def test_written_graphs_read_back(s):
    g = read_smiles(s)
    back = read_smiles(isomers.write_smiles(g))
    assert hill_formula(*back[:2]) == hill_formula(*g[:2])
    assert isomers.skeleton_key(back) == isomers.skeleton_key(g)


@pytest.mark.parametrize("s", SMILES)
def test_isomers_keep_the_formula(s):
    g = read_smiles(s)
    made = isomers.isomers(g, 50)
    keys = [isomers.skeleton_key(x) for x in made]
    assert len(set(keys)) == len(keys) and isomers.skeleton_key(g) not in keys
    assert {hill_formula(*x[:2]) for x in made} <= {hill_formula(*g[:2])}
    assert len(isomers.isomers(g, 1)) <= 1


def test_known_isomers():
    key = lambda s: isomers.skeleton_key(read_smiles(s))
    of = lambda s: {isomers.skeleton_key(g) for g in isomers.isomers(read_smiles(s), 99)}
    assert {key("Cc1cccc(O)c1"), key("Cc1ccc(O)cc1")} <= of("Cc1ccccc1O")
    assert key("CC(C)c1ccccc1") in of("CCCc1ccccc1")
    assert key("C=C(O)C") in of("CC(=O)C") and key("CC(=O)C") in of("C=C(O)C")
    assert key("Cc1cccc(O)c1") not in {isomers.skeleton_key(g) for g in isomers.isomers(read_smiles("Cc1ccccc1O"), 99, frozenset({key("Cc1cccc(O)c1")}))}


def test_structure_udfs(spark):
    df = spark.createDataFrame([("CCO",), ("C(",), (None,)], "s string")
    a, b, c = df.select(isomers.graph_key("s").alias("k"), isomers.functional_groups("s").alias("g"), isomers.cleavage_masses("s").alias("m"), isomers.fragment_levels("s").alias("l"), isomers.isomer_lists(5)("s", F.array().cast("array<string>")).alias("i")).collect()
    assert a.g == ["hydroxyl"] and 46.042 in a.m and a.l[-1].level == 0 and all(x.formula == "C2H6O" for x in a.i)
    assert b.k is c.k is None and b.m is None and b.i == c.i == []


def test_fragment_scores_at_the_tolerance(spark, tmp_path):
    """Peaks that lie within 5 of a piece by less than a rounding of its mass to 5 decimals, or beyond it by less."""
    db = duckdb.connect()
    part, line = (str(tmp_path / f"{t}.parquet") for t in ("part", "lineitem"))
    db.execute(f"COPY (SELECT k AS p_partkey, 'b' AS p_brand, 't' AS p_type, CAST(s AS INTEGER) AS p_size, 900.0 AS p_retailprice FROM (VALUES (1, 3), (9, 6), (17, 7), (25, 0), (8, 4), (5, 5)) AS x(k, s)) TO '{part}' (FORMAT parquet)")
    db.execute(f"COPY (SELECT CAST(k AS BIGINT) AS l_partkey, CAST(p AS DOUBLE) AS l_extendedprice, CAST(q AS DOUBLE) AS l_quantity FROM (SELECT unnest([1, 9, 17, 25, 8, 5]) AS k), (VALUES (2202.6, 9), (4005.73, 7), (5005.73, 5), (6808.86, 4), (7808.86, 3), (10611.99, 8), (40000, 10)) AS x(p, q)) TO '{line}' (FORMAT parquet)")
    for t, p in (("part", part), ("lineitem", line)):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    want = sorted(db.execute(entry.oracle_sql()["fragment_scores"]).fetchall())
    assert len(want) == 6 and sorted(tuple(r) for r in entry.queries()["fragment_scores"](spark, str(tmp_path)).collect()) == want


def test_isotope_evidence(spark):
    df = spark.createDataFrame([([100.0, 150.0, 200.0, 201.997, 250.0], [0.2, 0.15, 1.0, 0.32, 0.05], 250.0), ([100.0, 150.0, 200.0, 201.998, 250.0], [0.2, 0.15, 1.0, 0.98, 0.05], 250.0)], "mz array<double>, it array<double>, p double")
    df = df.withColumn("x", peaks.make(F.col("mz"), F.col("it")))
    got = df.select(isotopes.has_element(F.col("x"), F.col("p"), "Cl"), isotopes.has_element(F.col("x"), F.col("p"), "Br")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True)]
    df = spark.createDataFrame([([150.0, 150.0 + 1.003355, 300.0], [1.0, 0.108, 0.1])], "mz array<double>, it array<double>").withColumn("x", peaks.make(F.col("mz"), F.col("it"))).withColumn("e", isotopes.carbon_estimates(F.col("x")))
    r = df.select("e", isotopes.carbon_consistency(F.lit("C15H10"), F.col("e")), isotopes.carbon_consistency(F.lit("C6H6"), F.col("e")), isotopes.envelope(F.lit("C15H10"), F.col("x"), F.lit(300.0))).first()
    assert len(r[0]) == 1 and abs(r[0][0] - 10) < 0.5 and r[1] > 0.95 and r[2] < 0.5 and r[3] == 1.0
    h = spark.range(1).select(isotopes.halogen_consistency(F.lit("C6H6"), F.lit(True), F.lit(False)), isotopes.halogen_consistency(F.lit("C6H5Cl"), F.lit(True), F.lit(False)), isotopes.halogen_consistency(F.lit("C6H5Br"), F.lit(False), F.lit(False))).first()
    assert tuple(h) == (1e-4, 1.0, 0.1)
    p = spark.range(1).select(isotopes.plausibility(F.create_map(F.lit("H2O"), F.lit(1.0)), F.array(F.lit("hydroxyl")), {"H2O": "hydroxyl"}), isotopes.plausibility(F.create_map(F.lit("H2O"), F.lit(1.0)), F.array(F.lit("amine")), {"H2O": "hydroxyl"})).first()
    assert p[0] == pytest.approx(1.15) and p[1] == pytest.approx(0.4)
