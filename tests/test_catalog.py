from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def rows(names, tuples):
    """Rows by column name; floats to six significant digits for the order only."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(None if r[i] is None else float(r[i]) if isinstance(r[i], (float, Decimal)) else str(r[i]) for i in order) for r in tuples]
    return sorted(plain, key=lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))


def same(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and (x != x and y != y or abs(x - y) <= 2e-6 * max(1.0, abs(x), abs(y))) for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))


#: Queries over neighbours in mass: rows are wanted there.
NEAR = ["library_search", "entropy_similarity", "greedy_cosine", "modified_cosines", "reference_tiers"]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name, sf="/root/testdata/sf0.01"):
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert name not in NEAR or len(got)
    found = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert same(rows(df.columns, got), rows(names, found.fetchall()))


def test_entry(spark):
    # no two prices of sf0.001 lie within the window
    found = entry.entry(spark)
    assert {"sid", "key", "score", "matches"} <= set(found.columns)
    assert found.count() == len(partners(SF)) == 0


def partners(sf):
    """(sid, key) of the spectra with peaks that have another of their polarity within 20 ppm; nowhere more than 25 keys."""
    db = duckdb.connect()
    part, line = (f"'{sf}/{t}.parquet'" for t in ("part", "lineitem"))
    got = db.execute(f"""WITH s AS (SELECT * FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {line}))
        SELECT DISTINCT a.p_partkey, b.p_brand || '/' || b.p_type FROM s a JOIN s b ON a.p_partkey <> b.p_partkey AND a.p_size % 2 = b.p_size % 2
        AND abs(b.p_retailprice - a.p_retailprice) <= a.p_retailprice * 20e-6""").fetchall()
    return set(got)


def test_library_search_partners(spark):
    sf = "/root/testdata/sf0.01"
    found = entry.queries()["library_search"](spark, sf).select("sid", "key").collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == partners(sf) != set()
