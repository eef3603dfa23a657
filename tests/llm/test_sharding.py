"""Sharding: the curve, the cuts, pruning, and the query against its SQL on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ionloom.llm import sharding as sh


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 3), (4, 1)])
def test_curve_visits_each_cell_next_to_the_last(spark, n, bits):
    side = 1 << bits
    points = spark.range(side**n).select(*[F.expr(f"cast(id / {side**i} as bigint) % {side}").cast("int").alias(f"c{i}") for i in range(n)])
    found = points.withColumn("at", sh.hilbert([F.col(f"c{i}") for i in range(n)], bits)).orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(side**n))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(found, found[1:], strict=False))


def documents(spark):
    rows = [(i, f"text {i % 50} " * (i % 40), ["en", "de", None][i % 3], f"s{i % 7}") for i in range(600)]
    rows += [(None, None, None, None), (None, None, None, None), (7, "", "", ""), (8, "é" * 100_000, "fr", "s1")] + [(9, "copy", "en", "s0")] * 300
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_sql_on_odd_rows(spark, tmp_path, empty):
    df = documents(spark).selectExpr("*", "1 AS shard", "2 AS size", "3 AS curve", "4 AS place")
    df.limit(0 if empty else 10_000).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, sh.op12_sharding(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(sh.ORACLE["op12_sharding"]).fetchall(), key=str)
    assert bool(got) != empty


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, law):
    rows, names = sh._measured(documents(spark))
    run = sh.ranked(sh.on_curve(rows, sh._BINS, sh.histogram(rows, sh._BINS)), ["curve", "text_crc32", names["doc_id"], "size"])
    found = sh.cut_runs(run, 16, law).select("shard", "slot", "size", "place").collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert len(found) == 904 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert sorted(r.place for r in found) == list(range(904))
    assert [r.shard for r in sorted(found, key=lambda r: r.place)] == sorted(r.shard for r in found)
    if law == "rows":
        assert {len(v) for v in by.values()} == {56, 57}
    else:  # no shard holds more than its share and one document
        share = sum(r.size for r in found) / 16
        assert all(sum(r.size for r in v) <= share + max(r.size for r in v) for v in by.values())


def test_copies_spread_over_tasks(spark):
    df = spark.range(40_000).selectExpr("1L AS doc_id", "'copy' AS text", "'en' AS lang", "'s' AS source")
    rows, names = sh._measured(df)
    run = sh.ranked(sh.on_curve(rows, sh._BINS, sh.histogram(rows, sh._BINS)).repartition(4), ["curve", "text_crc32", names["doc_id"], "size"])
    assert run.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (0, 39_999, 40_000)


def test_boxes_read_few_shards(spark, tmp_path):
    df = documents(spark).withColumn("curve_place", F.lit("mine"))
    path = str(tmp_path / "out")
    sh.write_shards(df, path, 16)
    assert spark.read.parquet(f"{path}/rows").count() == 904
    own = ["doc_id", "text", "lang", "source"]
    for box, rule in (({"size": (1, 1)}, "coalesce(octet_length(text), 0) = 0"), ({"lang": ["de"], "source": ["s3"]}, "lang = 'de' AND source = 's3'"), ({"lang": [None], "size": (100, 300)}, "lang IS NULL AND octet_length(text) BETWEEN 99 AND 299")):
        got = sh.read_box(spark, path, **box)
        want = df.where(rule).select(*own)
        assert want.count() and got.select(*own).exceptAll(want).isEmpty() and want.exceptAll(got.select(*own)).isEmpty()
    assert len(sh.shards_of_box(spark, path, lang=["de"], source=["s3"])) <= 6
    assert sh.shards_of_box(spark, path, lang=["nowhere"]) == []
