"""Registered queries over readers, sinks, artifacts and output checks, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import _SQL_PEAKS, _SQL_POOL, _arrays, _long, _pool, _t, query
from .operators import peaks, split
from .sources import tables


def _tsv(spark, d) -> str:
    """Parts as a tab-separated file without header; every fifth line lacks its last field, every seventh its last two."""
    path = tables.scratch(spark, "tsv") + "/parts.tsv"
    p = _t(spark, d, "part")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), F.when((F.col("p_partkey") % 7 != 0) & (F.col("p_partkey") % 5 != 0), F.col("p_brand")))
    p.select(line.alias("value")).write.text(path)
    return path


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END AS name, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS address FROM part")
def short_rows(spark, d):
    """Lines that lack trailing fields."""
    return tables.read_short_rows(spark, _tsv(spark, d), ["id", "name", "address"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 <> 0")
def csv_columns(spark, d):
    """A delimited file with a header, some of its columns, rows without a required one left out."""
    path = tables.scratch(spark, "csv") + "/orders.tsv"
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", "o_totalprice")
    o.write.csv(path, header=True, sep="\t")
    return tables.read_columns(spark, path, {"o_orderkey": "bigint", "o_totalprice": "double", "o_custkey": "bigint"}, ["o_custkey"], "\t").drop("o_custkey")


@query("SELECT CAST(l_partkey AS VARCHAR) AS id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS items FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY l_partkey")
def joined_lines(spark, d):
    """Lists joined by commas in a tab-separated file, and back."""
    path = tables.scratch(spark, "tsv") + "/lists.tsv"
    lists = _t(spark, d, "lineitem").where("l_partkey % 2 = 0").groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("items"))
    tables.write_lines(lists, path, [F.col("l_partkey"), F.col("items")])
    return tables.read_short_rows(spark, path, ["id", "items"])


@query("SELECT o_orderstatus AS part, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, TRUE AS written, FALSE AS again, o_orderstatus <> 'P' AS verified FROM orders GROUP BY 1")
def resumed_batches(spark, d):
    """Batches written once and skipped when they are complete; one of them is then written anew, which the stored manifest shows."""
    path = tables.scratch(spark, "batches")
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    done = []
    for part in "FOP":  # a fixed list of batches
        rows = o.where(F.col("o_orderstatus") == part).drop("o_orderstatus")
        done.append((part, tables.write_parts(rows, f"{path}/rows", part), tables.write_parts(rows.limit(0), f"{path}/rows", part)))
    tables.manifest(spark, f"{path}/rows").write.parquet(f"{path}/manifest")
    o.where("o_orderstatus = 'P'").drop("o_orderstatus").orderBy("o_orderkey").write.mode("overwrite").parquet(f"{path}/rows/part=P")
    broken = tables.changed(spark.read.parquet(f"{path}/manifest"), tables.manifest(spark, f"{path}/rows")).select(F.regexp_extract("path", "/part=([^/]+)/", 1).alias("part")).distinct().withColumn("broken", F.lit(True))
    rows = spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = rows.join(F.broadcast(spark.createDataFrame(done, "part string, written boolean, again boolean")), "part").join(F.broadcast(broken), "part", "left")
    return rows.withColumn("verified", F.col("broken").isNull()).drop("broken")


@query("""WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i)
 SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x, 5) + 0.0 AS mean FROM c""")
def loaded_array(spark, d):
    """The mean vectors of the classes as an array artifact, one row for each class, and read back as rows."""
    path = tables.scratch(spark, "array") + ".npy"
    means = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").collect()  # a row for each class
    tables.save_array(spark, path, np.array([[float(r.label), *[v.x for v in r.v]] for r in rows]))
    loaded = tables.load_arrays(spark, path).select(F.col("values")[0].cast("int").alias("label"), F.posexplode(F.slice("values", 2, F.size("values") - 1)).alias("i", "x"))
    return loaded.select("label", "i", (F.round("x", 5) + 0.0).alias("mean"))


@query("SELECT o_custkey AS key, count(*) AS n, CAST(max(o_totalprice) AS DOUBLE) AS best FROM orders GROUP BY 1")
def dumped_stage(spark, d):
    """A stage dumped as JSON lines, read back, and not written again."""
    path = tables.scratch(spark, "stage")
    rows = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    tables.dump_stage(rows, path)
    return tables.dump_stage(rows.limit(0), path)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS items FROM customer")
def replaced_output(spark, d):
    """A safe first output for every id, then replaced as a whole."""
    path = tables.scratch(spark, "output")
    ids = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    tables.replace(ids.select("id", F.lit("none").alias("items")), path)
    tables.replace(ids.select("id", F.when(F.col("id") % 2 == 0, F.col("c_name")).otherwise("none").alias("items")), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name FROM nation")
def discovered_table(spark, d):
    """A table found by name; one that is missing adds nothing."""
    found = spark.read.parquet(tables.discover(spark, d, "nation.parquet")).select("n_nationkey", "n_name")
    return found.unionByName(tables.optional(spark, f"{d}/no such table.parquet", found.schema.simpleString()[7:-1].replace(":", " ")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 20)")
def first_orders(spark, d):
    """The rows of the first 20 ids; the limit is the operator."""
    return tables.first_ids(_t(spark, d, "lineitem"), "l_orderkey", 20).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY sha256('cap' || o_orderkey), o_orderkey LIMIT 100")
def capped_rows(spark, d):
    """A row cap over some sources; the limit is the operator."""
    return tables.capped(_t(spark, d, "orders").where("o_orderstatus in ('F', 'O')"), "o_orderkey", 100, "cap").select("o_orderkey")


@query("SELECT p_partkey AS sid, p_name || '/' || p_brand AS item FROM part WHERE p_retailprice BETWEEN 900 AND 950")
def string_window(spark, d):
    """The strings of a mass window are an ordinary column behind a pushed filter."""
    return _t(spark, d, "part").where("p_retailprice between 900 and 950").select(F.col("p_partkey").alias("sid"), F.concat_ws("/", "p_name", "p_brand").alias("item"))


@query(f"WITH {_SQL_PEAKS}, t AS (SELECT sid, max(it) AS top FROM pk GROUP BY sid) SELECT sid, CAST(count(*) AS BIGINT) AS n, round(min(mz), 6) AS lo, round(max(mz), 6) AS hi, 1.0 AS top, TRUE AS again, TRUE AS near FROM pk JOIN t USING (sid) GROUP BY sid, t.top")
def jittered_peaks(spark, d):
    """P20: noise repeats with its seed, leaves m/z alone, stays within its spread and is normalised again."""
    rows = _arrays(spark, d).withColumn("peaks", peaks.base_normalise(F.col("peaks")))
    rows = rows.withColumns({"x": peaks.jittered(F.col("peaks"), 5), "y": peaks.jittered(F.col("peaks"), 5)})
    its = lambda c: F.transform(c, lambda p: p["it"])
    near = F.forall(F.zip_with("x", "peaks", lambda a, b: F.abs(F.ln(a["it"] / b["it"])) < 2), lambda ok: ok)
    return rows.select("sid", F.size("x").cast("long").alias("n"), F.round(F.array_min(F.transform("x", lambda p: p["mz"])), 6).alias("lo"), F.round(F.array_max(F.transform("x", lambda p: p["mz"])), 6).alias("hi"), F.round(F.array_max(its("x")), 9).alias("top"), (F.to_json("x") == F.to_json("y")).alias("again"), near.alias("near"))


_SQL_OUT = """l AS (SELECT key AS g, CASE WHEN pid % 11 = 0 THEN NULL WHEN pid % 13 = 0 THEN ' ' ELSE CAST(pid % 40 AS VARCHAR) END AS item, row_number() OVER (PARTITION BY key ORDER BY pid) + CASE WHEN key % 6 = 0 THEN 1 ELSE 0 END AS rank FROM po WHERE key % 5 <> 0),
 ids AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_custkey % 9 <> 0), s AS (SELECT g, count(*) AS n, count(DISTINCT item) FILTER (trim(item) <> '') AS d, count(*) FILTER (item IS NULL OR trim(item) = '') AS blank, max(rank) AS last FROM l GROUP BY g)"""


@query(f"""WITH {_SQL_POOL}, {_SQL_OUT} SELECT 'missing_id' AS rule, count(*) AS broken FROM ids WHERE g NOT IN (SELECT g FROM s) UNION ALL SELECT 'unknown_id', count(*) FROM s WHERE g NOT IN (SELECT g FROM ids) UNION ALL SELECT 'too_long', count(*) FROM s WHERE n > 10
 UNION ALL SELECT 'duplicate_key', count(*) FROM s WHERE d < n - blank UNION ALL SELECT 'blank_key', count(*) FROM s WHERE blank > 0 UNION ALL SELECT 'rank_gap', count(*) FROM s WHERE last <> n""")
def output_checks(spark, d):
    """Q1, Q2: violations of the output contract, by rule."""
    p = _pool(spark, d).where("key % 5 <> 0")
    item = F.when(F.col("pid") % 11 == 0, F.lit(None)).when(F.col("pid") % 13 == 0, " ").otherwise((F.col("pid") % 40).cast("string"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("pid")) + F.when(F.col("key") % 6 == 0, 1).otherwise(0)
    lists = p.select(F.col("key").alias("g"), item.alias("item"), place.alias("rank"))
    ids = _t(spark, d, "orders").where("o_custkey % 9 <> 0").select(F.col("o_custkey").alias("g")).distinct()
    return split.check_lists(lists, ids, "g", "item", 10)
