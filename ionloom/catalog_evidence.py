"""More registered queries: evidence over spectra, list algebra, peak features, models, sources. Importing it registers them.

Orders stand in for spectra of a customer (the molecule), their lines for scored candidates (l_suppkey, score l_discount).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import _SQL_FP, _SQL_LISTS, _SQL_PEAKS, _SQL_POOL, _SQL_SPECTRA, _SQL_TANI, _arrays, _lists, _long, _peaks, _pool, _spectra, _t, query
from .functions import chem
from .operators import bandjoin, evidence, fuse, linkage, models, pairblocks, peaks, rank, similarity
from .sources import tables


def _scores(spark, d):
    """(mol, spectrum, cand, score)."""
    lines = _t(spark, d, "lineitem")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum"), F.col("o_custkey").alias("mol"))
    li = lines.select(F.col("l_orderkey").alias("spectrum"), F.col("l_suppkey").alias("cand"), F.col("l_discount").alias("score"))
    rows = tables.together(li, lines, "spectrum").join(tables.together(o, lines, "spectrum"), "spectrum")
    # a molecule's rows stay where they are for all that follows
    return tables.together(rows, lines, "mol").groupBy("mol", "spectrum", "cand").agg(F.max("score").alias("score"))


_SQL_SCORES = "sc AS (SELECT o_custkey AS mol, o_orderkey AS spectrum, l_suppkey AS cand, max(l_discount) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"
_SQL_CE = "CASE WHEN ce BETWEEN 30 AND 45 THEN 1.25 WHEN ce BETWEEN 50 AND 70 THEN 1.0 WHEN ce BETWEEN 10 AND 25 THEN 0.75 ELSE 1.0 END"


@query(f"""WITH {_SQL_SCORES}, n AS (SELECT mol, spectrum, count(*) AS n, max(score) - median(score) AS m FROM sc GROUP BY ALL), c AS (SELECT n.*, o_totalprice / 5000 AS ce FROM n JOIN orders ON o_orderkey = spectrum),
 w AS (SELECT mol, spectrum, 1.0 / count(*) OVER p AS w_uniform, sqrt(n) / sum(sqrt(n)) OVER p AS w_root, {_SQL_CE} * sqrt(n) / sum({_SQL_CE} * sqrt(n)) OVER p AS w_energy, exp(m / 0.5) / sum(exp(m / 0.5)) OVER p AS margin_w FROM c WINDOW p AS (PARTITION BY mol))
 SELECT mol, cand, round(sum(score * w_uniform) + 1e-9, 6) AS w_uniform, round(sum(score * w_root) + 1e-9, 6) AS w_root, round(sum(score * w_energy) + 1e-9, 6) AS w_energy, round(sum(score * margin_w) + 1e-9, 6) AS margin_w FROM sc JOIN w USING (mol, spectrum) GROUP BY ALL""")
def spectral_fusion(spark, d):
    """G1, G2, G6."""
    s = _scores(spark, d)
    lines = _t(spark, d, "lineitem")
    o = tables.together(_t(spark, d, "orders").select(F.col("o_orderkey").alias("spectrum"), F.array(F.col("o_totalprice") / 5000).alias("ce")), lines, "spectrum")
    n = tables.together(s.groupBy("mol", "spectrum").agg(F.count("*").alias("n")), lines, "spectrum").join(o, "spectrum")
    n = tables.together(n, lines, "mol")
    w = n.withColumn("w_uniform", 1 / F.count("*").over(Window.partitionBy("mol")))
    w = evidence.spectrum_weights(w, "mol", F.lit(1.0), "n", "w_root")
    w = evidence.spectrum_weights(w, "mol", peaks.ce_weight(F.col("ce")), "n", "w_energy")
    w = w.join(evidence.margin_weights(s, "mol", "spectrum", "score"), ["mol", "spectrum"])
    names = ["w_uniform", "w_root", "w_energy", "margin_w"]
    out = evidence.fuse_spectra(s, w, "mol", "spectrum", "cand", "score", names)
    return out.select("mol", "cand", *[F.round(F.col(x) + 1e-9, 6).alias(x) for x in names])


@query(f"""WITH {_SQL_SCORES}, n AS (SELECT mol, count(DISTINCT spectrum) AS n FROM sc GROUP BY mol), e AS (SELECT mol, cand, max(score) AS best, sum(score) / n AS mean, count(*) AS hits FROM sc JOIN n USING (mol) WHERE score > 0.05 GROUP BY mol, cand, n)
 SELECT DISTINCT s.mol, s.cand, coalesce(best, 0) AS best, round(coalesce(mean, 0) + 1e-9, 6) AS mean, coalesce(hits, 0) AS hits FROM sc s LEFT JOIN e ON e.mol = s.mol AND e.cand = s.cand""")
def evidence_scatter(spark, d):
    """Hits above 0.05."""
    s = _scores(spark, d)
    n = s.groupBy("mol").agg(F.count_distinct("spectrum").alias("n_spectra"))
    e = evidence.scatter(s.where("score > 0.05"), "mol", "spectrum", "cand", "score", n)
    out = evidence.with_evidence(s.select("mol", "cand").distinct(), e, ["mol", "cand"], ["best", "mean", "hits"])
    return out.select("mol", "cand", "best", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "hits")


@query(f"""WITH {_SQL_FP}, p AS (SELECT a.vec_id AS q, c.vec_id AS vec_id, {_SQL_TANI} / (list_sum(a.b) + list_sum(c.b) - {_SQL_TANI} + 1e-9) AS t, (c.vec_id % 97) / 97.0 AS s FROM fp a JOIN fp c ON a.label = c.label AND a.vec_id <> c.vec_id)
 SELECT q, round(max(t * pow(s, 3)), 6) AS ts3, round(max(t * s), 6) AS ts, round(max(t), 6) AS t, round(max(t * pow(s, 6)), 6) AS ts6, round(sum(t * s) / sum(s), 6) AS t_mean FROM p GROUP BY q""")
def analog_features(spark, d):
    """A4."""
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x > 0).alias("bits"), (F.col("vec_id") % 97 / 97.0).alias("s"))
    out = evidence.analogs_by_blocks(e, "vec_id", "label", "bits", "s").withColumnRenamed("vec_id", "q")
    return out.select("q", *[F.round(c, 6).alias(c) for c in ("ts3", "ts", "t", "ts6", "t_mean")])


@query(f"""WITH {_SQL_POOL}, w AS (SELECT pid, mass, count(*) OVER g AS size, count(*) OVER (PARTITION BY key) AS n, max(mass) OVER g AS top, avg(mass) OVER g AS mu, stddev_samp(mass) OVER g AS sd, rank() OVER o - 1 + (count(*) OVER (PARTITION BY key, formula, mass) - 1) / 2 AS r, nth_value(mass, 2) OVER (PARTITION BY key, formula ORDER BY mass DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM po WINDOW g AS (PARTITION BY key, formula), o AS (PARTITION BY key, formula ORDER BY mass DESC))
 SELECT pid, size, round(size / n, 6) AS share, round(mass - top, 5) AS gap, round(CASE WHEN sd > 1e-9 THEN (mass - mu) / sd ELSE 0 END, 5) AS z, round(r / greatest(size - 1, 1), 6) AS rank_avg, round(CASE WHEN size > 1 THEN top - second ELSE 0 END, 5) AS lead FROM w""")
def group_confidence(spark, d):
    """A10."""
    out = evidence.confidence_features(_pool(spark, d), "key", "formula", "mass")
    return out.select("pid", "size", F.round("share", 6).alias("share"), F.round("gap", 5).alias("gap"), F.round("z", 5).alias("z"), F.round("rank_avg", 6).alias("rank_avg"), F.round("lead", 5).alias("lead"))


@query("""WITH x AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 1.2 ELSE 1.0 END::DOUBLE AS w, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS r(i)) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(sum(w * x) / sum(w), 5) + 0.0 AS mean FROM x GROUP BY label, i""")
def weighted_vector_mean(spark, d):
    """A11, A12."""
    e = _t(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = evidence.weighted_vectors(e, "label", "embedding", F.when(F.col("vec_id") % 3 == 0, 1.2).otherwise(1.0))
    return out.select("label", "i", (F.round("mean", 5) + 0.0).alias("mean"))


@query("""SELECT l_suppkey, round(CASE WHEN count(*) < 2 OR stddev_pop(l_quantity) <= 1e-9 OR stddev_pop(l_discount) <= 1e-9 THEN 0 ELSE corr(l_quantity, l_discount) END, 5) + 0.0 AS r FROM lineitem GROUP BY l_suppkey""")
def score_rank_corr(spark, d):
    """A21."""
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg((F.round(evidence.safe_corr("l_quantity", "l_discount"), 5) + 0.0).alias("r"))


@query(f"""WITH {_SQL_POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mass DESC, pid) AS n FROM po), b AS (SELECT *, (pid * 7919) % 10007 AS full_score FROM a WHERE n <= 500), c AS (SELECT * FROM b WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
 k AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY full_score DESC, pid) AS u FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY full_score DESC, pid) AS rank FROM k WHERE u = 1)
 SELECT source, pid, key, CAST(full_score AS BIGINT) AS full_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""")
def two_pass_topk(spark, d):
    """A cheap score's best 500, then the full score, new keys only, each once, the best 30."""
    few = rank.top_k(_pool(spark, d), ["source"], [F.desc("mass"), F.asc("pid")], 500, "n").withColumn("full_score", F.col("pid") * 7919 % 10007)
    held = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    out = rank.keep_first(few.join(held, "key", "left_anti"), ["source"], "key", [F.desc("full_score"), F.asc("pid")])
    return out.where("rank <= 30").select("source", "pid", "key", "full_score", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE isfinite(o_totalprice)")
def mass_order(spark, d):
    """T3."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice is not null and not isnan(o_totalprice) and abs(o_totalprice) < double('inf')")
    return o.repartitionByRange("o_totalprice").sortWithinPartitions("o_totalprice", "o_orderkey")


@query()
def gated_slots(spark, d):
    """Held against a step-by-step merge in tests."""
    a, b = _lists(spark, d)
    packed = [x.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda r: r["key"]).alias(n)) for x, n in ((a.where("rank <= 20"), "base"), (b.where("rank <= 10"), "variants"), (b, "filler"))]
    rows = packed[0].join(packed[1], "g").join(packed[2], "g")
    slots = fuse.slot_choice(F.col("g") % 10 / 10, F.lit(None).cast("double"), F.when(F.col("g") % 5 == 0, 0.9), 0.5, 0.0, 0.85, [2, 4, 5, 6], [9, 12])
    out = fuse.gated_slots(rows.withColumn("slots", slots), "base", "variants", "filler", F.col("slots"), 25)
    return out.select("g", F.posexplode("items").alias("p", "key")).select("g", (F.col("p") + 1).alias("rank"), "key")


@query(f"""WITH {_SQL_LISTS}, l AS (SELECT g, max(key) AS key FROM a GROUP BY g), u AS (SELECT g, key, rank AS r FROM a WHERE (g, key) NOT IN (SELECT g, key FROM l) UNION ALL SELECT g, key, 1.5 FROM l), i AS (SELECT g, key, row_number() OVER (PARTITION BY g ORDER BY r, key) AS rank FROM u),
 h AS (SELECT *, max(CASE WHEN rank = 2 AND key % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS s FROM i) SELECT g, key, CAST(CASE WHEN s = 1 AND rank <= 2 THEN 3 - rank ELSE rank END AS INTEGER) AS rank FROM h""")
def insert_and_swap(spark, d):
    """The largest key goes to rank 2, then an even one there to rank 1."""
    a, _ = _lists(spark, d)
    leader = a.groupBy("g").agg(F.max("key").alias("key"))
    return fuse.swap_first_two(fuse.insert_at(a, leader, "g", "key", 2), "g", F.col("key") % 2 == 0, "key").select("g", "key", "rank")


@query("""SELECT o_custkey AS k, 'both' AS kind FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O'
 UNION ALL (SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'O')""")
def set_algebra(spark, d):
    """L9."""
    o = _t(spark, d, "orders")
    f, x = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersect(x).withColumn("kind", F.lit("both")).unionByName(f.subtract(x).withColumn("kind", F.lit("only")))


@query(f"""WITH {_SQL_PEAKS}, {_SQL_SPECTRA}, w AS (SELECT sid, mz, sqrt(it) * pow(greatest(mz, 10) / precursor, 0.25) * CASE WHEN mz < 50 THEN 0.5 ELSE 1 END AS v FROM pk JOIN sp USING (sid)) SELECT sid, round(mz, 6) AS mz, round(v / sum(v) OVER (PARTITION BY sid), 6) AS it FROM w""")
def diagnostic_weights(spark, d):
    """P13, P19."""
    rows = _arrays(spark, d).join(_spectra(spark, d), "sid")
    checked = peaks.make(F.col("peaks.mz"), F.col("peaks.it"))
    return _long(rows.withColumn("peaks", checked).withColumn("peaks", peaks.diagnostic_weights(F.col("peaks"), F.col("precursor"))), "sid")


@query(f"""WITH {_SQL_PEAKS}, {_SQL_SPECTRA}, f AS (SELECT sid, mz, it / max(it) OVER (PARTITION BY sid) AS it, precursor, row_number() OVER (PARTITION BY sid ORDER BY mz) - 1 AS i FROM pk JOIN sp USING (sid)), g AS (SELECT DISTINCT f.sid, s.i FROM f, (SELECT unnest(range(0, 24)) AS i) s)
 SELECT g.sid, CAST(g.i AS INTEGER) AS i, round(coalesce(mz / 1000, 0), 8) AS a, round(coalesce(sqrt(it), 0), 8) AS b, round(coalesce(ln(1 + 100 * it) / ln(101), 0), 8) AS c, round(coalesce((precursor - mz) / 1000, 0), 8) + 0.0 AS e FROM g LEFT JOIN f ON f.sid = g.sid AND f.i = g.i""")
def peak_tensor(spark, d):
    """P14."""
    rows = _arrays(spark, d).join(_spectra(spark, d), "sid")
    x = rows.select("sid", F.posexplode(peaks.tensor(peaks.base_normalise(F.col("peaks")), F.col("precursor"), 24)).alias("i", "x"))
    return x.select("sid", "i", *[(F.round(F.col("x")[k], 8) + 0.0).alias(n) for k, n in enumerate("abce")])


@query(f"""WITH {_SQL_SPECTRA} SELECT sid, round(precursor / 1000, 6) AS m, CASE WHEN sid % 5 = 0 THEN 0 ELSE least(500, sid % 700) / 100 END AS e, CASE WHEN sid % 5 = 0 THEN 0.0 ELSE 1.0 END AS known, CASE WHEN pol = 1 THEN 1.0 WHEN sid % 3 = 0 THEN -1.0 ELSE 1.0 END AS sign FROM sp""")
def spectrum_metadata(spark, d):
    """P15."""
    s = _spectra(spark, d)
    x = peaks.metadata(F.col("precursor"), F.when(F.col("sid") % 5 != 0, (F.col("sid") % 700).cast("double")), F.when(F.col("pol") == 1, 1), F.when(F.col("sid") % 3 == 0, F.lit("[M-H]-")).otherwise("[M+H]+"))
    return s.withColumn("x", x).select("sid", F.round(F.col("x")[0], 6).alias("m"), F.col("x")[1].alias("e"), F.col("x")[2].alias("known"), F.col("x")[3].alias("sign"))


@query(f"""WITH {_SQL_PEAKS}, {_SQL_SPECTRA}, a AS (SELECT sid, mol, ['[M+NH4]+', '[M-H2O+H]+', '[M+Na]+'][1 + sid % 3] AS adduct, precursor FROM sp WHERE pol = 1), s AS (SELECT sid, mol, CASE WHEN adduct = '[M+NH4]+' THEN precursor - 17.026549 ELSE precursor END AS precursor FROM a WHERE adduct <> '[M+Na]+'),
 k AS (SELECT s.sid, mol, precursor, count(*) AS n FROM s JOIN pk ON pk.sid = s.sid AND mz <= precursor + 0.5 GROUP BY ALL), base AS (SELECT s.sid, mol, precursor, n FROM sp s JOIN (SELECT sid, count(*) AS n FROM pk GROUP BY sid) USING (sid) WHERE s.sid % 4 = 0)
 SELECT sid, mol, round(precursor, 6) AS precursor, n FROM base UNION ALL SELECT sid, mol, round(precursor, 6), n FROM k WHERE mol NOT IN (SELECT mol FROM base)""")
def adduct_surrogates(spark, d):
    """Surrogate spectra of molecules that the base (sid divisible by 4) lacks."""
    s = _spectra(spark, d).join(_arrays(spark, d), "sid")
    kinds = F.array(*[F.lit(x) for x in ("[M+NH4]+", "[M-H2O+H]+", "[M+Na]+")])
    made = peaks.surrogates(s.withColumn("adduct", F.element_at(kinds, (1 + F.col("sid") % 3).cast("int"))), "pol", "adduct", "precursor", "peaks")
    columns = ["sid", "mol", "precursor", "peaks"]
    out = peaks.extend(s.where("sid % 4 = 0").select(columns), made.select(columns), "mol", "gap")
    return out.select("sid", "mol", F.round("precursor", 6).alias("precursor"), F.size("peaks").cast("long").alias("n"))


@query()
def reference_tiers(spark, d):
    """Neighbours in mass by nearest-peak cosine, tiers, and the promoted lists."""
    rows, w = _spectra(spark, d).where("precursor > 0").select("sid", "precursor", "pol"), 6.0 * 1e-6
    cells = pairblocks.near_blocks(rows, "sid", "precursor", F.col("precursor") * (1 - w), F.col("precursor") * (1 + w), ["pol"])
    found = pairblocks.references(cells, _arrays(spark, d), "sid", 2.0, 3, 10, ["pol"])
    tiers = evidence.reference_tiers(found.where("best is not null").select("sid", "best.*"), "sid", (0.5, 4), (0.3, 3))
    lists = found.select("sid", F.posexplode("keys").alias("rank", "key")).select("sid", "key", (F.col("rank") + 1).alias("rank"))
    gate = tiers.join(found.select("sid", F.col("top").alias("library_max")), "sid", "left").withColumn("protected", F.coalesce(F.col("library_max") >= 0.85, F.lit(False)))
    return fuse.promote(lists, gate, "sid", "key", "protected")


@query(f"""WITH {_SQL_PEAKS}, {_SQL_SPECTRA}, p AS (SELECT sid, mz, sqrt(it) AS r, precursor, greatest(CASE WHEN least(abs(mz - 1.5 - (precursor - 18)), abs(mz + 1.5 - (precursor - 18)), abs(mz - 1.5 - 500), abs(mz + 1.5 - 500)) <= 6 THEN 1.0 ELSE 0 END, CASE WHEN least(abs(mz - 1.5 - precursor / 2), abs(mz + 1.5 - precursor / 2), abs(mz - 1.5 - 300), abs(mz + 1.5 - 300)) <= 6 THEN 0.5 ELSE 0 END) AS w FROM pk JOIN sp USING (sid))
 SELECT sid, round(sum(r * w) / sum(r) + 1e-9, 6) AS score FROM p GROUP BY sid""")
def explained_levels(spark, d):
    """Two levels of masses, carriers of 1.5 either way."""
    s = _spectra(spark, d).join(_arrays(spark, d), "sid")
    levels = [(F.array(F.col("precursor") - 18, F.lit(500.0)), 1.0), (F.array(F.col("precursor") / 2, F.lit(300.0)), 0.5)]
    return s.select("sid", F.round(similarity.explained_levels(F.col("peaks"), levels, [1.5, -1.5], 6.0) + 1e-9, 6).alias("score"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n, coalesce(first, -1) AS first FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def filled_output(spark, d):
    """Counts and first orders computed apart, laid side by side, joined to all customers with fillers."""
    o = _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").groupBy("c_custkey")
    side = evidence.aligned([o.agg(F.count("*").alias("n")), o.agg(F.min("o_orderkey").alias("first"))], ["c_custkey"])
    return evidence.with_evidence(_t(spark, d, "customer").select("c_custkey"), side, ["c_custkey"], ["n"]).join(side.select("c_custkey", "first"), "c_custkey", "left").select("c_custkey", "n", F.coalesce("first", F.lit(-1)).alias("first"))


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS key, o_totalprice AS a, o_orderkey * 7919 % 101 AS b FROM orders), r AS (SELECT g, key, a, (row_number() OVER (PARTITION BY g ORDER BY a DESC, key) - 1) / greatest(count(*) OVER (PARTITION BY g) - 1, 1) AS ra, (row_number() OVER (PARTITION BY g ORDER BY b DESC, key) - 1) / greatest(count(*) OVER (PARTITION BY g) - 1, 1) AS rb FROM o)
 SELECT g, key, round(0.7 * (1 - ra) + 0.3 * (1 - rb) + 1e-6 * a, 9) AS score FROM r""")
def two_ranker_blend(spark, d):
    """R1."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("a"), (F.col("o_orderkey") * 7919 % 101).alias("b"))
    return fuse.blend(o, "g", "a", "b", 0.7, "key").select("g", "key", F.round("score", 9).alias("score"))


_SQL_RANKED = "a0 AS (SELECT o_custkey AS g, o_orderkey AS key, o_orderstatus AS f, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


def _ranked(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("f"), F.col("o_totalprice").alias("s"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "key")))


@query(f"""WITH {_SQL_RANKED}, v AS (SELECT *, CASE WHEN stddev_pop(s) OVER p > 1e-9 THEN (s - avg(s) OVER p) / stddev_pop(s) OVER p ELSE 0 END + 0.8 * ln(1 + key % 11) AS v FROM a0 WHERE key % 3 <> 0 WINDOW p AS (PARTITION BY g)),
 o AS (SELECT g, key, row_number() OVER (PARTITION BY g ORDER BY v DESC, rank) AS i FROM v), t AS (SELECT g, rank, row_number() OVER (PARTITION BY g ORDER BY rank) AS i FROM a0 WHERE key % 3 <> 0)
 SELECT o.g, o.key, CAST(t.rank AS INTEGER) AS rank FROM o JOIN t ON o.g = t.g AND o.i = t.i UNION ALL SELECT g, key, CAST(rank AS INTEGER) FROM a0 WHERE key % 3 = 0""")
def popularity_reorder(spark, d):
    """Items whose key isn't divisible by 3 are the pool."""
    rows = _ranked(spark, d).withColumns({"pool": F.col("key") % 3 != 0, "pop": F.log1p((F.col("key") % 11).cast("double"))})
    return fuse.popularity_reorder(rows, "g", "pool", "s", "pop", 0.8, "key").select("g", "key", "rank")


@query(f"""WITH {_SQL_RANKED}, x AS (SELECT *, CASE WHEN key % 5 > 0 THEN (key % 13)::DOUBLE END AS x1 FROM a0), h AS (SELECT * FROM x WHERE x1 IS NOT NULL),
 v AS (SELECT *, round(CASE WHEN stddev_pop(s) OVER p > 1e-9 THEN (s - avg(s) OVER p) / stddev_pop(s) OVER p ELSE 0 END + 2 * CASE WHEN stddev_pop(x1) OVER p > 1e-9 THEN (x1 - avg(x1) OVER p) / stddev_pop(x1) OVER p ELSE 0 END, 9) AS v FROM h WINDOW p AS (PARTITION BY g, f)),
 o AS (SELECT g, f, key, row_number() OVER (PARTITION BY g, f ORDER BY v DESC, rank) AS i FROM v), t AS (SELECT g, f, rank, row_number() OVER (PARTITION BY g, f ORDER BY rank) AS i FROM h)
 SELECT o.g, o.key, CAST(t.rank AS INTEGER) AS rank FROM o JOIN t ON o.g = t.g AND o.f = t.f AND o.i = t.i UNION ALL SELECT g, key, CAST(rank AS INTEGER) FROM x WHERE x1 IS NULL""")
def formula_rerank(spark, d):
    """R4, R5, R6, R9."""
    rows = _ranked(spark, d).withColumn("x1", F.when(F.col("key") % 5 > 0, (F.col("key") % 13).cast("double")))
    return fuse.group_rerank(rows, "g", "f", "s", [("x1", 2.0)], "key").select("g", "key", "rank")


@query("""WITH r AS (SELECT o_custkey AS g, o_orderkey AS key, o_orderstatus AS f, o_orderkey % 4 = 0 AS p, o_totalprice AS x, (o_orderkey % 17)::DOUBLE AS y FROM orders), b AS (SELECT g, f, max(x) AS bx, max(y) AS byy FROM r WHERE NOT p GROUP BY g, f)
 SELECT r.g, key, round(least(x - bx, y - byy), 4) AS margin FROM r LEFT JOIN b ON b.g = r.g AND b.f = r.f WHERE p""")
def forward_margin(spark, d):
    """R7."""
    r = _ranked(spark, d).select("g", "key", "f", (F.col("key") % 4 == 0).alias("p"), F.col("s").alias("x"), (F.col("key") % 17).cast("double").alias("y"))
    return fuse.forward_margin(r, "g", "f", "p", ["x", "y"]).select("g", "key", F.round("margin", 4).alias("margin"))


@query("""WITH m AS (SELECT o_custkey AS g, max(o_totalprice) / 500000 AS lib FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), i AS (SELECT DISTINCT o_custkey AS g, o_orderkey % 50 AS key, o_totalprice AS s FROM orders WHERE o_orderstatus = 'O'),
 h AS (SELECT i.*, max(s) OVER (PARTITION BY i.g) AS b FROM i LEFT JOIN m USING (g) WHERE coalesce(lib, 0) < 0.85), k AS (SELECT g, key, max(s) AS s FROM h WHERE s >= b - 200000 GROUP BY g, key), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, key) AS rank FROM k)
 SELECT g, key, CAST(rank AS INTEGER) AS rank, true AS injected FROM r WHERE rank <= 3""")
def injection(spark, d):
    """R11, R12."""
    o = _ranked(spark, d)
    gate = evidence.library_max(o.withColumn("x", F.col("s") / 500000), "g", "x", F.col("f") == "F")
    items = o.where("f = 'O'").select("g", (F.col("key") % 50).alias("key"), "s")
    return fuse.injected(items, gate, "g", "key", "s", 3, 0.85, 200000.0).select("g", "key", "rank", "injected")


@query(f"""WITH {_SQL_RANKED}, v AS (SELECT g, key, rank, rank BETWEEN 2 AND 25 AS t, round(1.0 / (3 + rank) + 0.75 / (3 + key % 25) + 0.1 * (key % 20) / 20 + 0.1 * (s / 500000) + 0.1 * (key % 2), 9) AS v FROM a0)
 SELECT g, key, CAST(CASE WHEN t THEN 1 + row_number() OVER (PARTITION BY g, t ORDER BY v DESC, rank) ELSE rank END AS INTEGER) AS rank FROM v""")
def documented_prior(spark, d):
    """R13, W12."""
    k = F.col("key")
    v = fuse.documented_prior(F.col("rank"), k % 25, k % 20, F.col("s") / 500000, k % 2)
    return fuse.rerank_tail(_ranked(spark, d), "g", F.round(v, 9), "key").select("g", "key", "rank")


@query(f"""WITH {_SQL_RANKED} SELECT g, key, round(1.6343 / (3 + rank - 1) + 1.6024 * (key % 10) / 10 + 0.75 * ln(greatest((key % 7) / 7, 1e-4)) + 0.5 * ln(greatest(exp(-0.5 * pow(((s / 500 - 500) / 500 * 1e6 / 1e5 + 1.5) / 3.5, 2)), 1e-4)) + 0.3 * ln(1.15), 5) AS score FROM a0""")
def five_channels(spark, d):
    """R14, F2."""
    k = F.col("key")
    prior = F.exp(-0.5 * F.pow(((F.col("s") / 500 - 500) / 500 * 1e6 / 1e5 + 1.5) / 3.5, F.lit(2.0)))
    terms = [(1 / (3 + F.col("rank") - 1), 1.6343, False), (k % 10 / 10, 1.6024, False), (k % 7 / 7, 0.75, True), (prior, 0.5, True), (F.lit(1.15), 0.3, True)]
    return _ranked(spark, d).select("g", "key", F.round(fuse.channels(terms), 5).alias("score"))


@query("""WITH o AS (SELECT o_orderkey AS key, coalesce(o_totalprice, 0) AS a, (o_orderkey * 7 % 31)::DOUBLE AS b, (o_orderkey % 37)::DOUBLE AS c, o_orderkey % 2 = 0 AS oa, o_orderkey % 3 = 0 AS ob, o_orderkey % 5 = 0 AS oc, o_custkey AS g FROM orders),
 z AS (SELECT key, oa, ob, oc, CASE WHEN stddev_pop(a) OVER p > 1e-9 THEN (a - avg(a) OVER p) / stddev_pop(a) OVER p ELSE 0 END AS za, CASE WHEN stddev_pop(b) OVER p > 1e-9 THEN (b - avg(b) OVER p) / stddev_pop(b) OVER p ELSE 0 END AS zb, CASE WHEN stddev_pop(c) OVER p > 1e-9 THEN (c - avg(c) OVER p) / stddev_pop(c) OVER p ELSE 0 END AS zc FROM o WINDOW p AS (PARTITION BY g))
 SELECT key, round(CASE WHEN oa AND ob AND oc THEN 0.5 * za + 0.25 * zb + 0.25 * zc WHEN oa AND ob THEN (za + zb) / 2 WHEN oa AND oc THEN (za + zc) / 2 WHEN ob AND oc THEN (zb + zc) / 2 WHEN oa THEN za WHEN ob THEN zb WHEN oc THEN zc ELSE 0 END, 5) + 0.0 AS score FROM z""")
def masked_ensemble(spark, d):
    """R16."""
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("key"), F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("a"), (k * 7 % 31).cast("double").alias("b"), (k % 37).cast("double").alias("c"), (k % 2 == 0).alias("oa"), (k % 3 == 0).alias("ob"), (k % 5 == 0).alias("oc"))
    return fuse.ensemble_table(("a", "oa"), ("b", "ob"), ("c", "oc"), "g", rows).select("key", (F.round("score", 5) + 0.0).alias("score"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS l, o_orderkey AS r, o_orderpriority AS src, o_totalprice / 500000 AS s FROM orders), f AS (SELECT *, count(*) OVER (PARTITION BY l) AS c FROM p WHERE s >= CASE src WHEN '1-URGENT' THEN 0.3 WHEN '5-LOW' THEN 0.6 END), k AS (SELECT l, r, s FROM f WHERE c > 1 OR s >= 0.8)
 SELECT l, r, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, l) AS n FROM k) WHERE n = 1""")
def linkage_gates(spark, d):
    """R19."""
    p = _t(spark, d, "orders").select(F.col("o_custkey").alias("l"), F.col("o_orderkey").alias("r"), F.col("o_orderpriority").alias("src"), (F.col("o_totalprice") / 500000).alias("s"))
    return linkage.gated_links(p, "l", "r", "src", "s", {"1-URGENT": 0.3, "5-LOW": 0.6}, 0.8).select("l", "r", F.round("s", 6).alias("s"))


@query(f"""WITH {_SQL_RANKED} SELECT g, key, round(s / 500000 + (key % 10) / 10 - CASE WHEN key % 6 = 0 THEN 0.5 * coalesce(stddev_pop(s / 500000) OVER (PARTITION BY g), 0) ELSE 0 END, 9) AS blend, round(CASE WHEN s / 500000 >= 0.85 THEN (key % 10) / 10 ELSE s / 500000 END, 9) AS free FROM a0""")
def score_modes(spark, d):
    """M10."""
    x, y, sd = F.col("s") / 500000, F.col("key") % 10 / 10, F.stddev_pop(F.col("s") / 500000).over(Window.partitionBy("g"))
    marked = F.col("key") % 6 == 0
    return _ranked(spark, d).select("g", "key", F.round(fuse.score_mode("blend", x, y, x, 0.85, marked, 0.5, sd), 9).alias("blend"), F.round(fuse.score_mode("public_free", x, y, x, 0.85, marked, 0.0, F.lit(0.0)), 9).alias("free"))


def _training(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("g"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", ((F.col("l_discount") > 0.04) & (F.col("l_quantity") > 20)).cast("double").alias("y"))
    return li.withColumn("w", models.class_weights(F.col("l_tax") == 0, 0.3, F.col("l_discount"), 0.095, 10.0))


@query()
def boosted_ranker(spark, d):
    """M4, M5: two seeds, fitted on two thirds of the parts; probabilities and the order of the lines of the other third."""
    rows, names = _training(spark, d), ["l_quantity", "l_discount", "l_tax"]
    out = models.predict(rows.where("g % 3 = 0"), models.fit_boosted(rows.where("g % 3 <> 0"), names, "y", "w", [1, 2], rounds=5, depth=3), names)
    out = tables.together(out, _t(spark, d, "lineitem"), "g")
    return out.select("g", "l_orderkey", "l_linenumber", F.round("p", 6).alias("p"), F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), "l_orderkey", "l_linenumber", "l_suppkey")).alias("rank"))


@query(f"""WITH {_SQL_RANKED}, p AS (SELECT g, key, rank, round(1 / (1 + exp(-(2.0 * (s / 500000) - 0.3 * (key % 5) - 0.4))), 9) AS p FROM a0), b AS (SELECT *, max(p) OVER (PARTITION BY g) AS b, row_number() OVER (PARTITION BY g ORDER BY p DESC, rank) AS n FROM p)
 SELECT g, key, round(p, 6) AS p, CAST(CASE WHEN b >= 0.78 THEN n ELSE rank END AS INTEGER) AS rank FROM b""")
def logistic_rerank(spark, d):
    """M6."""
    rows = _ranked(spark, d).withColumns({"a": F.col("s") / 500000, "b": F.col("key") % 5})
    scored = rows.withColumn("p", F.round(models.linear([("a", 2.0), ("b", -0.3)], -0.4), 9))
    return models.gated_order(scored, "g", "p", "key", 0.78).select("g", "key", F.round("p", 6).alias("p"), "rank")


@query()
def logistic_fit(spark, d):
    """M7: five folds by group hash, a logistic fit on the other four, the held-out log loss. Lines that are equal to a fit are put together once, with their number as a weight."""
    rows, names = _training(spark, d).withColumn("fold", F.pmod(F.xxhash64("g"), F.lit(5))), ["l_quantity", "l_discount", "l_tax"]
    rows, path = models.equal_rows(rows, [*names, "y", "fold"], "n"), tables.scratch(spark, "logistic")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    out = None
    for k in range(5):
        held = models.predict(rows.where(F.col("fold") == k), [models.fit_logistic(rows.where(F.col("fold") != k), names, "y", weight="n")], names)
        loss = F.when(F.col("y") == 1, F.ln(F.greatest("p", F.lit(1e-12)))).otherwise(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-12))))
        part = held.agg(F.lit(k).alias("fold"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.round(-F.sum(F.col("n") * loss) / F.sum("n"), 4).alias("loss"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH x AS (SELECT (l_discount - 0.05) * 60 AS z, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem), t AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS temperature), p AS (SELECT temperature, y, greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-z / temperature)))) AS p FROM x, t)
 SELECT temperature, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 5) AS loss FROM p GROUP BY temperature""")
def temperature_grid(spark, d):
    """M7, M9."""
    x = _t(spark, d, "lineitem").select(((F.col("l_discount") - 0.05) * 60).alias("z"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    return models.temperature_losses(x, "z", "y", [0.5, 1.0, 2.0, 4.0]).select("temperature", F.round("loss", 5).alias("loss"))


@query(f"""WITH w AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS w, i / 4 AS a, j / 4 AS b, (4 - i - j) / 4 AS c FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j) WHERE i + j <= 4), {_SQL_RANKED},
 x AS (SELECT g, g % 5 AS fold, key, key = min(key) OVER (PARTITION BY g) AS t, s / 500000 AS p, (key % 23) / 23 AS q, (key % 7) / 7 AS r FROM a0), v AS (SELECT w, g, fold, t, round(a * p + b * q + c * r, 12) AS v FROM x, w), u AS (SELECT *, max(CASE WHEN t THEN v END) OVER (PARTITION BY w, g) AS tv FROM v),
 k AS (SELECT w, fold, g, 1 + count(*) FILTER (NOT t AND v >= tv) AS k FROM u GROUP BY ALL) SELECT fold, CAST(w AS INTEGER) AS w, round(avg(CASE WHEN k <= 25 THEN 1.0 / k ELSE 0 END), 6) AS mrr FROM k GROUP BY fold, w""")
def weight_grid(spark, d):
    """M8, M9: 15 weightings of three scores, five folds."""
    k = F.col("key")
    x = _ranked(spark, d).select("g", (F.col("g") % 5).alias("fold"), "key", (k == F.min("key").over(Window.partitionBy("g"))).alias("t"), (F.col("s") / 500000).alias("p"), (k % 23 / 23).alias("q"), (k % 7 / 7).alias("r"))
    return models.weight_search(x, "g", "fold", "t", ["p", "q", "r"], models.simplex(4)).select("fold", "w", F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_SQL_SPECTRA} SELECT sid, precursor FROM sp WHERE precursor >= 920 AND precursor <= 960 AND adduct IN ('Brand#1', 'Brand#2') AND pol = 1""")
def pushed_scan(spark, d):
    """Range, membership and equality reach the Parquet scan."""
    p = _t(spark, d, "part").where("p_retailprice >= 920 and p_retailprice <= 960 and p_brand in ('Brand#1', 'Brand#2') and p_size % 2 = 1")
    return p.select(F.col("p_partkey").alias("sid"), F.col("p_retailprice").alias("precursor"))


@query("""SELECT 'event' AS source, event_id AS key, value AS score FROM events WHERE value > 0 UNION ALL SELECT 'order', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 AND o_orderstatus <> 'P'""")
def source_union(spark, d):
    """Two sources of other column names, resolved and put together."""
    names = {"key": ["event_id", "o_orderkey"], "score": ["value", "o_totalprice"]}
    a = tables.resolve(_t(spark, d, "events"), names, ("key", "score")).where("score > 0")
    b = tables.resolve(_t(spark, d, "orders"), names, ("key", "score")).where("score > 0 and o_orderstatus <> 'P'")
    return a.select(F.lit("event").alias("source"), "key", "score").unionByName(b.select(F.lit("order").alias("source"), "key", "score"))


@query(f"WITH {_SQL_LISTS} SELECT g, key, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 6")
def wide_lists(spark, d):
    """Lists as columns and back."""
    a, _ = _lists(spark, d)
    wide = a.where("rank <= 6").groupBy("g").agg(*[F.max(F.when(F.col("rank") == i + 1, F.col("key"))).cast("string").alias(f"s_{i}") for i in range(6)])
    return tables.wide_to_long(wide, "g", "s_", 6, "key").select("g", F.col("key").cast("long").alias("key"), "rank")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderstatus AS f, list_distinct(list(CAST(floor(o_totalprice / 20000) AS INTEGER))) AS b FROM orders GROUP BY ALL)
 SELECT a.k, a.f AS x, c.f AS y, round(len(list_intersect(a.b, c.b)) / len(list_distinct(list_concat(a.b, c.b))), 6) AS score FROM p a JOIN p c ON a.k = c.k AND a.f < c.f""")
def bin_jaccard(spark, d):
    """K19."""
    p = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("x")).agg(F.collect_set(F.floor(F.col("o_totalprice") / 20000)).alias("a"))
    q = p.withColumnsRenamed({"x": "y", "a": "b"})
    return p.join(q, "k").where("x < y").select("k", "x", "y", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@query("""SELECT sid, round(exp(-0.5 * pow(((m - p) / p * 1e6 + 1.5) / 3.5, 2)), 6) AS prior FROM (SELECT p_partkey AS sid, p_retailprice AS p, p_retailprice * (1 + (p_partkey % 21 - 10) * 1e-6) AS m FROM part)""")
def mass_priors(spark, d):
    """F2, F7."""
    s = _spectra(spark, d)
    expected = F.col("precursor") * (1 + (F.col("sid") % 21 - 10) * 1e-6)
    return s.select("sid", F.round(chem.mass_prior(F.col("precursor"), expected), 6).alias("prior"))
