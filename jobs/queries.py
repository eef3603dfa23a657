"""The jobs as registered queries: each runs twice into the same new folder and returns its output after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.sources.tables import scratch

from . import candidate_lists, prepare_training


def job1_prepare_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents admitted by a stream; the second run finds nothing new."""
    path = scratch(spark, "job1")
    documents = f"{sf_dir}/documents.parque[t]"  # as a pattern the path may be one file or a folder; without one a stream wants a folder
    for _ in range(2):
        out = prepare_training.prepare(spark, documents, f"{path}/output", f"{path}/checkpoint")
    return out


def job2_candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool cut to the queries' windows, and their lists; the second run overwrites the first."""
    path = scratch(spark, "job2")
    for _ in range(2):
        out = candidate_lists.build(spark, f"{sf_dir}/part.parquet", f"{sf_dir}/orders.parquet", f"{path}/output")
    return out


QUERIES = {"job1_prepare_training": job1_prepare_training, "job2_candidate_lists": job2_candidate_lists}

_PLACES = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(candidate_lists.DEFAULTS["sources"]))
_WINDOW = "mass >= precursor - greatest(0.05, precursor * 25.0 * 1e-6) AND mass <= precursor + greatest(0.05, precursor * 25.0 * 1e-6)"

ORACLE = {
    "job1_prepare_training": r"""
WITH p AS (SELECT doc_id, lang, source, text, trim(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') AS plain FROM documents),
 w AS (SELECT *, CAST(CASE WHEN plain = '' THEN 0 ELSE length(plain) - length(replace(plain, ' ', '')) + 1 END AS BIGINT) AS words, sha256(plain) AS content FROM p),
 j AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'missing_id' WHEN words = 0 THEN 'missing_text' WHEN words < 5 THEN 'too_few_words' END AS reason,
  CASE WHEN CAST(CAST('0x' || substr(sha256('split-1|' || content), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM w),
 f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, source NULLS FIRST, lang NULLS FIRST, text) AS k FROM j WHERE reason IS NULL),
 a AS (SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'read', count(*) FROM j UNION ALL SELECT 'duplicate', count(*) FROM f WHERE k > 1 UNION ALL SELECT split, count(*) FROM f WHERE k = 1 GROUP BY 1)
SELECT 'row' AS kind, CAST(doc_id AS BIGINT) AS doc_id, lang, source, content, words, text, split, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS n, CAST(0 AS BIGINT) AS batch FROM f WHERE k = 1
UNION ALL SELECT 'audit', NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason, CAST(n AS BIGINT), 0 FROM a
""",
    "job2_candidate_lists": f"""
WITH q AS (SELECT p_partkey AS sid, p_retailprice AS precursor, CAST(p_size % 2 AS INTEGER) AS pol FROM part WHERE p_retailprice > 0),
 po AS (SELECT o_orderkey AS pid, o_custkey AS key, o_totalprice / 500 AS mass, o_orderpriority AS source FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 0),
 i AS (SELECT * FROM po WHERE EXISTS (SELECT 1 FROM q WHERE {_WINDOW})),
 u AS (SELECT *, row_number() OVER (PARTITION BY key, floor(mass) ORDER BY mass, CASE source {_PLACES} ELSE 6 END, pid) AS k FROM i),
 c AS (SELECT pid, key, mass, source, CAST(floor(mass / 100) AS INTEGER) AS block FROM u WHERE k = 1),
 n AS (SELECT key, count(*) AS count FROM po GROUP BY key),
 m AS (SELECT sid, key, max(exp(-0.5 * pow((mass / precursor - 1) * 1e6 / 10.0, 2))) AS near FROM q JOIN c ON {_WINDOW} GROUP BY sid, key),
 s AS (SELECT sid, key, round(near + 0.1 * ln(1 + count), 6) AS score FROM m JOIN n USING (key)),
 b AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 25),
 fl AS (SELECT key, row_number() OVER (ORDER BY count DESC, key) - 1 AS rank FROM n QUALIFY rank < 25),
 a AS (SELECT sid, key, 0 AS src, rank FROM b UNION ALL SELECT sid, key, 1, rank FROM q, fl),
 d AS (SELECT *, row_number() OVER (PARTITION BY sid, key ORDER BY src, rank) AS k FROM a),
 l AS (SELECT sid, key, src, row_number() OVER (PARTITION BY sid ORDER BY src, rank, key) AS place FROM d WHERE k = 1 QUALIFY place <= 25)
SELECT 'candidate' AS kind, pid, key, mass, source, block, CAST(NULL AS BIGINT) AS sid, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS INTEGER) AS src, CAST(NULL AS INTEGER) AS pol, CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS BIGINT) AS broken FROM c
UNION ALL SELECT 'list', NULL, l.key, NULL, NULL, NULL, l.sid, CAST(l.place AS INTEGER), b.score, CAST(l.src AS INTEGER), q.pol, NULL, NULL FROM l JOIN q USING (sid) LEFT JOIN b ON b.sid = l.sid AND b.key = l.key
UNION ALL SELECT 'check', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, rule, 0 FROM (VALUES ('missing_id'), ('unknown_id'), ('too_long'), ('duplicate_key'), ('blank_key'), ('rank_gap')) v(rule)
""",
}
