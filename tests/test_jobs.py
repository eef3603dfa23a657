"""The jobs over growing input, repeated batches and the command line."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import candidate_lists, prepare_training

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def texts(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(path)


FIRST = [(1, "one two three four five", "en", "a"), (3, "one  two three\nfour five ", "en", "b"), (2, "too short", "en", "a"), (None, "one two three four five six", None, None), (4, None, "en", "a"), (5, " \t", "en", "a"), (6, "a b c d e f", "en", "a"), (6, "a b c d e f", "en", "a")]
SECOND = [(0, "one two three four five", "en", "c"), (7, "a b c d e f", "en", "a"), (8, "g h i j k", None, None), (9, "é é é é é", "fr", "d")]


def snapshot(df):
    return sorted(map(str, df.drop("kind").collect()))


def admitted(df):
    return {(r.doc_id, r.batch) for r in df.where("kind = 'row'").collect()}


def audit(df):
    return {(r.batch, r.reason): r.n for r in df.where("kind = 'audit'").collect()}


def test_only_new_files_are_taken(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    run = lambda: prepare_training.prepare(spark, at["in"], at["out"], at["ck"])
    texts(spark, at["in"], FIRST)
    out = run()
    assert admitted(out) == {(1, 0), (6, 0)}
    want = {(0, "read"): 8, (0, "missing_id"): 1, (0, "missing_text"): 2, (0, "too_few_words"): 1, (0, "duplicate"): 2}
    assert {k: n for k, n in audit(out).items() if k[1] not in ("train", "validation")} == want
    files = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(at["out"]) for f in names if f.endswith(".parquet")}
    before = snapshot(out)
    assert snapshot(run()) == before  # nothing new
    texts(spark, at["in"], SECOND)
    out = run()
    assert admitted(out) == {(1, 0), (6, 0), (8, 1), (9, 1)}  # doc 0 has a smaller id than 1, but came later
    assert audit(out)[1, "read"] == 4 and audit(out)[1, "duplicate"] == 2
    later = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(at["out"]) for f in names if f.endswith(".parquet")}
    assert files.items() <= later.items()  # files of the first batch stay as they are


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    for rows in (FIRST, SECOND):
        texts(spark, at["in"], rows)
        out = prepare_training.prepare(spark, at["in"], at["out"], at["ck"])
    before = snapshot(out)
    # as after a failure between the writes of batch 1 and its commit
    for name in ("1", ".1.crc"):
        os.remove(f"{at['ck']}/commits/{name}")
    assert snapshot(prepare_training.prepare(spark, at["in"], at["out"], at["ck"])) == before
    # and as after one between the writes of rows and of the audit
    for name in ("1", ".1.crc"):
        os.remove(f"{at['ck']}/commits/{name}")
    shutil.rmtree(f"{at['out']}/audit/batch=1")
    assert snapshot(prepare_training.prepare(spark, at["in"], at["out"], at["ck"])) == before


def test_small_batches_admit_the_same_contents(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    source.repartition(5, "doc_id").write.parquet(str(tmp_path / "in"))
    outs = [prepare_training.prepare(spark, str(tmp_path / "in"), str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}"), {"files_per_batch": n}).where("kind = 'row'") for n in (0, 2)]
    assert {r.batch for r in outs[1].select("batch").distinct().collect()} == {0, 1, 2}
    contents = [sorted(map(tuple, o.select("content", "split").collect())) for o in outs]
    assert contents[0] == contents[1] and len({c for c, _ in contents[0]}) == len(contents[0])


def test_settings_are_checked():
    for job, bad in ((prepare_training, {"min_word": 3}), (prepare_training, {"holdout": 2}), (candidate_lists, {"ppm": 0}), (candidate_lists, {"x": 1})):
        with pytest.raises(ValueError):
            job.settings(bad)


def test_lists_by_hand(spark, tmp_path):
    q = [(1, 100.0, 3), (2, 500.0, 4), (3, -1.0, 4), (4, 100.01, 2)]
    spark.createDataFrame(q, "p_partkey long, p_retailprice double, p_size int").write.parquet(str(tmp_path / "q"))
    pool = [(10, 7, 50_000.0, "2-HIGH"), (11, 7, 50_000.0, "1-URGENT"), (12, 8, 50_010.0, "x"), (13, 9, 90_000.0, "2-HIGH"), (14, 9, 90_500.0, "2-HIGH"), (15, None, 50_000.0, "2-HIGH"), (16, 9, None, "2-HIGH"), (17, 6, 250_000.0, None)]
    spark.createDataFrame(pool, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "p"))
    run = lambda: candidate_lists.build(spark, str(tmp_path / "q"), str(tmp_path / "p"), str(tmp_path / "out"), {"n": 3, "sigma_ppm": 100.0})
    out = run()
    assert {(r.pid, r.key, r.block) for r in out.where("kind = 'candidate'").collect()} == {(11, 7, 1), (12, 8, 1), (17, 6, 5)}
    lists = {}
    for r in sorted(out.where("kind = 'list'").collect(), key=lambda r: r["rank"]):
        lists.setdefault(r.sid, []).append((r.key, r.src))
    # the most frequent keys are 7 and 9 (two rows each), then 6
    assert lists == {1: [(7, 0), (8, 0), (9, 1)], 2: [(6, 0), (7, 1), (9, 1)], 4: [(7, 0), (8, 0), (9, 1)]}
    assert out.where("kind = 'check'").agg(F.sum("broken")).first()[0] == 0
    before = snapshot(out)
    assert snapshot(run()) == before


def test_command_line(tmp_path):
    from_dir = tmp_path / "in"
    from_dir.mkdir()
    shutil.copy(f"{SF}/documents.parquet", from_dir)
    (tmp_path / "config.json").write_text(json.dumps({"min_words": 3}))
    args = [f"--{k}={v}" for k, v in (("config", tmp_path / "config.json"), ("documents", from_dir), ("output", tmp_path / "out"), ("checkpoint", tmp_path / "ck"))]
    done = subprocess.run([sys.executable, "-m", "jobs.prepare_training", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "jobs.prepare_training took 200 rows in 1 batches" in done.stderr
    assert list((tmp_path / "out" / "rows").glob("split=train/batch=0/*.parquet"))


def test_queries_of_one_precursor_share_pairs(spark):
    queries = spark.createDataFrame([(i, 500.0, 0) for i in range(40)] + [(40, 600.0, 0)], "sid long, precursor double, pol int")
    found = spark.createDataFrame([(7, 500.01), (8, 499.99), (9, 600.0)], "key long, mass double")
    popular = spark.createDataFrame([(7, 3), (8, 1), (9, 1)], "key long, count long")
    out = candidate_lists.ranked(queries, found, popular, candidate_lists.settings({"n": 2}))
    got = {}
    for r in out.collect():
        got.setdefault(r.sid, []).append((r["rank"], r.key, r.src))
    assert all(sorted(got[i]) == [(1, 7, 0), (2, 8, 0)] for i in range(40))
    assert sorted(got[40]) == [(1, 9, 0), (2, 7, 1)]
    # the band join is over precursors, of which there are two
    assert "Aggregate [precursor" in out._jdf.queryExecution().optimizedPlan().toString()
