"""Empty inputs of the WARC writer and of a rollup's commits."""

from ionloom.llm import tokencounts, warc


def test_warc_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0


def test_commits_of_nothing_and_of_new_documents_only(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    kind = "op string, doc_id long, tokenizer string, source string, lang string, tokens long"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    assert rollup.commit("1", rows()) and rollup.totals().count() == 0
    assert rollup.commit("2", rows(("insert", 1, "t", "s", "en", 5), ("insert", None, "t", "s", "en", 2), ("insert", 3, "t", "s", "fr", 7)))
    assert rollup.commit("3", rows())
    assert rollup.commit("4", rows(("revise", None, "t", "s", "en", 3), ("delete", 3, "t", None, None, None), ("delete", 9, "t", None, None, None)))
    assert sorted(map(tuple, rollup.totals().collect())) == [("s", "en", "t", 2, 8)]
    named = spark.createDataFrame([(None, "t"), (3, "t")], "doc_id long, tokenizer string")
    assert {(r.doc_id, len(r.counts)) for r in rollup.ledger(named).collect()} == {(None, 1), (3, 0)}
