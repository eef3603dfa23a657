"""Languages in several tables give what one table gives."""

import random

from ionloom.llm import langid


def test_more_languages_than_a_table_holds(spark, monkeypatch):
    rng = random.Random(2)
    stems = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnop"[i : i + 8]) for _ in range(6)) for _ in range(30)] for i in range(7)}
    rows = [(j * 10 + i, " ".join(rng.choice(w) for _ in range(25)), x) for j in range(20) for i, (x, w) in enumerate(stems.items())]
    rows += [(900, None, "l00"), (901, "", None), (902, "123", None), (903, "zzzzzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert sum(want[d][0] == x for d, _, x in rows if d < 900) >= 138 and want[900] == want[902] == ("und", 0)
    monkeypatch.setattr(langid, "LANGS", 3)
    models = langid.train(docs)
    assert [len(m["langs"]) for m in models] == [3, 3, 1]
    got = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in langid.identify(docs, models).collect()}
    assert got == want
