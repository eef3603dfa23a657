"""Benchmark decontamination: a prefix-filtered containment join of documents with item-sized word windows.

Tokens are shingles of SHINGLE words (a shorter window is one shingle), ordered by how rare they are in the corpus.
Containment of a window in a document stretch of its own length asks for all of its shingles, so its necessary prefix is
one: the rarest. Documents meet windows on that shingle only; a candidate must fit into the document (position and length
bounds) and is then compared word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, hide, shown, table

WINDOW, SHINGLE = 10, 3
#: What separates words once upper-case letters are kept apart: ASCII other than letters and digits.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in their own case; none for null."""
    return F.coalesce(F.array_remove(F.split(text, _GAPS), ""), F.array().cast("array<string>"))


def folded(sequence: Column) -> Column:
    """Words as one text with A-Z lower-cased: equal exactly if the word sequences are."""
    return F.translate(F.array_join(sequence, " "), _UPPER, _LOWER)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, body, len) of each window of each item; an item of fewer words is one window, one of none has none."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return items.select("item_id", "w", starts.alias("s")).select("item_id", folded(F.slice("w", F.col("s"), F.lit(size))).alias("body")).distinct()


def _shingles(size: int) -> Column:
    """(pos from 0, key) of each shingle of that many words. The key, lower-cased beyond A-Z, is equal wherever words folded by A-Z are.

    Words are zipped with themselves moved on by one place and more; a look-up of the array inside a lambda could be
    evaluated anew for each word once the optimizer moves the expression.
    """
    joined = F.col("words")
    for k in range(1, size):
        joined = F.zip_with(joined, F.slice("words", F.lit(k + 1), F.greatest(F.size("words") - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(F.transform(joined, lambda w, i: F.struct(i.alias("pos"), F.lower(w).alias("key"))), lambda s: s["key"].isNotNull())


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each shingle of each document, of all the sizes that windows have."""
    # the array is a column before it is exploded, as exploding an expression would copy a document's words for each row; an
    # outer explode, as the inner one brings a filter that evaluates the array twice
    rows = docs.withColumn("every", F.concat(*[_shingles(k) for k in sizes])).withColumn("s", F.explode_outer("every"))
    return rows.select("*", "s.pos", "s.key").where("key is not null").drop("s", "every")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(text_id, pos, item_id) distinct: words of a text hit by a window of an item. text_id is the SHA-256 of the text, so copies are one.

    The windows are broadcast if there are at most BROADCAST_ROWS with their items; otherwise shingles and windows meet in shuffles, by the rarest shingle of each window.
    """
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("text_id"), words(F.col("text")).alias("words"))
    bodies = windows(benchmark, size)
    distinct = bodies.select("body").distinct().withColumn("w", F.split("body", " ", -1))
    n = bodies.limit(BROADCAST_ROWS + 1).count()  # as many as distinct windows at least
    if not n:
        return texts.select("text_id", F.lit(0).alias("pos"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id")).where("false")
    small = n <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)

    # the shingles of each window, all of one size, and how often each occurs in the corpus
    each = distinct.select("body", F.size("w").alias("len"), F.col("w").alias("words"))
    sizes = [k for k in range(1, SHINGLE + 1) if not each.where((F.col("len") == k) if k < SHINGLE else (F.col("len") >= k)).isEmpty()]
    shingle = None
    for k in sizes:
        shingle = (F if shingle is None else shingle).when(F.least("len", F.lit(SHINGLE)) == k, _shingles(k))
    each = each.select("body", "len", F.explode(shingle).alias("s")).select("body", "len", F.col("s.pos").alias("at"), "s.key")
    counts = _positions(texts.select("words"), sizes).select("key").join(hint(each.select("key").distinct()), "key").groupBy("key").count()
    # the prefix: each window's rarest shingle, ties to the smaller one and the earlier place
    each = each.join(counts, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    prefix = each.groupBy("body", "len").agg(F.min(F.struct("count", "key", "at")).alias("least")).where("least.count > 0").select("body", "len", "least.key", "least.at")

    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("len") <= F.col("n"))
    first = F.col("pos") - F.col("at")
    if small:
        found = _positions(texts.withColumn("n", F.size("words")), sizes).join(F.broadcast(prefix), "key").where(fits)
        found = found.where(folded(F.slice("words", first + 1, F.col("len"))) == F.col("body")).select("text_id", first.alias("first"), "len", "body")
    else:
        places = _positions(texts.withColumn("n", F.size("words")), sizes).select("text_id", "n", "pos", "key")
        places = places.join(prefix, "key").where(fits).select("text_id", first.alias("first"), "len", "body").distinct()
        found = places.join(texts.dropDuplicates(["text_id"]), "text_id").where(folded(F.slice("words", F.col("first") + 1, F.col("len"))) == F.col("body")).drop("words")
    found = found.distinct().join(hint(bodies), "body")
    return found.select("text_id", "item_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("len") - 1)).alias("pos")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated for every row; other columns of docs stay, repeated rows too.

    Null texts have no words. Null item ids count as an item without a name and are left out of n_items. An empty
    benchmark hits nothing.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    hits = contaminated_words(docs.select("text"), benchmark, size)
    n_hit = hits.select("text_id", "pos").distinct().groupBy("text_id").agg(F.count("*").alias("n_hit"))
    items = hits.select("text_id", F.col("item_id").cast("string").alias("i")).distinct().groupBy("text_id").agg(F.array_sort(F.collect_set("i")).alias("items"))
    rows, names = hide(docs)
    text = F.col(f"`{names['text']}`")
    out = rows.withColumns({"text_id": _text_id(text), "n_words": F.size(words(text)).cast("long")}).join(n_hit.join(items, "text_id"), "text_id", "left")
    return out.select(
        *shown(names),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _text_id(text: Column) -> Column:
    """SHA-256 of a text; of null texts, which hold no window, one in many values, so that they don't meet in one task."""
    return F.coalesce(F.sha2(text, 256), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with their own columns, whatever their names."""
    hits = contaminated_words(docs.select("text"), benchmark).select("text_id").distinct()
    rows, names = hide(docs)
    return rows.withColumn("text_id", _text_id(F.col(f"`{names['text']}`"))).join(hits, "text_id", "left_anti").select(*shown(names))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination of all documents by all benchmark items, windows of 10 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


QUERIES = {"op4_decontaminate": op4_decontaminate}

ORACLE = {
    "op4_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     wi AS (SELECT DISTINCT item_id, len(w) < 10 AS short, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + 9), ' ') AS body
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM wi),
     g AS (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS body
           FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n)),
     hit AS (SELECT g.rid, g.s, g.n, wi.item_id FROM g JOIN wi ON g.n = wi.n AND g.body = wi.body),
     pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
     its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
}
