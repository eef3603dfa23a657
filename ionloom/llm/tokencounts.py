"""Token counts as delta-maintained rollups.

Changes come in batches of inserts, deletes and revised counts. A ledger keeps each document's last counts, so a change
becomes signed deltas: minus what the ledger had, plus what the batch brings. A batch's deltas are summed by source,
language and tokenizer version before they are stored, and totals are the sum of all batches' deltas. A batch is written
below its own id and counts once its marker is there; committing an id again changes nothing. Every COMPACT batches a
batch also stores the whole ledger and the totals up to itself, so that a commit reads no more than that and the batches
since. Of what it reads only the rows of the batch's own documents are kept, grouped and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, shared_dir, small_batches, table

TOKENIZERS = "/opt/tokenizers"
#: How the byte-level tokenizers split a text before they merge. Fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COMPACT = 8
KEYS = ("source", "lang", "tokenizer")
_ENTRY = "array<struct<source:string,lang:string,docs:bigint,tokens:bigint>>"
_LEDGER = f"doc_id long, tokenizer string, counts {_ENTRY}"
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"
#: Of several operations on one document in a batch, the last of these counts.
_ORDER = ("insert", "revise", "delete")


class Rollup:
    """The rollup stored below path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _with(self, what: str) -> list[str]:
        """Ids of the batches that have a finished table of that name, in order of id: one request."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/{what}/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(x.getPath().getParent().getParent().getName() for x in found or [])

    def batches(self) -> list[str]:
        """Ids of the committed batches, in order of id. Deltas are written last."""
        return self._with("deltas")

    def _since(self, whole: str, part: str, schema: str) -> DataFrame:
        """The last stored whole table and that part of all batches after it, with their order in `at`."""
        ids = self.batches()
        last = max((x for x in self._with(whole) if x in ids), default="")
        named = [(x, whole if x == last else part) for x in ids if x >= last]
        out = self.spark.createDataFrame([], f"{schema}, at int")
        for i, (batch, what) in enumerate(named):
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.path}/{batch}/{what}").withColumn("at", F.lit(i)))
        return out

    def ledger(self, named: DataFrame | None = None) -> DataFrame:
        """(doc_id, tokenizer, counts): last counts of each document that any batch named, by source and language; none if it was deleted. With named (doc_id, tokenizer) only these: the ledger is read, but no more of it is shuffled."""
        every = self._since("whole_ledger", "ledger", _LEDGER)
        if named is not None:
            same = F.col("e.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("e.tokenizer").eqNullSafe(F.col("n.tokenizer"))
            every = every.alias("e").join(maybe_broadcast(named).alias("n"), same, "left_semi")
        return every.groupBy("doc_id", "tokenizer").agg(F.max_by("counts", "at").alias("counts"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply (op, doc_id, tokenizer, source, lang, tokens), op being insert, revise or delete; False if this id was committed before.

        Ids must grow in the order of the batches. insert and revise both set a document's counts, so an insert of a known
        document replaces it; delete of an unknown one does nothing. A document may have several rows in a batch, all of
        which count, docs being their number; of different operations on it the deletes hold, else the revisions. Rows with
        a null doc_id are the rows of one document, so none is lost. Null counts are 0. Other columns are ignored.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than {done[-1]}")
        at = f"{self.path}/{batch}"
        # summed before rows of one document, of which those without id may be many, meet
        rank = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("op")).cast("int")
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), *KEYS, rank.alias("rank"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).where("rank > 0")
        sums = rows.groupBy("doc_id", *KEYS, "rank").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
        new = sums.groupBy("doc_id", "tokenizer").agg(F.max("rank").alias("last"), F.array_sort(F.collect_list(F.struct("rank", "source", "lang", "docs", "tokens"))).alias("x"))
        counts = F.transform(F.filter("x", lambda e: (e["rank"] == F.col("last")) & (F.col("last") < len(_ORDER))), lambda e: F.struct(e["source"].alias("source"), e["lang"].alias("lang"), e["docs"].alias("docs"), e["tokens"].alias("tokens")))
        new.select("doc_id", "tokenizer", counts.alias("counts")).write.mode("overwrite").parquet(f"{at}/ledger")
        new = self.spark.read.schema(_LEDGER).parquet(f"{at}/ledger")
        same = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("n.tokenizer").eqNullSafe(F.col("o.tokenizer"))
        gone = self.ledger(new.select("doc_id", "tokenizer"))
        each = lambda rows, sign: rows.select("tokenizer", F.explode("counts").alias("c")).select("c.source", "c.lang", "tokenizer", (F.col("c.docs") * sign).alias("docs"), (F.col("c.tokens") * sign).alias("tokens"))
        deltas = self._sums(each(new, 1).union(each(gone, -1)))
        if (len(done) + 1) % COMPACT == 0:
            kept = self.ledger().alias("o").join(new.alias("n"), same, "left_anti").select("doc_id", "tokenizer", "counts")
            kept.union(new).where(F.size("counts") > 0).write.mode("overwrite").parquet(f"{at}/whole_ledger")
            self._sums(self._since("whole_totals", "deltas", _DELTAS).drop("at").union(deltas)).write.mode("overwrite").parquet(f"{at}/whole_totals")
        deltas.write.mode("overwrite").parquet(f"{at}/deltas")
        return True

    @staticmethod
    def _sums(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of what is there now; keys without documents are left out."""
        return self._sums(self._since("whole_totals", "deltas", _DELTAS)).where("docs <> 0")


def _encoder(name: str, ranks: bytes, pattern: str):
    """A byte-level BPE of tiktoken from the contents of a rank file; special strings are ordinary text."""
    import base64

    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={})


#: Encoders split a text at white space before they merge, so a text is encoded in pieces of about this many characters and counts stay exact.
PIECE = 20_000


def count_tokens(encode, text: str) -> int:
    """Tokens of a text. Pieces end before a single space between two letters, where the split pattern always parts them."""
    total, at = 0, 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        total += len(encode(text[at:cut]))
        at = cut
    return total + len(encode(text[at:]))


def with_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, pattern: str = PATTERN) -> DataFrame:
    """docs without text, with tokens (long) of it; null has none. A column of that name is replaced.

    The driver reads the rank file folder/tokenizer.tiktoken, whose size is that of a vocabulary, and broadcasts it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    docs = docs.drop("tokens")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks.value, pattern).encode_ordinary
        for batch in batches:
            counts = [count_tokens(encode, t) if t else 0 for t in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "tokens"])

    schema = T.StructType([f for i, f in enumerate(docs.schema.fields) if i != at] + [T.StructField("tokens", T.LongType())])
    return docs.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents; the deletion of exact copies but those of the smallest id; recounts of the documents whose text has outer white space, without it; and the second batch once more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    name = "byte_bpe_50k"
    rollup = Rollup(spark, shared_dir(spark, "token-rollup"))

    def changes(op: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "doc_id", F.lit(name).alias("tokenizer"), "source", "lang", "tokens")

    rollup.commit("0001", changes("insert", with_tokens(docs, name)))
    digest = docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("d"))
    first = digest.where("d is not null").groupBy("d").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = digest.join(first, "d").where("doc_id <> first").withColumn("tokens", F.lit(0))
    rollup.commit("0002", changes("delete", copies))
    outer = docs.where(F.col("text").rlike(r"^\s|\s$")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    outer = outer.join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "lang", "text")
    rollup.commit("0003", changes("revise", with_tokens(outer, name)))
    rollup.commit("0002", changes("delete", copies))
    return rollup.totals()


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE = {}
