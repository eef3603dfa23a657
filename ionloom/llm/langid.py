"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts byte 4-grams (of letters, words apart) per language over all labelled rows. A gram belongs to every
language in which it is at least SHARE as frequent as where it is most frequent and has at least one in MEMBERS of all
occurrences, so a filter holds MEMBERS grams at most, whatever the corpus. One Bloom filter per language holds its
grams; the filters are stored bit-sliced: slot i of the table is a mask with bit l set if slot i of language l's filter
is, so HASHES look-ups and an AND give all languages that contain a gram. A text's score for a language is the number of
its grams found there, corrected for the false positives expected from that filter's fill.

A table has SLOTS masks of LANGS languages at most; it is broadcast, and its size doesn't depend on the input. Every value of
lang is learnt: more than LANGS languages make several tables, of which a task holds one at a time; texts pass them one after
the other, each time with the best language so far, and which languages share a table changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, chunks, crc_mod, cut, hide, mix, remove, shown, small_batches, table

SLOTS = 1 << 21
HASHES = 3
SHARE = 0.35
#: A gram needs so many occurrences in training to enter a filter.
LEAST, MEMBERS = 3, 400_000
#: Languages of one table; it has 256 KB for each.
LANGS = 512
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
LANGS_PER_WORD = 64
_U = np.uint64
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, the four bytes as a number) of each byte 4-gram; everything but letters and bytes of other scripts is a space, and runs of spaces are one."""
    n = len(data)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    text = _FOLD[data]
    keep = np.ones(n, bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (rows[1:] != rows[:-1])
    text, rows = text[keep].astype(np.uint32), rows[keep]
    if len(text) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    four = text[:-3] | (text[1:-2] << 8) | (text[2:-1] << 16) | (text[3:] << 24)
    same = rows[:-3] == rows[3:]
    four, rows = four[same], rows[:-3][same]
    return rows, four.astype(np.int64)


def slots(gram: np.ndarray) -> np.ndarray:
    """The HASHES slots of each gram, as rows."""
    h = mix(gram.astype(np.uint64) + _U(0x1234567))
    step = (h >> _U(40)) | _U(1)
    with np.errstate(over="ignore"):
        return np.stack([((h + _U(i) * step) % _U(SLOTS)).astype(np.int64) for i in range(HASHES)])


def _counts(langs: list[str]):
    order = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array(keys & 0xFFFFFFFF), pa.array(sums)], ["l", "g", "n"])

        for batch in batches:
            lang = np.array([order.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = byte_view(batch.column(0))
            for i, j in chunks(offsets):
                part = offsets[i : j + 1]
                row, g = grams(data[part[0] : part[-1]], part - part[0])
                own = lang[i:j][row]
                new, n = np.unique(((own << 32) | g)[own >= 0], return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, where, np.concatenate([sums, n]))
                sums = total
                if len(keys) > HELD:
                    yield out()
                    keys, sums = keys[:0], sums[:0]
        yield out()

    return run


def _member_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, word, bit) of grams g of languages l: the places that a filter's gram sets."""
    for batch in batches:
        g, lang = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
        slot = slots(g).ravel()
        bit = (_U(1) << (lang % LANGS_PER_WORD).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(np.tile(lang // LANGS_PER_WORD, HASHES).astype(np.int32)), pa.array(np.tile(bit, HASHES))], ["slot", "word", "bit"])


def train(labelled: DataFrame) -> list[dict]:
    """The models of (text, lang), each of LANGS languages at most, in order: langs, masks (SLOTS for each 64 languages) and the false positive rate of each language. At least one."""
    small_batches(labelled.sparkSession)
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())  # labels
    if not langs:
        return [_filter([], None, 0)]
    counts = labelled.mapInArrow(_counts(langs), "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    counts = cut(counts, "language-grams", paths := [])
    sums = counts.groupBy("l").agg(F.sum("n").alias("all"))
    rate = counts.join(F.broadcast(sums), "l").withColumn("rate", F.col("n") / F.col("all"))  # a row for each language
    best = rate.groupBy("g").agg(F.max("rate").alias("best"), F.sum("n").alias("seen"), F.collect_list(F.struct("l", "rate")).alias("each"))
    member = best.where(F.col("seen") >= LEAST).select("g", F.explode("each").alias("e"), "best")
    member = member.where((F.col("e.rate") >= SHARE * F.col("best")) & (F.col("e.rate") * MEMBERS >= 1)).select("g", F.col("e.l").alias("l"))
    if len(langs) > LANGS:
        member = cut(member, "language-members", paths)
    models = [_filter(langs[i : i + LANGS], member, i) for i in range(0, len(langs), LANGS)]
    remove(labelled.sparkSession, paths)
    return models


def _filter(langs: list[str], member: DataFrame | None, first: int) -> dict:
    """The model of some languages, whose numbers in member (g, l) begin at first."""
    masks = np.zeros((SLOTS, max(1, -(-len(langs) // LANGS_PER_WORD))), np.uint64)
    if member is not None:
        own = member.where(F.col("l").between(first, first + len(langs) - 1)).select("g", (F.col("l") - first).cast("int").alias("l"))
        bits = own.mapInArrow(_member_bits, "slot int, word int, bit long").groupBy("slot", "word").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most SLOTS rows for each 64 languages of a table
        masks[bits["slot"].to_numpy(), bits["word"].to_numpy()] = bits["bit"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero((masks[:, i // LANGS_PER_WORD] >> _U(i % LANGS_PER_WORD)) & _U(1)) / SLOTS for i in range(len(langs))])
    return {"langs": langs, "masks": masks, "false": fill**HASHES}


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_FOLD[data] > 32) & (data < 128), out=plain[1:])
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def votes_of(model: dict, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """For each text the first language of the model with most votes (None without letters or languages), its votes, the sum of all votes, and whether the text has a letter."""
    langs, masks, false = model["langs"], model["masks"], model["false"]
    data, offsets = byte_view(column)
    names, most, sums, letters = [], [], [], []
    for i, j in chunks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        piece = data[offsets[i] : offsets[j]]
        row, g = grams(piece, part)
        s = slots(g)
        hits = masks[s[0]]
        for x in s[1:]:
            hits = hits & masks[x]
        total = np.bincount(row, minlength=j - i).astype(float)
        votes = np.zeros((j - i, max(1, len(langs))))
        for x in range(len(langs)):
            bit = ((hits[:, x // LANGS_PER_WORD] >> _U(x % LANGS_PER_WORD)) & _U(1)).astype(float)
            votes[:, x] = np.maximum(0, (np.bincount(row, bit, j - i) - total * false[x]) / (1 - min(false[x], 0.999)))
        best = votes.argmax(1)
        letter = _has_letter(piece, part)
        names += [langs[best[x]] if letter[x] and langs else None for x in range(j - i)]
        most.append(votes[np.arange(j - i), best])
        sums.append(votes.sum(1))
        letters.append(letter)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return names, join(most, float), join(sums, float), join(letters, bool)


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text under one model. The score is the winner's share of all corrected counts; ties go to the first language in order."""
    names, most, sums, _ = votes_of(model, column)
    found = np.array([x is not None for x in names], bool)
    return [x or "und" for x in names], np.where(found, np.clip(most / np.maximum(sums, 1e-12), 0.0, 1.0), 0.0)


def _with_language(docs: DataFrame, models: list[dict], text: str, lang: str, score: str) -> DataFrame:
    """docs with the language and the score of the column text, under these names."""
    spark = docs.sparkSession
    small_batches(spark)
    at, fields = docs.columns.index(text), list(docs.schema.fields)
    if len(models) == 1:
        shared = spark.sparkContext.broadcast(models[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, scores = predict(shared.value, batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

        return docs.mapInArrow(run, T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))

    own = ["best found", "most found", "sum found"]
    schema = T.StructType([*fields, T.StructField(own[0], T.StringType()), T.StructField(own[1], T.DoubleType()), T.StructField(own[2], T.DoubleType())])
    rows = docs.select(*docs.columns, F.lit(None).cast("string").alias(own[0]), F.lit(-1.0).alias(own[1]), F.lit(0.0).alias(own[2]))
    paths: list[str] = []
    for n, model in enumerate(models):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, most, sums, _ = votes_of(shared.value, batch.column(at))
                old, old_most = batch.column(len(fields)).to_pylist(), batch.column(len(fields) + 1).to_numpy()
                better = (most > old_most) & np.array([x is not None for x in names], bool)  # ties stay with the first language
                best = [x if b else y for x, y, b in zip(names, old, better, strict=True)]
                columns = [pa.array(best, pa.string()), pa.array(np.where(better, most, old_most)), pa.array(batch.column(len(fields) + 2).to_numpy() + sums)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *columns], batch.schema.names)

        rows = rows.mapInArrow(run, schema)
        if n + 1 < len(models):
            rows = cut(rows, "language-votes", paths)  # so that no task holds two tables
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(own[1]) / F.greatest(F.col(own[2]), F.lit(1e-12))))
    known = F.col(own[0]).isNotNull()
    return rows.select(*docs.columns, F.coalesce(own[0], F.lit("und")).alias(lang), F.when(known, share).otherwise(0.0).alias(score))


def identify(docs: DataFrame, model: list[dict]) -> DataFrame:
    """docs with lang_pred and score. A text that is null or has no letter is `und` with score 0; one with letters but no known gram gets the first language with score 0. Of languages with equal counts the first in order wins. Repeated rows stay. Columns of those names are replaced."""
    return _with_language(docs.drop("lang_pred", "score"), model, "text", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents of a language: those judged `und` go (null texts and texts without letters). The columns of docs, whatever their names.

    The model learns from the documents with a lang.
    """
    rows, names = hide(docs)
    out = _with_language(rows, train(docs), names["text"], "lang found", "score found")
    return out.where("`lang found` <> 'und'").select(*shown(names))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify over all documents, learnt from those whose remainder isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE = {}
