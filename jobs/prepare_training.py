"""Admit arriving texts to a training set: audit, content dedup and a holdout that growth doesn't move.

python -m jobs.prepare_training --config jobs/prepare_training.json --documents DIR --output DIR --checkpoint DIR

A file stream takes the files of --documents that its checkpoint doesn't know yet, and ends. Each batch is judged by the first rule
that rejects a row (missing_id, missing_text, too_few_words); of the rest each content, spaces apart, is admitted once: the row
that came in the earliest batch, and the smallest id within it. A content's split is a hash of it against the holdout share, so
copies never part and later rows never change it.

Below --output: rows/split=../batch=.. (doc_id, lang, source, content, words, text), and audit/batch=.. (reason, n) with the rows read and
what became of them. A batch overwrites its own partitions only and looks at earlier batches only, so one that is
repeated after a failure gives the same files; a run without new files changes nothing.

A batch costs a pass over its rows, a shuffle of its texts by content, and a shuffle of the content column of what was admitted
before; of copies within a batch each task sends one on.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.rank import first_by
from ionloom.session import session

log = logging.getLogger("jobs.prepare_training")

DOCUMENTS = "doc_id long, text string, lang string, source string"
ROWS = "doc_id long, lang string, source string, content string, words long, text string, split string, batch long"
AUDIT = "reason string, n long, batch long"
SPACES = "[\\t\\n\\x0B\\f\\r ]+"
#: What a configuration may set, with defaults.
DEFAULTS = {"min_words": 5, "holdout": 0.1, "seed": "split-1", "files_per_batch": 0}


def settings(config: dict) -> dict:
    """config over DEFAULTS; ValueError for a name that isn't there or a share outside [0, 1]."""
    if unknown := set(config) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found = DEFAULTS | config
    if not 0 <= found["holdout"] <= 1:
        raise ValueError("holdout is a share between 0 and 1")
    return found


def judged(documents: DataFrame, min_words: int, holdout: float, seed: str) -> DataFrame:
    """documents with words, content (SHA-256 of the text with spaces collapsed), split, and the reason that rejects a row, if any."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "))
    rows = documents.select("doc_id", "lang", "source", "text", plain.alias("plain"))
    words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "))) + 1)
    rows = rows.withColumns({"words": words.cast("long"), "content": F.sha2("plain", 256)}).drop("plain")
    reason = F.when(F.col("doc_id").isNull(), "missing_id").when(F.col("words") == 0, "missing_text").when(F.col("words") < min_words, "too_few_words")
    return rows.withColumns({"reason": reason, "split": F.when(share(seed, F.col("content")) < holdout, "validation").otherwise("train")})


def share(seed: str, content: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and content."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), content), 256), 1, 13), 16, 10).cast("double") / float(2**52)


def stored(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The admitted rows and the audit below output."""
    return spark.read.schema(ROWS).parquet(f"{output}/rows"), spark.read.schema(AUDIT).parquet(f"{output}/audit")


def overwrite(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that rows fall in, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def admit(documents: DataFrame, batch: int, output: str, config: dict) -> int:
    """Judge one batch, write what it admits and its audit, and return the number of rows read."""
    spark = documents.sparkSession
    rows = judged(documents, config["min_words"], config["holdout"], config["seed"])
    earlier = stored(spark, output)[0].where(F.col("batch") < batch).select("content")
    first = first_by(rows.where("reason IS NULL").drop("reason"), ["content"], [F.asc("doc_id"), F.asc("source"), F.asc("lang"), F.asc("text")])
    admitted = first.join(earlier, "content", "left_anti").withColumn("batch", F.lit(batch).cast("long"))
    overwrite(admitted.select(*[c.split()[0] for c in ROWS.split(", ")]), f"{output}/rows", "split", "batch")

    reasons = rows.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))
    counts = {r.reason: r.n for r in reasons.collect()}  # a row for each rule
    kept = {r.split: r.n for r in stored(spark, output)[0].where(F.col("batch") == batch).groupBy("split").agg(F.count("*").alias("n")).collect()}
    valid = counts.pop("valid", 0)
    found = {"read": valid + sum(counts.values()), **counts, "duplicate": valid - sum(kept.values()), **kept}
    audit = spark.createDataFrame([(k, n, batch) for k, n in found.items()], AUDIT)
    overwrite(audit.coalesce(1), f"{output}/audit", "batch")
    log.info("batch %d: read %d rows, wrote %d: %s", batch, found["read"], sum(kept.values()), found)
    return found["read"]


def prepare(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take the files that are new, wait for the end of the stream, and return what stands below output: rows and audit, told apart by kind."""
    config = settings(config or {})
    for schema, name, partitions in ((ROWS, "rows", ("split", "batch")), (AUDIT, "audit", ("batch",))):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(f"{output}/{name}")  # the folder, if it is the first run
    reader = spark.readStream.schema(DOCUMENTS)
    if config["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", config["files_per_batch"])
    taken: list[int] = []
    stream = reader.parquet(documents).writeStream.foreachBatch(lambda rows, batch: taken.append(admit(rows, batch, output, config)))
    stream = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("took %d rows in %d batches from %s", sum(taken), len(taken), documents)
    rows, audit = stored(spark, output)
    return rows.withColumn("kind", F.lit("row")).unionByName(audit.withColumn("kind", F.lit("audit")), allowMissingColumns=True)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("config", "documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("prepare_training")
    try:
        config = spark.read.option("multiLine", True).json(args.config).first().asDict()
        prepare(spark, args.documents, args.output, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
