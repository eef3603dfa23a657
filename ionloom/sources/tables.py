"""Readers and sinks: column aliases, pushed filters, list files, arrays, stage dumps, content hashes."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which a column may come, in order of preference.
ALIASES = {"smiles": ["normalized_smiles", "canonical_smiles", "smiles"], "key": ["inchikey14", "inchikey", "key"], "mz": ["ms2_mzs", "mzs", "mz"], "intensity": ["ms2_normalized_intensities", "intensities", "intensity"], "precursor": ["precursor_mz", "precursor"], "mode": ["ionization_mode", "ion_mode", "mode"]}


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet, .csv, .tsv or .tsv.gz by ending."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    name = path.removesuffix(".gz")
    if name.endswith((".tsv", ".csv")):
        return reader.csv(path, header=True, sep="\t" if name.endswith(".tsv") else ",")
    if name.endswith(".json"):
        return reader.json(path)
    return reader.parquet(path)


def resolve(df: DataFrame, aliases: dict[str, list[str]] = ALIASES, required: tuple[str, ...] = ()) -> DataFrame:
    """df with the first present alias of each name under that name; ValueError if a required one is missing. Other columns stay."""
    taken = {name: next((a for a in names if a in df.columns), None) for name, names in aliases.items()}
    if missing := [n for n in required if taken.get(n) is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rest = [c for c in df.columns if c not in taken.values() and c not in taken]
    return df.select(*rest, *[F.col(a).alias(n) for n, a in taken.items() if a])


def wide_to_long(df: DataFrame, key: str, prefix: str, n: int, name: str) -> DataFrame:
    """prefix0 .. prefix(n-1) columns to (key, name, rank); blanks dropped."""
    columns = [F.struct(F.lit(i + 1).alias("rank"), F.col(f"{prefix}{i}").alias(name)) for i in range(n) if f"{prefix}{i}" in df.columns]
    rows = df.select(key, F.explode(F.array(*columns)).alias("x")).select(key, f"x.{name}", "x.rank")
    return rows.where(F.trim(F.coalesce(name, F.lit(""))) != "")


def signature(df: DataFrame, key: str) -> DataFrame:
    """One row: the number of distinct ids and an order-free hash of them, the exclusive or of 60 bits of each id's MD5."""
    ids = df.select(F.col(key).cast("string").alias("k")).where("k is not null").distinct()
    word = F.conv(F.substring(F.md5("k"), 1, 15), 16, 10).cast("long")
    return ids.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(word), F.lit(0)).alias("signature"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, what) of the files that two manifests don't agree on: missing, new or other (length or content)."""
    both = before.toDF("path", "l", "h").join(after.toDF("path", "m", "i"), "path", "full")
    what = F.when(F.col("i").isNull(), "missing").when(F.col("h").isNull(), "new").when((F.col("l") != F.col("m")) | (F.col("h") != F.col("i")), "other")
    return both.select("path", what.alias("what")).where("what is not null")


def write_parts(df: DataFrame, path: str, part: str) -> bool:
    """A resumable batch: written below path/part=<part> unless it is complete there."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/part={part}")
    return True


#: Rows of a partition of `together`.
PART_ROWS = 250_000


def together(df: DataFrame, sized_by: DataFrame, *keys: str) -> DataFrame:
    """df with rows of equal keys in one partition, in a number of partitions that grows with the rows of sized_by (a table read from files, whose footers hold
    its count), so that what a task holds doesn't grow with the table. What is grouped, joined or ordered by these keys and others afterwards isn't shuffled again."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-sized_by.count() // PART_ROWS)), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir. Without that setting there is none that a cluster shares; on a local master, where driver and executors are one process, a temporary folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/ionloom"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_columns(spark: SparkSession, path: str, columns: dict[str, str], required: list[str] = (), sep: str = ",") -> DataFrame:
    """The named columns (name to type) of a delimited file with a header; rows without a required one go. Others aren't parsed."""
    rows = read(spark, path) if sep == "," and path.endswith(".csv") else spark.read.csv(path, header=True, sep=sep)
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]).na.drop(subset=list(required))


def read_short_rows(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Lines of a delimited text file without header as strings; fields that a short line lacks are empty, further ones are left out."""
    lines = spark.read.text(path).select(F.split("value", sep, -1).alias("f"))
    return lines.select(*[F.coalesce(F.try_element_at("f", F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def write_lines(df: DataFrame, path: str, columns: list[Column], sep: str = "\t") -> None:
    """A delimited text file without quoting; null is empty, arrays are joined by commas."""
    kinds = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema
    cells = [F.array_join(c.cast("array<string>"), ",") if k.dataType.typeName() == "array" else c.cast("string") for c, k in zip(columns, kinds, strict=True)]
    df.select(F.concat_ws(sep, *[F.coalesce(c, F.lit("")) for c in cells]).alias("value")).write.mode("overwrite").text(path)


def replace(df: DataFrame, path: str) -> None:
    """Write df beside path and move it there when it is whole; readers see the old or the new table."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(fresh)
    fs, at = _fs(spark, path)
    if fs.exists(at):
        fs.rename(at, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, fresh)[1], at):
        raise OSError(f"{path} could not be replaced")
    fs.delete(_fs(spark, old)[1], True)


def dump_stage(df: DataFrame, path: str) -> DataFrame:
    """A stage written as JSON lines and read back with its schema; if it is there already it is only read."""
    spark = df.sparkSession
    fs, at = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(at):
        df.write.mode("overwrite").json(path)
    return spark.read.schema(df.schema).json(path)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or an empty one of the schema if there is none: a stage whose input is missing has nothing to add."""
    fs, at = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def discover(spark: SparkSession, root: str, name: str) -> str:
    """The file or folder of that name below root with the shortest path, ties to the first in order; FileNotFoundError if there is none."""
    fs, at = _fs(spark, root)
    found, todo = [], [at]
    while todo:
        for x in fs.listStatus(todo.pop()):
            if x.getPath().getName() == name:
                found.append(x.getPath().toString())
            elif x.isDirectory():
                todo.append(x.getPath())
    if not found:
        raise FileNotFoundError(f"{name} below {root}")
    return min(found, key=lambda x: (len(x), x))


def save_array(spark: SparkSession, path: str, array: np.ndarray) -> None:
    """A .npy artifact on any file system."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    fs, at = _fs(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(out.getvalue()))
    finally:
        stream.close()


def load_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values) of the .npy artifacts at path (one or two dimensions), read by the executors in batches; one conversion, then Parquet serves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.lib.format.read_array(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(np.float64)
                for i in range(0, len(x), 4096):
                    part = x[i : i + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), values], ["path", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, values array<double>")


def first_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the first n distinct ids in order: a smoke subset."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(ids), key, "left_semi") if n <= 100_000 else df.join(ids, key, "left_semi")


def capped(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows at most, the first by SHA-256 of seed and key: a cap that doesn't depend on the order of files."""
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("~"))), 256), key).limit(n)
