"""Shared helpers: the folder all executors see, size-checked broadcasts, vectorised text hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: Rows below which a table of short rows may be broadcast; above it the join is shuffled.
BROADCAST_ROWS = 100_000


#: A new path in the folder that the cluster shares.
shared_dir = scratch


def cut(df: DataFrame, name: str = "cut", paths: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends in files that outlive executors. The path is added to paths, for remove()."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def hide(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed so that none clashes with a helper column, and the new name of each."""
    names = {c: f"own column {i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(names: dict[str, str]) -> list[Column]:
    """The columns that hide() renamed, under their own names."""
    return [F.col(f"`{new}`").alias(c) for c, new in names.items()]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches that carry whole texts to Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df has at most `rows` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectorised hashing of texts

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MAX = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U(33))
        x = x * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _MAX)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size, b, np.uint64)])) for b in (_U(_BASE), _U(inverse))]
    return _powers[0], _powers[1]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = _MAX):
    """Row ranges of at most `most` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, lower: np.ndarray = _LOWER):
    """Words between bytes marked in `space`, lower-cased by table: (row of each word, hash of each word)."""
    row, hashes, _ = stems_of(data, offsets, 0, space, lower)
    return row, hashes


def stems_of(data: np.ndarray, offsets: np.ndarray, size: int, space: np.ndarray = _SPACE, lower: np.ndarray = _LOWER):
    """As words_of, and the hash of each word's first `size` characters (of the whole word if it is shorter; none for size 0)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = lower[data]
    gap = space[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    power, inverse = _power_tables(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        span = lambda stops: mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        hashes = span(ends)
        stems = hashes[:0]
        if size:
            heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), np.full(size, n))
            stems = span(np.minimum(ends, heads[np.searchsorted(heads, starts) + size]))
    return np.searchsorted(offsets[1:], starts, "right"), hashes, stems


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Distinct hashed k-word shingles, ascending in each row: (row of each, hash of each). A row of fewer words, but not none, has one."""
    row, word = words_of(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for i in range(k):
            rolled = rolled * _U(0x9DDFEA08EB382D69) + word[i : i + len(rolled)]
        keep = row[: len(rolled)] == row[k - 1 :] if len(rolled) else np.zeros(0, bool)
        docs, hashes = row[: len(rolled)][keep], rolled[keep]
        first = np.cumsum(count) - count
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            short = np.full(len(few), 0x51ED270B, np.uint64) + count[few].astype(np.uint64)
            for i in range(k - 1):
                has = count[few] > i
                short[has] = short[has] * _U(0xD6E8FEB86659FD93) + word[first[few[has]] + i]
            docs, hashes = np.concatenate([docs, few]), np.concatenate([hashes, short])
    hashes = mix(hashes)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]
