"""Sharding along a Hilbert curve, for files that can be pruned by several metadata dimensions at once.

Each dimension (by default size, language and source) is cut into 2 ** BITS coordinates that hold about as many rows each,
the coordinates are laid on one curve, rows are sorted by their place on it, and the sorted run is cut into shards. Rows near
in all dimensions stand near on the curve, so a shard covers a narrow box and a query for a box reads few shards.

The sort is a range partitioning followed by a sort inside each partition; it is written once with each row's place in its
partition, so places never depend on a second evaluation, and only the row counts of partitions are summed up. Rows that are
alike in all sort columns are told apart by their place in the input, so that any number of copies spreads over tasks.

Nulls: a null text has size 1 and the CRC of an empty one; a null category is one value like the empty one; a null doc_id is
an ordinary row. Repeated rows are rows of their own and stand next to each other; equal texts of one cell do as well. An
empty table gives no rows. Columns with the names of helpers keep their values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hide, remove, shown, table

#: Bits of a coordinate; with three dimensions the curve has 2 ** 18 cells.
BITS = 6
SHARDS = 16
#: A category's bin is so many leading hex digits of its MD5, so histograms have at most 65,536 bins a dimension.
HEX = 4


def size_bin(size: Column) -> Column:
    """The exponent of two and the four bits below the leading one, as one number: a scale of fixed relative width in whole numbers."""
    e = F.length(F.bin(size)) - 1
    return (e * 16 + F.floor(size * 16 / F.pow(F.lit(2.0), e)) - 16).cast("int")


def category_bin(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, HEX), 16, 10).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


#: Dimension and its bin, from the columns of a document; at most 65,536 bins each.
DIMENSIONS = {"size": lambda c: size_bin(text_size(c("text"))), "lang": lambda c: category_bin(c("lang")), "source": lambda c: category_bin(c("source"))}


def hilbert(coordinates: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a point with coordinates in [0, 2 ** bits), by the transpose form of the curve (Skilling 2004): one fold over bits and dimensions."""
    n = len(coordinates)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("q")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        own, first, low = F.get(x, s["i"]), F.get(x, F.lit(0)), s["q"] - 1
        set_ = own.bitwiseAND(s["q"]) != 0
        invert = F.when(set_, low).otherwise(0)
        swap = F.when(set_, 0).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, j: v.bitwiseXOR(F.when(j == 0, invert.bitwiseXOR(swap)).when(j == s["i"], swap).otherwise(0)))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in coordinates]), step) if bits > 1 else F.array(*coordinates)
    # Gray code: each coordinate takes in those before it
    gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def interleave(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda a, q: a.bitwiseXOR(F.when(last.bitwiseAND(q) != 0, q - 1).otherwise(0))) if bits > 1 else F.lit(0)
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda p: F.call_function("shiftright", F.get(g, p["i"]).bitwiseXOR(t), p["b"]).bitwiseAND(1)
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a * 2 + bit(p))

    return F.get(F.transform(F.array(gray), interleave), F.lit(0))


def histogram(rows: DataFrame, bins: list[str], bits: int = BITS) -> DataFrame:
    """(dimension, bin, coordinate): bins in order, cut where the rows before them reach the next 1 / 2 ** bits of all rows. One pass over rows, with a row for each bin and task shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dimension"), F.col(f"`{b}`").alias("bin")) for i, b in enumerate(bins)]))
    counts = rows.select(each.alias("x")).select("x.*").groupBy("dimension", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dimension")  # a dimension has at most 65,536 bins
    before = F.sum("n").over(w.orderBy("bin")) - F.col("n")
    return counts.withColumn("coordinate", F.floor(before * (1 << bits) / F.sum("n").over(w)).cast("int")).select("dimension", "bin", "coordinate")


def on_curve(rows: DataFrame, bins: list[str], cells: DataFrame, bits: int = BITS) -> DataFrame:
    """rows with their coordinates, named as their bins and " coordinate", and their place on the curve. Histograms are bounded, so they are broadcast."""
    for i, b in enumerate(bins):
        own = cells.where(F.col("dimension") == i).select(F.col("bin").alias(b), F.col("coordinate").alias(f"{b} coordinate"))
        rows = rows.join(F.broadcast(own), b)
    return rows.withColumn("curve", hilbert([F.col(f"`{b} coordinate`") for b in bins], bits))


def ranked(rows: DataFrame, keys: list[str], paths: list[str] | None = None) -> DataFrame:
    """rows with their place (from 0) in the order of keys. The sorted rows are written once; rows alike in keys may swap places."""
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys] + [F.col("input place").asc()]
    rows = rows.withColumn("input place", F.monotonically_increasing_id())
    # a range of the keys is one task's share; the place in the input parts a run of copies
    run = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("input place")
    run = cut(run.withColumn("place", F.monotonically_increasing_id()), "sharding-run", paths)
    task, inner = F.shiftright("place", 33).alias("task"), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = run.groupBy(task).agg(F.count("*").alias("n"))  # a row for each task that sorted
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return run.withColumn("task", task).join(F.broadcast(before), "task").withColumn("place", F.col("before") + inner).drop("task", "before")


def cut_runs(rows: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """rows with shard and slot: the run of places cut so that shards differ by at most one row (law rows), or hold about the same sum of `size` (law bytes)."""
    if law == "rows":
        n = rows.count()
        shard = F.expr(f"place * {shards} div {max(n, 1)}")
        start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")  # the first place of a shard
        return rows.withColumn("shard", shard).withColumn("slot", F.col("place") - start).withColumn("shard", F.col("shard").cast("int"))
    if law != "bytes":
        raise ValueError(f"unknown law {law}: rows or bytes")
    # places come in blocks, so bytes before a row are those of earlier blocks and of its own
    block = F.floor(F.col("place") / 65536)
    rows = rows.withColumn("block", block)
    sums = rows.groupBy("block").agg(F.sum("size").alias("sum"))
    before = sums.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("all"))
    inner = F.sum("size").over(Window.partitionBy("block").orderBy("place")) - F.col("size")
    out = rows.join(before, "block").withColumn("shard", F.least(F.floor((F.col("before") + inner) * shards / F.col("all")), F.lit(shards - 1)).cast("int"))
    starts = out.groupBy("shard").agg(F.min("place").alias("start"))
    return out.join(F.broadcast(starts), "shard").withColumn("slot", F.col("place") - F.col("start")).drop("block", "before", "all", "start")


def _measured(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under hidden names with size, text_crc32 and the bins, and the hidden names."""
    rows, names = hide(docs)
    own = lambda c: F.col(f"`{names[c]}`")
    rows = rows.withColumns({"size": text_size(own("text")), "text_crc32": F.crc32(F.coalesce(own("text"), F.lit("")).cast("binary"))} | {f"{k} bin": f(own) for k, f in DIMENSIONS.items()})
    return rows, names


_BINS = [f"{k} bin" for k in DIMENSIONS]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes") -> None:
    """Files below path: rows/shard=N with the documents along the curve, manifest with each shard's rows, bytes and ranges of coordinates, and cells with the coordinate of each bin. read_box() uses them. A column named shard or curve_place is replaced."""
    spark, paths = docs.sparkSession, []
    rows, names = _measured(docs)
    rows = cut(rows, "sharding-rows", paths)
    histogram(rows, _BINS).write.mode("overwrite").parquet(f"{path}/cells")
    run = ranked(on_curve(rows, _BINS, spark.read.parquet(f"{path}/cells")), ["curve", "text_crc32", names["doc_id"], "size"], paths)
    out = cut_runs(run, shards, law)
    at = F.struct("size", "slot", *[F.col(f"`{b} coordinate`").alias(f"{k}_at") for k, b in zip(DIMENSIONS, _BINS, strict=True)]).alias("curve_place")
    kept = {c: n for c, n in names.items() if c not in ("shard", "curve_place")}
    out.select(*shown(kept), at, "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows")
    ranges = [f(F.col(f"curve_place.{k}_at")).alias(f"{k}_{n}") for k in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
    stored = spark.read.parquet(f"{path}/rows").select("shard", "curve_place")
    stored.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("curve_place.size").alias("bytes"), F.max("curve_place.slot").alias("last_slot"), *ranges).write.mode("overwrite").parquet(f"{path}/manifest")
    remove(spark, paths)


def shards_of_box(spark: SparkSession, path: str, size: tuple[int, int] | None = None, lang: list[str | None] | None = None, source: list[str | None] | None = None) -> list[int]:
    """The shards that can hold documents of a size between two bounds (both inclusive), of the languages and of the sources; by the manifest alone, which has a row for each shard."""
    cells, fits = spark.read.parquet(f"{path}/cells"), F.lit(True)
    for i, (k, wanted) in enumerate(zip(DIMENSIONS, (size, lang, source), strict=True)):
        if wanted is None:
            continue
        values = spark.createDataFrame([(v,) for v in wanted], "v bigint" if k == "size" else "v string").select((size_bin if k == "size" else category_bin)(F.col("v")).alias("bin"))
        own = cells.where(F.col("dimension") == i)
        if k == "size":
            lo, hi = values.agg(F.min("bin"), F.max("bin")).first()
            own = own.where(F.col("bin").between(lo, hi))
        else:
            own = own.join(F.broadcast(values), "bin", "left_semi")
        found = [r[0] for r in own.select("coordinate").distinct().collect()]  # 2 ** BITS at most
        fits = fits & reduce(lambda a, b: a | b, [F.lit(c).between(F.col(f"{k}_min"), F.col(f"{k}_max")) for c in found], F.lit(False))
    return sorted(r[0] for r in spark.read.parquet(f"{path}/manifest").where(fits).select("shard").collect())


def read_box(spark: SparkSession, path: str, size: tuple[int, int] | None = None, lang: list[str | None] | None = None, source: list[str | None] | None = None) -> DataFrame:
    """The documents of a box, from the files of its shards alone; the columns of documents and shard."""
    rows = spark.read.parquet(f"{path}/rows").where(F.col("shard").isin(shards_of_box(spark, path, size, lang, source)))
    if size is not None:
        rows = rows.where(F.col("curve_place.size").between(*size))
    for column, wanted in (("lang", lang), ("source", source)):
        if wanted is not None:
            own = F.col(column).isin([v for v in wanted if v is not None])
            rows = rows.where(own | F.col(column).isNull() if None in wanted else own)
    return rows.drop("curve_place")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: the curve's run is cut at every n / 16 rows. Slots count the rows of a shard along the curve."""
    rows, names = _measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    rows = rows.withColumnRenamed(names["doc_id"], "doc_id").select("doc_id", "size", "text_crc32", *[f"`{b}`" for b in _BINS])
    rows = cut(rows, "sharding-rows")  # the texts are read once
    run = ranked(on_curve(rows, _BINS, cut(histogram(rows, _BINS), "sharding-cells")), ["curve", "text_crc32", "doc_id", "size"])
    return cut_runs(run, SHARDS, "rows").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op12_sharding": op12_sharding}


def _sql() -> str:
    """CRC-32 by a table of its 256 steps, histograms by windows, the curve by one common table for each step of the fold."""
    n = len(DIMENSIONS)
    steps, last = [], "h0"
    names = ["x0", "x1", "x2"]
    for b in range(BITS - 1, 0, -1):
        for i in range(n):
            q, p, new = 1 << b, (1 << b) - 1, f"h{len(steps) + 1}"
            on = f"(x{i} & {q}) <> 0"
            x0 = f"CASE WHEN {on} THEN xor(x0, {p}) ELSE xor(x0, xor(x0, x{i}) & {p}) END"
            others = [x0] + [f"CASE WHEN {on} THEN x{j} ELSE xor(x{j}, xor(x0, x{j}) & {p}) END" if j == i else f"x{j}" for j in (1, 2)]
            steps.append(f"{new} AS (SELECT c0, c1, c2, {', '.join(f'{e} AS {m}' for e, m in zip(others, names, strict=True))} FROM {last})")
            last = new
    gray = "SELECT c0, c1, c2, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2"
    low = "0"
    for b in range(BITS - 1, 0, -1):
        low = f"xor({low}, CASE WHEN g2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    index = " + ".join(f"((xor(g{i}, t) >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(BITS - 1, -1, -1) for i in range(n))
    coordinate = "".join(f", k{i} AS (SELECT bin{i}, CAST(floor((sum(count(*)) OVER (ORDER BY bin{i}) - count(*)) * {1 << BITS} / sum(count(*)) OVER ()) AS INTEGER) AS c{i} FROM m GROUP BY bin{i})" for i in range(n))
    category = lambda c: f"CAST('0x' || substr(md5(coalesce({c}, '')), 1, {HEX}) AS INTEGER)"
    return f"""
WITH RECURSIVE e(i, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM e WHERE k < 8),
 tab AS (SELECT list(v ORDER BY i) AS t FROM e WHERE k = 8),
 b AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
 m AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295), 4294967295) AS crc,
  CAST((length(bin(size)) - 1) * 16 + ((size * 16) >> (length(bin(size)) - 1)) - 16 AS INTEGER) AS bin0, {category("lang")} AS bin1, {category("source")} AS bin2 FROM b, tab){coordinate},
 p AS (SELECT doc_id, size, crc, c0, c1, c2 FROM m JOIN k0 USING (bin0) JOIN k1 USING (bin1) JOIN k2 USING (bin2)),
 h0 AS (SELECT DISTINCT c0, c1, c2, c0 AS x0, c1 AS x1, c2 AS x2 FROM p),
 {", ".join(steps)},
 g AS ({gray} FROM {last}), gt AS (SELECT *, {low} AS t FROM g), cv AS (SELECT c0, c1, c2, {index} AS curve FROM gt),
 r AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST, size) - 1 AS place, count(*) OVER () AS n FROM p JOIN cv USING (c0, c1, c2)),
 s AS (SELECT *, (place * {SHARDS}) // n AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


ORACLE = {"op12_sharding": _sql()}
