"""Exact top-k inner-product search: ball trees over shards of the space, searched by branch and bound.

Vectors go to the nearest of some centres, and the vectors of one centre to shards of bounded size. Each shard's tree is
built once and stored. A ball's inner products with a query q are at most q.c + |q| r (c its centre, r its radius). A query
meets shards in the order of the bound of their centre's ball, in ROUNDS: one shard, a few, and all others whose bound
reaches the kth score found so far, which is shared from round to round; a shard that can't reach it never sees the query.
Within a tree a query visits the child of the larger bound first, and nodes below its current kth score are skipped.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, remove, table

SCALE, TOP, EVERY = 1024, 10, 100
LEAF = 128
#: Rows of a shard at most (of fewer rows altogether, one in SHARDS), and queries that one task asks a shard.
SHARD_ROWS, SHARDS, ASKED = 65_536, 48, 50_000
#: Centres at most, and the rows they are fitted on; where a vector goes decides the work only, not the result.
CENTRES, SAMPLE, STEPS = 4096, 16_384, 3
#: Shards that a query meets up to the end of each round; the last round takes the others that its kth score allows.
ROUNDS = (1, 4)
_LONG = np.iinfo(np.int64)


class BallTree:
    """Nodes [first, end, centre, radius, left child, right child] over rows of x in an order of its own; -1 for no child."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[list] = []
        todo = [(0, len(x), -1, False)]
        while todo:
            a, b, parent, right = todo.pop()
            own = x[self.order[a:b]]
            centre = own.mean(0)
            distance = np.sqrt(((own - centre) ** 2).sum(1))
            self.nodes.append([a, b, centre, float(distance.max()), -1, -1])
            at = len(self.nodes) - 1
            if parent >= 0:
                self.nodes[parent][5 if right else 4] = at
            if b - a <= leaf or distance.max() == 0:
                continue
            far = own[distance.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            side = own @ (other - far)
            half = (b - a) // 2
            cut = np.argpartition(side, half)
            self.order[a:b] = self.order[a:b][cut]
            todo += [(a + half, b, at, True), (a, a + half, at, False)]

    def dump(self, x: np.ndarray, ids: np.ndarray) -> bytes:
        """The tree with its vectors and their ids, in tree order."""
        out = io.BytesIO()
        shape = np.array([[n[0], n[1], n[4], n[5]] for n in self.nodes], np.int64)
        small = x if np.abs(x).max(initial=0) >= 2**31 else x.astype(np.int32)
        for part in (shape, np.stack([n[2] for n in self.nodes]), np.array([n[3] for n in self.nodes]), small[self.order], ids[self.order]):
            np.lib.format.write_array(out, np.ascontiguousarray(part), allow_pickle=False)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> tuple[BallTree, np.ndarray, np.ndarray]:
        data = io.BytesIO(blob)
        shape, centre, radius, x, ids = (np.lib.format.read_array(data, allow_pickle=False) for _ in range(5))
        tree = cls.__new__(cls)
        tree.order = np.arange(len(x))
        tree.nodes = [[int(n[0]), int(n[1]), c, float(r), int(n[2]), int(n[3])] for n, c, r in zip(shape, centre, radius, strict=True)]
        return tree, x.astype(np.float64), ids


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floats while they are whole there, else in Python's integers, kept within a long."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    out = np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], object)
    return np.array([[min(max(v, _LONG.min), _LONG.max) for v in row] for row in out], np.int64)


def upper(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius) -> np.ndarray:
    """Bounds of the inner products of queries q with what is within radius of each centre, widened by more than rounding can take away."""
    value = q @ centre.T + norm[:, None] * radius
    return value + np.abs(value) * 1e-9 + norm[:, None] * 1e-6 + 1e-6


def search(tree: BallTree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int = TOP):
    """(query row, vector id, score) of each query's k best vectors of another id; floor is a score that the kth best is known to reach."""
    n = len(queries)
    best_s = np.full((n, k), _LONG.min)
    best_i = np.full((n, k), _LONG.max)
    kth = floor.copy()
    norm = np.sqrt((queries**2).sum(1))

    def visit(node, rows):
        a, b, _, _, left, right = tree.nodes[node]
        if left < 0:
            for at in range(a, b, 4 * LEAF):  # a node of equal vectors may be long
                take = tree.order[at : min(b, at + 4 * LEAF)]
                s = _scores(queries[rows], vectors[take])
                own = ids[take][None, :] == query_ids[rows][:, None]
                i = np.where(own, _LONG.max, ids[take][None, :])
                s = np.where(own, _LONG.min, s)
                s, i = np.concatenate([best_s[rows], s], 1), np.concatenate([best_i[rows], i], 1)
                order = _order(s, i, k)
                best_s[rows] = np.take_along_axis(s, order, 1)
                best_i[rows] = np.take_along_axis(i, order, 1)
                kth[rows] = np.maximum(kth[rows], best_s[rows, k - 1])
            return
        up = upper(queries[rows], norm[rows], np.stack([tree.nodes[c][2] for c in (left, right)]), np.array([tree.nodes[c][3] for c in (left, right)]))
        for side in (0, 1):  # those that prefer the left child, then the others
            mine = (up[:, 0] >= up[:, 1]) == (side == 0)
            for child, reach in ((left, up[:, 0]), (right, up[:, 1]))[:: 1 if side == 0 else -1]:
                some = rows[mine & (reach >= kth[rows])]
                if len(some):
                    visit(child, some)

    visit(0, np.arange(n))
    found = best_i != _LONG.max
    row, place = np.nonzero(found)
    return row, best_i[row, place], best_s[row, place]


def _order(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest s, ties to the smaller i. -1 - s turns the order round without overflow."""
    return np.lexsort((i, -1 - s), axis=1)[:, :k]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, np.float64) for v in column]) * SCALE)


def _by_length(column: pa.Array):
    """(length, places, matrix) of the vectors of each length."""
    v = column.to_pandas()
    length = v.map(len).to_numpy()
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        yield d, at, _matrix(v.iloc[at])


def fit_centres(sample: pd.Series, many: int) -> dict[int, np.ndarray]:
    """Centres of the vectors of each length: at most `many` altogether, by STEPS of k-means from evenly spaced rows."""
    out = {}
    length = sample.map(len).to_numpy()
    for d, n in zip(*np.unique(length, return_counts=True), strict=True):
        x = _matrix(sample[length == d])
        first = np.linspace(0, n - 1, max(1, round(many * n / len(sample)))).astype(np.int64)
        centres = np.unique(x[first], axis=0)
        for _ in range(STEPS):
            home = _nearest(x, centres)[0]
            size = np.bincount(home, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, home, x)
            centres = sums[size > 0] / size[size > 0][:, None]
        out[int(d)] = centres
    return out


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance to it."""
    home, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
    squares = (centres**2).sum(1)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        home[i : i + step] = (squares[None, :] - 2 * part @ centres.T).argmin(1)
        gap[i : i + step] = np.sqrt(((part - centres[home[i : i + step]]) ** 2).sum(1))
    return home, gap


def _placed(centres):
    """(vec_id, v, d, centre, gap) of (vec_id, v): the nearest centre of that length and the distance; centre -1, the origin, for a length without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            length, home, gap = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n)
            for d, at, x in _by_length(batch.column(1)):
                length[at] = d
                if d in centres.value:
                    home[at], gap[at] = _nearest(x, centres.value[d])
                else:
                    gap[at] = np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(home), pa.array(gap)], ["vec_id", "v", "d", "centre", "gap"])

    return run


def _trees(key, rows):
    x = _matrix(rows["v"].to_pandas())
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([BallTree(x).dump(x, rows["vec_id"].to_numpy())], pa.binary())], ["shard", "tree"])


def _routes(balls, first: int, end: int | None):
    """(shard, query_id, row) of (query_id, row, q, floor): for each query the shards in places first to end of the order of their bounds, as far as these reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, q in _by_length(batch.column(2)):
                if d not in balls.value:
                    continue
                centre, radius, parts, start = balls.value[d]
                floor = batch.column(3).to_numpy()[at]
                up = upper(q, np.sqrt((q**2).sum(1)), centre, radius)
                order = np.argsort(-up, axis=1, kind="stable")
                # a centre's shards follow each other in that order; lo and hi are its first shard and the end of those taken
                before = np.cumsum(parts[order], axis=1) - parts[order]
                last = np.iinfo(np.int64).max if end is None else end
                lo = np.clip(first - before, 0, parts[order])
                hi = np.where(np.take_along_axis(up, order, 1) >= floor[:, None], np.clip(last - before, 0, parts[order]), lo)
                many = np.maximum(hi - lo, 0).ravel()
                shard = np.repeat((start[order] + lo).ravel(), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                who = pa.array(np.repeat(np.repeat(at, len(parts)), many))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0).take(who), batch.column(1).take(who)], ["shard", "query_id", "row"])

    return run


def _searched(k: int):
    def run(key, tree: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(tree) or not len(asked):
            found = [np.zeros(0, np.int64)] * 4
        else:
            ids, row = asked["query_id"].to_numpy(), asked["row"].to_numpy()
            at, i, s = search(*BallTree.load(tree["tree"][0].as_py()), _matrix(asked["q"].to_pandas()), ids, asked["floor"].to_numpy().copy(), k)
            found = [ids[at], row[at], i, s]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each row whose vec_id is divisible by `every`.

    Vectors (vec_id, embedding) are scaled and floored to whole numbers. A vector that is null, holds a null or a
    component that isn't finite takes no part, nor does a row without vec_id; vectors of different lengths don't meet.
    Rows of one vec_id aren't each other's candidates; a repeated query row is answered once for each of its rows.
    Scores beyond a long are kept within it.
    """
    spark, paths = vectors.sparkSession, []
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    size = max(1, min(SHARD_ROWS, math.ceil(n / SHARDS)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).toPandas()["v"]
    centres = spark.sparkContext.broadcast(fit_centres(sample, max(1, min(CENTRES, n // size))))
    placed = rows.mapInArrow(_placed(centres), "vec_id long, v array<double>, d int, centre int, gap double")
    placed = cut(placed.withColumn("no", F.monotonically_increasing_id()), "topk-vectors", paths)

    # a row for each centre, and one for each length without any
    balls = placed.groupBy("d", "centre").agg(F.count("*").alias("many"), F.max("gap").alias("radius")).orderBy("d", "centre").toPandas()
    balls["parts"] = -(-balls["many"] // size)
    balls["start"] = balls["parts"].cumsum() - balls["parts"]
    origin = {d: np.vstack([np.zeros((1, int(d))), centres.value.get(int(d), np.zeros((0, int(d))))]) for d in balls["d"].unique()}
    known = spark.sparkContext.broadcast({int(d): (origin[d][g["centre"].to_numpy() + 1], g["radius"].to_numpy(), g["parts"].to_numpy(), g["start"].to_numpy()) for d, g in balls.groupby("d")})
    numbers = spark.createDataFrame([tuple(map(int, x)) for x in balls[["d", "centre", "parts", "start"]].itertuples(index=False)], "d int, centre int, parts long, start long")
    shard = (F.col("start") + F.pmod(F.xxhash64("vec_id", "no"), F.col("parts"))).alias("shard")
    dealt = placed.join(F.broadcast(numbers), ["d", "centre"]).select(shard, "vec_id", "v")
    trees = cut(dealt.groupBy("shard").applyInArrow(_trees, "shard long, tree binary"), "topk-trees", paths)

    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.xxhash64("vec_id", "v").alias("row"))
    asked = cut(asked.groupBy("query_id", "row", "q").agg(F.count("*").alias("copies")), "topk-queries", paths)
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    found, floors = None, None
    for first, end in zip((0, *ROUNDS), (*ROUNDS, None), strict=True):
        floored = asked.withColumn("floor", F.lit(_LONG.min)) if floors is None else asked.join(floors, ["query_id", "row"], "left").withColumn("floor", F.coalesce("floor", F.lit(_LONG.min)))
        floored = floored.select("query_id", "row", "q", "floor")
        routes = cut(floored.mapInArrow(_routes(known, first, end), "shard long, query_id long, row long"), "topk-routes", paths)
        # a shard that many queries ask is copied for each ASKED of them
        copies = routes.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).alias("copies"))
        copied = trees.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "tree")
        ask = routes.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("query_id", "row"), F.col("copies"))).join(floored, ["query_id", "row"])
        ask = ask.select("shard", "copy", "query_id", "row", "q", "floor").toDF("s", "c", "query_id", "row", "q", "floor")
        new = copied.groupBy("shard", "copy").cogroup(ask.groupBy("s", "c")).applyInArrow(_searched(k), "query_id long, row long, vec_id long, score long")
        new = new if found is None else found.union(new)
        found = cut(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "topk-found", paths)
        floors = found.groupBy("query_id", "row").agg(F.min("score").alias("floor"), F.count("*").alias("has")).where(F.col("has") >= k).drop("has")
    out = found.withColumn("rank", F.row_number().over(best)).join(asked.select("query_id", "row", "copies"), ["query_id", "row"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = cut(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk")
    remove(spark, paths)
    return out


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k of all embeddings: 10 best of each query."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op7_top_k": op7_top_k}

ORACLE = {
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
}
