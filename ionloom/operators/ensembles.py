"""Ensembles of regression trees as tables, grown and applied by Spark.

A table of trees has a row for each node: (tree, node, feature, threshold, value); the children of node n are 2 n (at most the threshold) and 2 n + 1, the
root is 1, and a leaf has no feature. Rows are scored by a fold down each tree, so any booster that is written as such a table can be applied,
features by name. Growing takes two aggregates a level over all rows, whatever their number, and a table of nodes on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TREES = "tree int, node int, feature string, threshold double, value double"
#: Nodes of one table.
MOST = 100_000


def _steps(features: list[str]) -> Column:
    """The row's features as an array, in the order in which nodes refer to them; missing ones are 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def scores(df: DataFrame, trees: DataFrame, features: list[str], name: str = "score", base: float = 0.0) -> DataFrame:
    """df with base plus the sum over trees of the value of the leaf that a row falls in. ValueError for a feature that isn't among features."""
    nodes = trees.limit(MOST + 1).collect()
    if len(nodes) > MOST:
        raise ValueError(f"more than {MOST} nodes")
    if unknown := {r.feature for r in nodes if r.feature is not None} - set(features):
        raise ValueError(f"unknown features: {', '.join(sorted(unknown))}")
    if not nodes:
        return df.withColumn(name, F.lit(base))
    place = {c: i for i, c in enumerate(features)}
    by_tree: dict[int, dict[int, Row]] = {}
    for r in nodes:
        by_tree.setdefault(r.tree, {})[r.node] = r
    # a tree as an array of its nodes by number, and all trees as one row that is broadcast
    kind = "trees array<array<struct<f:int,t:double,v:double>>>"
    table = [[(-1 if n not in t or t[n].feature is None else place[t[n].feature], t[n].threshold if n in t else None, t[n].value if n in t else None) for n in range(1, max(t) + 1)] for _, t in sorted(by_tree.items())]
    model = df.sparkSession.createDataFrame([(1, table)], f"_one int, {kind}")
    depth = max(max(t) for t in by_tree.values()).bit_length()
    down = F.sequence(F.lit(1), F.lit(depth))

    def leaf(tree):
        node = lambda n: F.get(tree, n - 1)
        step = lambda n, _: F.when(node(n)["f"] < 0, n).otherwise(2 * n + F.when(F.get("_x", node(n)["f"]) <= node(n)["t"], 0).otherwise(1))
        return node(F.aggregate(down, F.lit(1), step))["v"]

    rows = df.withColumns({"_x": _steps(features), "_one": F.lit(1)}).join(F.broadcast(model), "_one")
    return rows.withColumn(name, F.aggregate("trees", F.lit(float(base)), lambda s, t: s + leaf(t))).drop("_x", "_one", "trees")


def saved_trees(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """The table of a boosted model of pyspark.ml that was saved at path, its features named in their order; leaf values have the trees' weights. Of a classifier the
    probability is the sigmoid of twice the score. Only splits at thresholds are known; ValueError for one by categories."""
    weights = {r["_1"]: r["_3"] for r in spark.read.parquet(f"{path}/treesMetadata").select("_1", "_3").collect()}
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").limit(MOST + 1).collect()
    if len(nodes) > MOST:
        raise ValueError(f"more than {MOST} nodes")
    found = {(r["treeID"], r["id"]): r for r in nodes}
    rows, todo = [], [(tree, 0, 1) for tree in sorted(weights)]
    while todo:
        tree, own, place = todo.pop()
        r = found[tree, own]
        if r["leftChild"] < 0:
            rows.append((tree, place, None, None, weights[tree] * r["prediction"]))
            continue
        if r["split"]["numCategories"] >= 0:
            raise ValueError("splits by categories aren't known")
        rows.append((tree, place, features[r["split"]["featureIndex"]], float(r["split"]["leftCategoriesOrThreshold"][0]), None))
        todo += [(tree, r["leftChild"], 2 * place), (tree, r["rightChild"], 2 * place + 1)]
    return spark.createDataFrame(rows, TREES)


def grow(df: DataFrame, features: list[str], target: str, depth: int, tree: int = 0, rate: float = 1.0) -> list[tuple]:
    """The rows of one tree: each node is split at the mean of the feature that lessens the squared error most (ties to the first feature by name), a node that no feature splits is a
    leaf, and a leaf's value is rate times the mean target. Thresholds and gains are rounded to nine digits."""
    rows = df.select(target, *features).na.fill(0.0, features)
    found: dict[int, tuple] = {}
    for level in range(depth + 1):
        at = rows.withColumn("_n", _node(found, level))
        if level == depth:
            values = at.groupBy("_n").agg(F.avg(target).alias("v")).collect()
            found |= {r["_n"]: (tree, r["_n"], None, None, rate * r["v"]) for r in values if r["_n"] is not None}
            break
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in features])).alias("e")
        long = at.where("_n is not null").select("_n", target, each).select("_n", F.col(target).cast("double").alias("y"), "e.*")
        means = long.groupBy("_n", "f").agg(F.round(F.avg("x"), 9).alias("t"))  # a row for each node and feature
        low = F.col("x") <= F.col("t")
        sums = long.join(F.broadcast(means), ["_n", "f"]).groupBy("_n", "f", "t").agg(F.count_if(low).alias("a"), F.count_if(~low).alias("b"), F.sum(F.when(low, F.col("y")).otherwise(0.0)).alias("s"), F.sum("y").alias("all"))
        for n, own in _grouped(sums.collect()).items():
            total, count = own[0]["all"], own[0]["a"] + own[0]["b"]
            able = [(-round(r["s"] ** 2 / r["a"] + (total - r["s"]) ** 2 / r["b"], 9), r["f"], r["t"]) for r in own if r["a"] and r["b"]]
            found[n] = (tree, n, *min(able)[1:], None) if able else (tree, n, None, None, rate * total / count)
    return [found[n] for n in sorted(found)]


def _grouped(rows: list[Row]) -> dict[int, list[Row]]:
    out: dict[int, list[Row]] = {}
    for r in rows:
        out.setdefault(r["_n"], []).append(r)
    return out


def _node(found: dict[int, tuple], level: int) -> Column:
    """The node of a level that a row has reached, null if it has ended in a leaf above."""
    at = F.lit(1)
    for step in range(level):
        here = [n for n in found if n.bit_length() == step + 1]
        new = F.lit(None).cast("int")
        for n in here:
            if found[n][2] is not None:
                new = F.when(at == n, 2 * n + F.when(F.col(found[n][2]) <= found[n][3], 0).otherwise(1)).otherwise(new)
        at = new
    return at


def boost(df: DataFrame, features: list[str], label: str, rounds: int, depth: int, rate: float = 0.3) -> tuple[DataFrame, float]:
    """(trees, base): each tree grows on what the mean and the trees before it leave of the label."""
    spark = df.sparkSession
    base, trees = float(df.agg(F.avg(label)).first()[0] or 0.0), []
    for n in range(rounds):
        rest = scores(df, spark.createDataFrame(trees, TREES), features, "_f", base).withColumn("_r", F.col(label) - F.col("_f"))
        trees += grow(rest, features, "_r", depth, n, rate)
    return spark.createDataFrame(trees, TREES), base
