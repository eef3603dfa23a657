"""Leak-free splits, novelty classes, content deduplication and output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_holdout(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """(key, held): of the distinct keys in order of SHA-256(seed + key) the first max(2, n share) are held out.

    The rank is counted by hash range, so no task sees all keys.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct().withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(key)), 256))
    keys = keys.withColumn("_b", F.substring("_h", 1, 3))
    n = keys.groupBy("_b").agg(F.count("*").alias("n"))  # at most 4,096 rows
    before = n.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    ranked = keys.join(F.broadcast(before.drop("n")), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    return ranked.select(key, (F.col("_r") <= F.greatest(F.lit(2), F.floor(F.col("_all") * share))).alias("held"))


def group_split(df: DataFrame, group: str, source: str, held_sources: list[str], how: str) -> DataFrame:
    """(group, held): all (library split) or any (natural-product split) of a group's rows come from the held sources."""
    inside = F.coalesce(F.col(source).isin(held_sources), F.lit(False))
    return df.groupBy(group).agg((F.bool_and if how == "all" else F.bool_or)(inside).alias("held"))


def novelty(df: DataFrame, train: DataFrame, database: DataFrame, key: str) -> DataFrame:
    """(key, novelty): 1 if in train, 2 if in the database only, 3 if in neither."""
    keys = df.select(key).distinct()
    t, d = train.select(key).distinct().withColumn("_t", F.lit(1)), database.select(key).distinct().withColumn("_d", F.lit(1))
    rows = keys.join(t, key, "left").join(d, key, "left")
    return rows.select(key, F.when(F.col("_t").isNotNull(), 1).when(F.col("_d").isNotNull(), 2).otherwise(3).alias("novelty"))


def content_dedup(df: DataFrame, columns: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """One row per SHA-256 of the columns' content, the smallest in order; nulls equal each other, and rows without an order come last.

    Each part is preceded by its length, so that different contents never read the same. Of each row the columns `keep`
    (by default all) and digest stay; only these are shuffled.
    """
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    parts = [F.coalesce(part(F.col(c).cast("string")), F.lit("n")) for c in columns]
    rows = df.withColumn("digest", F.sha2(F.concat(*parts), 256))
    whole = F.struct(*[F.col(c) for c in (*(df.columns if keep is None else keep), "digest")])
    first = rows.groupBy("digest").agg(F.min_by(whole, F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("by"))).alias("row"))
    return first.select("row.*")


def check_lists(lists: DataFrame, ids: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(rule, broken): violations of the output contract of ranked lists, by one pass over lists and ids."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    sizes = lists.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(F.when(~blank, F.col(key))).alias("d"), F.count_if(blank).alias("blank"), F.max("rank").alias("last"))
    rows = sizes.join(ids.select(group).distinct().withColumn("known", F.lit(True)), group, "full")
    rules = {"missing_id": F.col("n").isNull(), "unknown_id": F.col("known").isNull(), "too_long": F.col("n") > n, "duplicate_key": F.col("d") < F.col("n") - F.col("blank"), "blank_key": F.col("blank") > 0, "rank_gap": F.col("last") != F.col("n")}
    counts = rows.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("broken")) for rule in rules])).alias("x")).select("x.*")


def audit(df: DataFrame, rules: list[tuple[str, Column]], content: list[str], order: str) -> DataFrame:
    """(reason, n): rows by the first rule that rejects them; of the others all but the first of equal content are duplicates."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    rows = df.select(*content, order, reason.alias("reason"))
    first = F.row_number().over(Window.partitionBy(*content).orderBy(order)) > 1
    kept = rows.where("reason is null").withColumn("reason", F.when(first, "duplicate").otherwise("accepted"))
    return rows.where("reason is not null").unionByName(kept).groupBy("reason").agg(F.count("*").alias("n"))


def withhold(df: DataFrame, held: DataFrame, key: str, truth: str) -> DataFrame:
    """df with held, and withheld for the true rows of held keys, which a simulation must not find."""
    return df.join(held, key).withColumn("withheld", F.col("held") & F.col(truth))


def candidate_sets(df: DataFrame, key: str, group: str, formula: str, mass: str, n: int) -> DataFrame:
    """(key, item, rank, truth): each row itself, then n decoys of its group, those of its formula first, then by distance in mass.

    The decoys of one formula are among the n nearest on either side there, those of another among the n nearest of the
    group, so windows of 2 n + 1 neighbours suffice and no pairs of a group are made.
    """
    from .bandjoin import nearest_values

    rows = df.select(key, group, formula, mass)
    same = nearest_values(rows.withColumn("_g", F.concat_ws("\x1f", F.col(group).cast("string"), F.col(formula).cast("string"))), key, mass, "_g", n).select(key, "other", F.lit(0).alias("tier"), "gap")
    # the nearest n of the group that have another formula are among its nearest 2 n unless decoys of its own formula fill these, and then they aren't needed
    near = nearest_values(rows, key, mass, group, 2 * n).join(rows.select(F.col(key).alias("other"), F.col(formula).alias("_f")), "other").join(rows.select(key, formula), key)
    near = near.where(~F.col("_f").eqNullSafe(F.col(formula))).select(key, "other", F.lit(1).alias("tier"), "gap")
    decoys = same.unionByName(near).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("tier", "gap", "other"))).where(F.col("rank") <= n)
    own = df.select(key, F.col(key).alias("item"), F.lit(0).alias("rank"), F.lit(True).alias("truth"))
    return own.unionByName(decoys.select(key, F.col("other").alias("item"), "rank", F.lit(False).alias("truth")))


#: Ways to fill a depleted list: what is left of it; with decoys; with the pool in its own order; with the pool by score; everything by score.
DEPLETED = ("truncated", "decoys", "unscored", "scored", "reranked")


def depleted(df: DataFrame, group: str, key: str, truth: str, base: Column, pool: Column, score: str, share: float, seed: str, first: int = 5, n: int = 25) -> DataFrame:
    """(strategy, group, rank): where the truth stands in each group under every strategy of DEPLETED, rank null if it doesn't, in one pass.

    In a share of the groups, by a hash of seed and group, the truth is missing from the base list, of which the `first` items by base are left. `decoys` fills up
    to n by pool without the truth, `unscored` by pool, `scored` by score, ties to the smaller key; `reranked` orders everything by score. Groups of other hashes keep the truth at its place.
    """
    w = Window.partitionBy(group)
    held = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256), 1, 13), 16, 10).cast("double") / float(2**52) < share
    rows = df.select(group, key, F.col(truth).alias("_t"), F.col(score).alias("_s"), base.alias("_b"), pool.alias("_p"), held.alias("_h"))
    # the base list without the truth where it is withheld
    place = F.row_number().over(w.orderBy((F.col("_h") & F.col("_t")).cast("int"), "_b", key))
    rows = rows.withColumn("_left", (place <= first) & ~(F.col("_h") & F.col("_t"))).withColumn("_b", place)
    rows = rows.withColumn("strategy", F.explode(F.array(*map(F.lit, DEPLETED))))
    by = F.col("strategy")
    absent = F.col("_h") & F.col("_t") & by.isin("truncated", "decoys") | ~F.col("_left") & (by == "truncated")
    rows = rows.where(~absent)
    tier = F.when(by == "reranked", 0).when(F.col("_left"), 0).otherwise(1)
    value = F.when(by == "reranked", -F.col("_s")).when(F.col("_left"), F.col("_b").cast("double")).when(by == "scored", -F.col("_s")).otherwise(F.col("_p").cast("double"))
    rank = F.row_number().over(Window.partitionBy("strategy", group).orderBy(tier, value, key))
    ranked = rows.withColumn("rank", rank).where(F.col("_t") & (F.col("rank") <= n)).groupBy("strategy", group).agg(F.min("rank").alias("rank"))
    every = df.select(group).distinct().withColumn("strategy", F.explode(F.array(*map(F.lit, DEPLETED))))
    return every.join(ranked, ["strategy", group], "left")
