"""Ranking within groups: top-k, rank transforms, z-scores, keyed deduplication, retrieval metrics.

Every order ends in a unique column, so results don't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(group: list[str]):
    return Window.partitionBy(*group)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1. Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(_by(group).orderBy(*order))).where(F.col(rank) <= k)


def ordinal_rank_norm(group: list[str], order: list[Column]) -> Column:
    """0 for the best to 1 for the last; 0 in a group of one."""
    n = F.count("*").over(_by(group))
    return (F.row_number().over(_by(group).orderBy(*order)) - 1) / F.greatest(n - 1, F.lit(1))


def average_rank_norm(group: list[str], value: str, ties: list[str] | None = None) -> Column:
    """The mean place of a block of ties over n - 1, value descending; `ties` are further ascending tiers that split blocks."""
    w = _by(group)
    order = w.orderBy(F.desc(value), *(F.asc(t) for t in ties or []))
    block = Window.partitionBy(*group, value, *(ties or []))
    n = F.count("*").over(w)
    return (F.rank().over(order) - 1 + (F.count("*").over(block) - 1) / 2) / F.greatest(n - 1, F.lit(1))


def z_score(group: list[str], value: str, ddof: int, eps: float = 1e-9) -> Column:
    """(x - mean) / sd with sd of the given ddof; 0 where the sd is at most eps or unknown."""
    w = _by(group)
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value).over(w)
    return F.when(sd > eps, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)


def relative_to_best(group: list[str], value: str) -> Column:
    return F.col(value) - F.max(value).over(_by(group))


def keep_first(df: DataFrame, group: list[str], key: str, order: list[Column], null_keys: str = "keep", rank: str = "rank") -> DataFrame:
    """The first row of each key within a group, ranked anew. Rows with a null key are all kept or all dropped."""
    first = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    kept = df.withColumn("_first", first)
    kept = kept.where((F.col("_first") == 1) & F.col(key).isNotNull() | (F.col(key).isNull() if null_keys == "keep" else F.lit(False)))
    return kept.drop("_first").withColumn(rank, F.row_number().over(_by(group).orderBy(*order)))


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order (representatives, precedence unions, exclusive claims)."""
    return df.withColumn("_n", F.row_number().over(_by(key).orderBy(*order))).where("_n = 1").drop("_n")


def hit_ranks(truth: DataFrame, ranked: DataFrame, group: str, key: str) -> DataFrame:
    """(group, hit): the best rank at which a group's true key stands, null if it doesn't."""
    best = ranked.join(truth, [group, key]).groupBy(group).agg(F.min("rank").alias("hit"))
    return truth.select(group).distinct().join(best, group, "left")


def retrieval_metrics(hits: DataFrame, k: int) -> DataFrame:
    """MRR@k, Recall@1 and Recall@k over all groups; a missing truth counts 0."""
    rr = F.when(F.col("hit") <= k, 1 / F.col("hit")).otherwise(0.0)
    share = lambda n: F.avg(F.when(F.col("hit") <= n, 1.0).otherwise(0.0))
    return hits.agg(F.count("*").alias("n"), F.avg(rr).alias("mrr"), share(1).alias("recall_1"), share(k).alias("recall_k"))


def pessimistic_rank(df: DataFrame, group: list[str], is_truth: str, score: str) -> DataFrame:
    """1 + the number of other items that score at least as much as the truth."""
    best = F.max(F.when(F.col(is_truth), F.col(score))).over(_by(group))
    rows = df.withColumn("_t", best).where(~F.col(is_truth))
    n = rows.groupBy(*group).agg(F.count_if(F.col(score) >= F.col("_t")).alias("above"))
    return df.where(is_truth).select(*group).distinct().join(n, group, "left").select(*group, (F.coalesce("above", F.lit(0)) + 1).alias("rank"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) over half-open equal bins; p = 1 falls in none. Their n-weighted mean gap is the ECE."""
    rows = df.where((F.col(p) >= 0) & (F.col(p) < 1)).withColumn("bin", F.floor(F.col(p) * bins).cast("int"))
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def first_of_best(group: list[str], best: str, value: str, order: str) -> Column:
    """A value of the group's row that is best in another column, the first of equals."""
    return F.first(value).over(_by(group).orderBy(F.desc(best), F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def correlation(a: str, b: str, over=lambda c: c) -> Column:
    """Pearson's correlation, null where either side is constant; `over` makes the aggregates those of a window.

    F.corr divides by zero there under ANSI rules, and a guard around an aggregate can't hold it back: it is computed first.
    """
    spread = over(F.stddev_pop(a)) * over(F.stddev_pop(b))
    return over(F.covar_pop(a, b)) / F.nullif(spread, F.lit(0.0))


def relative_triple(group: list[str], value: str, order: str, name: str) -> dict[str, Column]:
    """A value, its ordinal rank from 0 to 1, and its distance from the group's best."""
    return {name: F.col(value).cast("double"), f"{name}_rank": ordinal_rank_norm(group, [F.desc(value), F.asc(order)]), f"{name}_gap": relative_to_best(group, value).cast("double")}


def ranker_features(df: DataFrame, group: list[str], order: str, library: str, raw: str, bits: str, fragment: str, analogs: dict[str, str]) -> DataFrame:
    """The 31 features of a candidate within its group, beside the columns of df.

    library, raw and fragment are scores, bits the number of a candidate's on-bits; analogs names the columns that hold ap,
    a1, best, top, mean and top_sim. Leaders and agreements are those of the first of equal candidates in order.
    """
    w = _by(group)
    ap = analogs["ap"]
    rows = df.withColumn("_len", F.col(raw) / F.sqrt(F.greatest(F.col(bits), F.lit(1)))).withColumn("_mr", ordinal_rank_norm(group, [F.desc(raw), F.asc(order)]))
    lib, near = relative_triple(group, library, order, "lib"), relative_triple(group, ap, order, "ap")
    frag = relative_triple(group, fragment, order, "frag")
    flat = F.stddev_pop(library).over(w) <= 1e-9
    agree = lambda best: F.when(F.max(best).over(w) > 0, 1 - first_of_best(group, best, "_mr", order)).otherwise(0.0)
    out = lib | {"lib_max": F.max(library).over(w).cast("double"), "lib_hit": (F.col(library) > 0).cast("double")}
    out |= near | {"ap_max": F.max(ap).over(w).cast("double")}
    out |= {name: F.col(analogs[name]).cast("double") for name in ("a1", "best", "top", "mean", "top_sim")}
    out |= {"log_n": F.ln(F.count("*").over(w))}
    out |= {"raw_z": z_score(group, raw, 0), "raw_rank": F.col("_mr"), "raw_gap": relative_to_best(group, raw), "len_z": z_score(group, "_len", 0), "len_rank": ordinal_rank_norm(group, [F.desc("_len"), F.asc(order)]), "raw_lead": (F.col(raw) == F.max(raw).over(w)).cast("double")}
    out |= frag | {"frag_z": z_score(group, fragment, 0)}
    out |= {"lib_agree": F.col(library) * (1 - F.col("_mr")), "ap_agree": F.col(ap) * (1 - F.col("_mr")), "agree": agree(library), "agree_ap": agree(ap)}
    out |= {"agree_lib": agree(library) * F.max(library).over(w), "lib_corr": F.when(flat, 0.0).otherwise(F.coalesce(correlation(library, "_mr", lambda c: c.over(w)) * -1, F.lit(0.0)))}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def order_free(df: DataFrame, group: list[str], sources: dict[str, tuple[str, int, bool]], tier: list[str] | None = None) -> DataFrame:
    """Rank columns computed anew from the values they stand for: {rank: (value, sign, absolute)}, ties at their mean place."""
    out = df
    for name, (value, sign, absolute) in sources.items():
        out = out.withColumn("_v", sign * (F.abs(value) if absolute else F.col(value)))
        out = out.withColumn(name, average_rank_norm(group, "_v", tier)).drop("_v")
    return out


def stratified(hits: DataFrame, stratum: str, k: int) -> DataFrame:
    """Retrieval metrics by stratum and, as stratum 0, of all; a truth that isn't listed is a retrieval failure, one listed beyond k a ranking failure."""
    rows = hits.withColumn(stratum, F.explode(F.array(F.col(stratum), F.lit(0).cast(hits.schema[stratum].dataType))))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("hit") <= k, 1 / F.col("hit")).otherwise(0.0))
    return rows.groupBy(stratum).agg(F.count("*").alias("n"), mrr.alias("mrr"), share(F.col("hit") <= 1).alias("recall_1"), share(F.col("hit") <= k).alias("recall_k"), share(F.col("hit").isNull()).alias("retrieval_failure"), share(F.col("hit") > k).alias("ranking_failure"))
