"""Record linkage: blocking on several keys with capped postings, pair features, exclusive claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ALIAS = r"\b(?:aka|a\.k\.a\.|dba|d/b/a|fka)\b"


def core_name(name: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "))


def block_keys(name: Column, number: Column | None = None, generic: list[str] = (), least: int = 5) -> Column:
    """(kind, value) keys of a record: core name, alias parts, sorted tokens, tokens run together, telling tokens, number with first token."""
    core = core_name(name)
    tokens = F.filter(F.split(core, " "), lambda t: t != "")
    parts = F.transform(F.split(F.lower(F.coalesce(name, F.lit(""))), _ALIAS), lambda p: core_name(p))
    together = F.regexp_replace(core, " ", "")
    key = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    telling = F.filter(F.array_distinct(tokens), lambda t: (F.length(t) >= least) & ~t.isin(list(generic) or [""]))
    found = [F.array(key("core", core), key("sorted", F.array_join(F.array_sort(tokens), " "))), F.transform(parts, lambda p: key("alias", p)), F.when(F.length(together) >= least, F.array(key("concat", together))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")), F.transform(telling, lambda t: key("token", t))]
    if number is not None:
        found.append(F.array(key("number", F.concat_ws("|", number, F.try_element_at(tokens, F.lit(1))))))
    return F.array_distinct(F.filter(F.concat(*found), lambda k: k["value"] != ""))


def block(left: DataFrame, right: DataFrame, keys: str, left_id: str, right_id: str, caps: dict[str, int], residual: Column | None = None) -> DataFrame:
    """Distinct (left_id, right_id) that share a key. Postings longer than their kind's cap keep the smallest ids; caps are the operator's meaning, as too common keys tell nothing."""
    posts = right.select(*right.columns, F.explode(keys).alias("_k")).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(right_id)))
    limit = F.lit(None)
    for kind, n in caps.items():
        limit = F.when(F.col("_k.kind") == kind, n).otherwise(limit)
    posts = posts.where(F.col("_n") <= F.coalesce(limit, F.col("_n"))).drop("_n", keys)
    asked = left.select(*left.columns, F.explode(keys).alias("_k")).drop(keys)
    # exploded keys are many times what Spark takes their table to be, so they are never broadcast
    pairs = asked.join(posts.hint("merge"), "_k")
    if residual is not None:
        pairs = pairs.where(residual)
    return pairs.select(left_id, right_id).distinct()


def exclusive(pairs: DataFrame, left_id: str, right_id: str, score: str) -> DataFrame:
    """Each right record goes to its best left one, ties to the smaller id."""
    w = Window.partitionBy(right_id).orderBy(F.desc(score), left_id)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_three_mean(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, top, mean3): the maximum and the mean of the three largest values."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy(*group).agg(F.max(value).alias("top"), F.avg(value).alias("mean3"))


def gated_links(pairs: DataFrame, left_id: str, right_id: str, source: str, score: str, thresholds: dict[str, float], singleton: float) -> DataFrame:
    """Pairs at or above their source's threshold; a left record with one such pair keeps it only from the singleton threshold on; then exclusive claims.

    A source without threshold has no pairs.
    """
    least = None
    for name, t in thresholds.items():
        least = (F if least is None else least).when(F.col(source) == name, t)
    fit = pairs.where(F.col(score) >= least).withColumn("_c", F.count("*").over(Window.partitionBy(left_id)))
    return exclusive(fit.where((F.col("_c") > 1) | (F.col(score) >= singleton)).drop("_c"), left_id, right_id, score)
