"""Algebra of ranked lists: long tables (group, rank, key, ...) with ranks from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rank import keep_first


def rrf(lists: list[tuple[DataFrame, float]], group: str, key: str, k: float = 3.0, n: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion: sum of w / (k + rank) per key; ties to the source listed first, then to the better rank there."""
    every = None
    for i, (df, w) in enumerate(lists):
        part = df.select(group, key, F.col("rank").cast("int").alias("r"), F.lit(i).alias("src"), (F.lit(float(w)) / (k + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(group, key).agg(F.sum("s").alias("score"), F.min(F.struct("src", "r")).alias("first"))
    order = Window.partitionBy(group).orderBy(F.desc(F.round("score", 12)), "first", key)
    out = fused.withColumn("rank", F.row_number().over(order)).drop("first")
    return out if n is None else out.where(F.col("rank") <= n)


def blend(df: DataFrame, group: str, a: str, b: str, w: float, key: str) -> DataFrame:
    """score = w (1 - rank(a)) + (1 - w)(1 - rank(b)) + 1e-6 a, ranks from 0 (best) to 1."""
    from .rank import ordinal_rank_norm

    norm = lambda c: 1 - ordinal_rank_norm([group], [F.desc(c), F.asc(key)])
    return df.withColumn("score", w * norm(a) + (1 - w) * norm(b) + 1e-6 * F.col(a))


def slot_merge(base: DataFrame, extra: DataFrame, group: str, key: str, slots: list[int], n: int) -> DataFrame:
    """base with new items of extra at the given places; ranks are consecutive in both. Once base ends, further extras follow.

    Extra item j stands at slot s_j if base lasts until then (s_j <= size of base + j); base items fill the other places in order.
    """
    sizes = base.groupBy(group).agg(F.max("rank").alias("_b"))
    new = extra.join(base.select(group, key), [group, key], "left_anti").join(sizes, group, "left").withColumn("_b", F.coalesce("_b", F.lit(0)))
    new = new.withColumn("j", F.row_number().over(Window.partitionBy(group).orderBy("rank", key)))
    slot = F.try_element_at(F.array(*[F.lit(s) for s in sorted(slots)]).cast("array<int>"), F.col("j"))
    placed = new.withColumn("_s", slot).withColumn("_s", F.when(F.col("_s") <= F.col("_b") + F.col("j"), F.col("_s")))
    placed = placed.withColumn("_p", F.coalesce("_s", F.col("_b") + F.col("j")))
    used = placed.where("_s is not null").groupBy(group).agg(F.array_sort(F.collect_list("_s")).alias("_u"))
    rest = base.join(used, group, "left").withColumn("_u", F.coalesce("_u", F.array().cast("array<int>")))
    # the place of base item i: i plus the slots at or before it, each of which moves it on by one
    place = F.aggregate("_u", F.col("rank").cast("int"), lambda at, s: F.when(s <= at, at + 1).otherwise(at))
    out = rest.select(group, key, place.alias("rank"), F.lit("base").alias("src")).unionByName(placed.select(group, key, F.col("_p").cast("int").alias("rank"), F.lit("extra").alias("src")))
    return out.where(F.col("rank") <= n)


def pin_leader(df: DataFrame, group: str, is_leader: Column, key: str) -> DataFrame:
    """A trusted item goes to rank 1, the others move down."""
    w = Window.partitionBy(group).orderBy(F.desc(is_leader.cast("int")), "rank", key)
    return df.withColumn("rank", F.row_number().over(w))


def insert_at(df: DataFrame, item: DataFrame, group: str, key: str, at: int) -> DataFrame:
    """One item per group put at a rank; an earlier row of the same key goes."""
    rows = df.join(item.select(group, key), [group, key], "left_anti").select(group, key, F.col("rank").cast("double").alias("r"))
    rows = rows.unionByName(item.select(group, key, F.lit(at - 0.5).alias("r")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("r", key))).drop("r")


def swap_first_two(df: DataFrame, group: str, when: Column, key: str) -> DataFrame:
    """Ranks 1 and 2 change places where the condition holds on the row of rank 2."""
    hit = F.max(F.when(F.col("rank") == 2, when).otherwise(False)).over(Window.partitionBy(group))
    return df.withColumn("rank", F.when(hit & F.col("rank").isin(1, 2), 3 - F.col("rank")).otherwise(F.col("rank")).cast("int"))


def backfill(sources: list[DataFrame], group: str, key: str, n: int) -> DataFrame:
    """Each group's first n distinct keys over the sources in order, by rank within each. Null keys go."""
    every = None
    for i, s in enumerate(sources):
        part = s.where(F.col(key).isNotNull()).select(group, key, F.lit(i).alias("src"), F.col("rank").cast("int").alias("r"))
        every = part if every is None else every.unionByName(part)
    return keep_first(every, [group], key, [F.asc("src"), F.asc("r"), F.asc(key)]).drop("r").where(F.col("rank") <= n)


def popularity_reorder(df: DataFrame, group: str, in_pool: str, score: str, popularity: str, mu: float, key: str) -> DataFrame:
    """Pool items are reordered by z(score) + mu popularity among their own places; all others keep theirs."""
    w = Window.partitionBy(group, in_pool)
    sd = F.stddev_pop(score).over(w)
    z = F.when(sd > 1e-9, (F.col(score) - F.avg(score).over(w)) / sd).otherwise(0.0)
    rows = df.withColumn("_v", z + mu * F.col(popularity))
    places = rows.where(in_pool).select(group, F.col("rank").alias("_to"), F.row_number().over(Window.partitionBy(group).orderBy("rank", key)).alias("_i"))
    order = rows.where(in_pool).withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_v"), "rank", key)))
    moved = order.join(places, [group, "_i"]).withColumn("rank", F.col("_to")).drop("_to", "_i", "_v")
    return moved.unionByName(rows.where(~F.col(in_pool)).drop("_v"))


def ensemble(df: DataFrame, group: str, models: list[tuple[str, str, float]], ddof: int = 0) -> DataFrame:
    """z-scores of (value, available, weight) models summed over the available ones with weights renormalised; 0 if none is."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, ok, weight in models:
        w = Window.partitionBy(group, ok)
        sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value).over(w)
        z = F.when(sd > 1e-9, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
        top = top + F.when(F.col(ok), weight * z).otherwise(0.0)
        bottom = bottom + F.when(F.col(ok), weight).otherwise(0.0)
    return df.withColumn("score", F.when(bottom > 0, top / bottom).otherwise(0.0))


def joined_list(df: DataFrame, group: str, key: str, sep: str = ";") -> DataFrame:
    """One row per group: its keys by rank, joined."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k")))), lambda x: x["k"])
    return df.groupBy(group).agg(F.array_join(keys, sep).alias("items"))


def split_list(df: DataFrame, group: str, column: str, key: str, sep: str = ";") -> DataFrame:
    """The reverse: (group, key, rank), blanks dropped."""
    items = F.filter(F.transform(F.split(column, sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(group, F.posexplode(items).alias("p", key)).select(group, key, (F.col("p") + 1).alias("rank"))


def gated_slots(df: DataFrame, base: str, variants: str, filler: str, slots: Column, n: int, name: str = "items") -> DataFrame:
    """A list of n distinct items from three ordered arrays: the places in `slots` (an array; empty shuts the gate) take the next
    variant, the others the next base item; then whatever is left in order base, variants, filler. An item already placed is passed
    over in its source and doesn't use up the place.
    """

    def place(out, at):
        free = lambda c: F.try_element_at(F.filter(c, lambda x: x.isNotNull() & ~F.array_contains(out, x)), F.lit(1))
        first = F.when(F.array_contains(slots, at), free(F.col(variants)))
        return F.concat(out, F.array_compact(F.array(F.coalesce(first, free(F.col(base)), free(F.col(variants)), free(F.col(filler))))))

    kind = df.schema[base].dataType
    return df.withColumn(name, F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast(kind), place))


def group_rerank(df: DataFrame, group: str, formula: str, base: str, scores: list[tuple[str, float]], key: str) -> DataFrame:
    """Within each formula the items with any score are reordered by z(base) + sum of lam z(score) among their own places; the others keep theirs.

    A missing score adds 0; so does one that hardly varies.
    """
    has = F.lit(False)
    for c, _ in scores:
        has = has | F.col(c).isNotNull()
    rows = df.withColumn("_has", has)
    w = Window.partitionBy(group, formula, "_has")

    def z(c):
        sd = F.stddev_pop(c).over(w)
        return F.coalesce(F.when(sd > 1e-9, (F.col(c) - F.avg(c).over(w)) / sd), F.lit(0.0))

    value = z(base)
    for c, lam in scores:
        value = value + lam * z(c)
    rows = rows.withColumn("_v", F.round(value, 12))
    scored = rows.where("_has").withColumn("_i", F.row_number().over(Window.partitionBy(group, formula).orderBy(F.desc("_v"), "rank", key)))
    places = rows.where("_has").select(F.col(group).alias("_g"), F.col(formula).alias("_f"), F.col("rank").alias("_to"), F.row_number().over(Window.partitionBy(group, formula).orderBy("rank", key)).alias("_j"))
    on = scored[group].eqNullSafe(places["_g"]) & scored[formula].eqNullSafe(places["_f"]) & (F.col("_i") == F.col("_j"))
    moved = scored.join(places, on).withColumn("rank", F.col("_to")).select(*df.columns)
    return moved.unionByName(rows.where("not _has").select(*df.columns))


def forward_margin(df: DataFrame, group: str, formula: str, proposed: str, scores: list[str]) -> DataFrame:
    """Proposed items with margin: the least, over models, of their score minus the best base score of the same formula; null if a model has no such pair."""
    w = Window.partitionBy(group, formula)
    gaps = [F.col(c) - F.max(F.when(~F.col(proposed), F.col(c))).over(w) for c in scores]
    known = F.lit(True)
    for g in gaps:
        known = known & g.isNotNull()
    least = gaps[0] if len(gaps) == 1 else F.least(*gaps)
    return df.withColumn("margin", F.when(known, least)).where(proposed)


def slot_choice(relative: Column, margin: Column, library: Column, relative_least: float, margin_least: float, library_hold: float, bold: list[int], gentle: list[int]) -> Column:
    """The slots that variants may take: none where the library match holds, the bold ones where either evidence is strong, else the gentle ones."""
    lists = [F.array(*[F.lit(s) for s in x]).cast("array<int>") for x in ([], bold, gentle)]
    strong = F.coalesce(relative > relative_least, F.lit(False)) | F.coalesce(margin > margin_least, F.lit(False))
    return F.when(F.coalesce(library, F.lit(0.0)) >= library_hold, lists[0]).when(strong, lists[1]).otherwise(lists[2])


def injected(items: DataFrame, gate: DataFrame, group: str, key: str, score: str, n: int, library_hold: float, margin: float | None = None) -> DataFrame:
    """The n best new items of groups whose library_max (of gate; missing is 0) is below the hold, each key once; with a margin, only those within it of the best."""
    rows = items.join(gate.select(group, "library_max"), group, "left").where(F.coalesce("library_max", F.lit(0.0)) < library_hold).drop("library_max")
    if margin is not None:
        rows = rows.withColumn("_b", F.max(score).over(Window.partitionBy(group))).where(F.col(score) >= F.col("_b") - margin).drop("_b")
    return keep_first(rows, [group], key, [F.desc(score), F.asc(key)], "drop").where(F.col("rank") <= n).withColumn("injected", F.lit(True))


def score_mode(mode: str, public: Column, ours: Column, library: Column, hold: float, injected: Column, bias: float, spread: Column) -> Column:
    """The score under a mode: public, public_free (public unless the library match holds, then ours), ours, or blend (their sum); injected items lose bias * spread."""
    held = F.coalesce(library >= hold, F.lit(False))
    value = {"public": public, "public_free": F.when(held, ours).otherwise(public), "ours": ours, "blend": public + ours}[mode]
    return value - bias * spread * injected.cast("int")


def documented_prior(base: Column, neural: Column, popularity: Column, spectral: Column, product: Column, weights: tuple[float, float, float] = (0.1, 0.1, 0.1)) -> Column:
    """1 / (3 + base rank) + 0.75 / (3 + neural rank) and the weighted popularity (of 20), spectral and natural-product evidence."""
    return 1 / (3 + base) + 0.75 / (3 + neural) + weights[0] * popularity / 20 + weights[1] * spectral + weights[2] * product


def rerank_tail(df: DataFrame, group: str, value: Column, key: str, last: int = 25) -> DataFrame:
    """Ranks 2 to `last` by value, ties by rank; rank 1 and what follows `last` stay."""
    rows = df.withColumn("_v", F.round(value, 12)).withColumn("_t", F.col("rank").between(2, last))
    w = Window.partitionBy(group, "_t").orderBy(F.desc("_v"), "rank", key)
    return rows.withColumn("rank", F.when(F.col("_t"), 1 + F.row_number().over(w)).otherwise(F.col("rank"))).drop("_v", "_t")


def channels(terms: list[tuple[Column, float, bool]], least: float = 1e-4) -> Column:
    """Weighted sum of channels (value, weight, logarithmic); logarithmic ones are floored."""
    out = F.lit(0.0)
    for value, weight, log in terms:
        out = out + weight * (F.ln(F.greatest(value, F.lit(least))) if log else value)
    return out


def ensemble_table(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], group: str | None, df: DataFrame) -> DataFrame:
    """Three (score, available) models as z-scores: 0.50 / 0.25 / 0.25 if all are there, the mean of two, the one, or 0. A missing score counts 0 in its z."""
    w = Window.partitionBy(group if group else F.lit(1))

    def z(c):
        x = F.coalesce(F.col(c), F.lit(0.0))
        sd = F.stddev_pop(x).over(w)
        return F.when(sd > 1e-9, (x - F.avg(x).over(w)) / sd).otherwise(0.0)

    zs, oks = zip(*[(z(s), F.coalesce(F.col(ok), F.lit(False))) for s, ok in (a, b, c)], strict=True)
    n = sum((ok.cast("int") for ok in oks), F.lit(0))
    held = sum((F.when(ok, v).otherwise(0.0) for v, ok in zip(zs, oks, strict=True)), F.lit(0.0))
    return df.withColumn("score", F.when(n == 3, 0.5 * zs[0] + 0.25 * zs[1] + 0.25 * zs[2]).when(n > 0, held / n).otherwise(0.0))


def promote(df: DataFrame, tiers: DataFrame, group: str, key: str, protected: str) -> DataFrame:
    """A gold reference goes to rank 1, a silver one to rank 2, the other items move down; protected groups take gold at rank 2.

    tiers: (group, key, tier, protected). A key that the list lacks is added.
    """
    item = tiers.where("tier in ('gold', 'silver')").select(group, key, F.when((F.col("tier") == "gold") & ~F.col(protected), 0.5).otherwise(1.5).alias("r"))
    rest = df.join(item.select(group, key), [group, key], "left_anti").select(group, key, F.col("rank").cast("double").alias("r"))
    return rest.unionByName(item).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("r", key))).drop("r")


def gated_weight(library: Column, gate: float, weight: float, gated: float | None) -> Column:
    """A rerank weight: another one (if given) for molecules whose best library similarity reaches the gate."""
    return F.lit(weight) if gated is None else F.when(library >= gate, gated).otherwise(F.lit(weight))


def fragment_mode(library: Column, gate: float, covered: Column) -> Column:
    """Whether fragment scores rerank a molecule: off above the gate, with the forward scores (all) where there are some, alone (gap) where not."""
    return F.when(library >= gate, "off").when(F.coalesce(covered, F.lit(False)), "all").otherwise("gap")


def normalised(lists: DataFrame, ids: DataFrame, group: str, column: str, n: int, default: str) -> DataFrame:
    """For every id its list joined by `;`: trimmed, without blanks and nan, at most n items; the default where nothing is left."""
    items = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "nan"))
    rows = ids.join(lists, group, "left").select(group, F.slice(items, 1, n).alias("_a"))
    return rows.select(group, F.when(F.size("_a") == 0, default).otherwise(F.array_join("_a", ";")).alias(column))


def repaired(lists: DataFrame, spare: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Lists without repeated keys, filled to n from the spare ones; reclaimed: places freed in the group's list, whole: whether it reached n."""
    freed = lists.groupBy(group).agg((F.count(key) - F.count_distinct(key)).alias("reclaimed"))
    out = backfill([lists, spare], group, key, n).join(freed, group)
    return out.withColumn("whole", F.max("rank").over(Window.partitionBy(group)) == n)


def final_list(base: DataFrame, engine: DataFrame, scores: DataFrame, leaders: DataFrame, group: str, key: str, heads: tuple[int, int], alpha: float, lam: float, hold: float, n: int) -> DataFrame:
    """The whole fusion of a molecule's lists: RRF of the heads of both, rerank within formulas by fragment scores, the library leader pinned if its similarity holds, backfill from base.

    base and engine are (group, key, rank), scores (group, key, formula, frag), leaders (group, key, lib).
    """
    fused = rrf([(base.where(F.col("rank") <= heads[0]), 1.0), (engine.where(F.col("rank") <= heads[1]), alpha)], group, key)
    scored = fused.join(scores, [group, key]).select(group, key, "rank", "formula", "score", "frag")
    ranked = group_rerank(scored, group, "formula", "score", [("frag", lam)], key).select(group, key, "rank")
    marked = ranked.join(leaders.select(group, key, (F.col("lib") >= hold).alias("_lead")), [group, key], "left")
    pinned = pin_leader(marked, group, F.coalesce("_lead", F.lit(False)), key).select(group, key, "rank")
    return backfill([pinned, base], group, key, n)
