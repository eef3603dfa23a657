"""Operators on one spectrum's peaks: an array of (mz, it) structs ordered by mz, as higher-order functions; and on long peaks, one row each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch, together

PEAKS = "array<struct<mz:double,it:double>>"
#: Mass differences of one and two carbon-13 atoms. Fixed values.
C13, C13_TWICE = 1.003355, 2.006710


def make(mz: Column, it: Column) -> Column:
    """Peaks of two parallel arrays: cut to the shorter, finite values with positive mz and intensity, by mz."""
    pairs = F.zip_with(mz, it, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("it")))
    good = F.filter(pairs, lambda p: p["mz"].isNotNull() & p["it"].isNotNull() & ~F.isnan(p["mz"]) & ~F.isnan(p["it"]) & (p["mz"] > 0) & (p["it"] > 0) & (p["mz"] < float("inf")) & (p["it"] < float("inf")))
    return F.array_sort(good)


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once: what a lambda takes from outside it is else evaluated for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), F.lit(1))


def _map(peaks: Column, f) -> Column:
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), f(p).alias("it")))


def top_intensity(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p["it"]))


def total(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["it"])


def cut_precursor(peaks: Column, precursor: Column, buffer: float) -> Column:
    return F.filter(peaks, lambda p: p["mz"] <= precursor + buffer)


def base_normalise(peaks: Column) -> Column:
    return let(peaks, lambda x: let(top_intensity(x), lambda top: F.when(top > 0, _map(x, lambda p: p["it"] / top)).otherwise(x)))


def sum_normalise(peaks: Column) -> Column:
    return let(peaks, lambda x: let(total(x), lambda s: F.when(s > 0, _map(x, lambda p: p["it"] / s)).otherwise(x)))


def unit_normalise(peaks: Column) -> Column:
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, p: a + p["it"] * p["it"]))
    return let(peaks, lambda x: let(norm(x), lambda n: F.when(n > 0, _map(x, lambda p: p["it"] / n)).otherwise(x)))


def floor_relative(peaks: Column, share: float) -> Column:
    return let(peaks, lambda x: let(top_intensity(x), lambda top: F.filter(x, lambda p: p["it"] >= share * top)))


def strongest(peaks: Column, k: int) -> Column:
    """The k strongest peaks in mz order; ties to the lower mz."""
    order = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["it"]).alias("a"), p["mz"].alias("mz"))))
    return F.array_sort(F.transform(F.slice(order, 1, k), lambda p: F.struct(p["mz"].alias("mz"), (-p["a"]).alias("it"))))


def powered(peaks: Column, kind: str) -> Column:
    f = {"raw": lambda x: x, "sqrt": F.sqrt, "log1p": F.log1p}[kind]
    return _map(peaks, lambda p: f(p["it"]))


def require(peaks: Column, least: int, raw_top: Column | None = None, raw_least: float = 0.0) -> Column:
    """The peaks, or none if there are fewer than `least` or the raw base peak is too low."""
    high = F.lit(True) if raw_top is None else raw_top.isNull() | (raw_top >= raw_least)
    return let(peaks, lambda x: F.when((F.size(x) >= least) & high, x).otherwise(F.array().cast(PEAKS)))


def drop_isotopes(peaks: Column, tol: float) -> Column:
    """Peaks without carbon-13 satellites: going up in mz, a peak is dropped if it is weaker than a kept one about one or two isotope steps below."""

    def step(kept, p):
        above = F.exists(kept, lambda q: ((F.abs(p["mz"] - q["mz"] - C13) <= tol) | (F.abs(p["mz"] - q["mz"] - C13_TWICE) <= tol)) & (p["it"] < q["it"]))
        return F.when(above, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(peaks, F.array().cast(PEAKS), step)


def entropy(peaks: Column) -> Column:
    """Shannon entropy of sum-normalised intensities, in nats."""
    return -F.aggregate(peaks, F.lit(0.0), lambda a, p: a + F.when(p["it"] > 0, p["it"] * F.ln(p["it"])).otherwise(0.0))


def entropy_weighted(peaks: Column) -> Column:
    """Sum-normalised; below an entropy of 3, intensities are raised to 0.25 + 0.25 S and normalised anew."""
    sharp = lambda x, s: sum_normalise(_map(x, lambda p: F.pow(p["it"], 0.25 + 0.25 * s)))
    return let(sum_normalise(peaks), lambda x: let(entropy(x), lambda s: F.when(s < 3, sharp(x, s)).otherwise(x)))


def clean(peaks: Column, floor: float = 0.002, k: int = 256, power: float = 1.0) -> Column:
    """Floor, strongest k, power, entropy weighting."""
    few = strongest(floor_relative(peaks, floor), k)
    return entropy_weighted(few if power == 1.0 else _map(few, lambda p: F.pow(p["it"], power)))


def filter_chain(peaks: Column, precursor: Column, raw_top: Column | None = None, raw_least: float = 0.0, buffer: float = 2.0, floor: float = 0.005, isotope_tol: float | None = None, k: int = 128, least: int = 1, kind: str = "sqrt") -> Column:
    """Guard, base normalise, precursor cut, floor, isotopes, strongest k, minimum, transform, normalise."""
    p = floor_relative(cut_precursor(base_normalise(peaks), precursor, buffer), floor)
    if isotope_tol is not None:
        p = drop_isotopes(p, isotope_tol)
    return base_normalise(powered(require(strongest(p, k), least, raw_top, raw_least), kind))


def diagnostic_weights(peaks: Column, precursor: Column) -> Column:
    """sqrt(it) (max(mz, 10) / precursor) ^ 0.25, halved below 50, sum-normalised."""
    return sum_normalise(_map(peaks, lambda p: F.sqrt(p["it"]) * F.pow(F.greatest(p["mz"], F.lit(10.0)) / precursor, F.lit(0.25)) * F.when(p["mz"] < 50, 0.5).otherwise(1.0)))


def neutral_losses(peaks: Column, precursor: Column) -> Column:
    return F.array_sort(F.transform(F.filter(peaks, lambda p: p["mz"] < precursor), lambda p: F.struct((precursor - p["mz"]).alias("mz"), p["it"].alias("it"))))


def merge_close(peaks: Column, tol: float) -> Column:
    """Of two adjacent peaks closer than tol the weaker goes, of equal ones the first; each is compared with its original neighbours."""
    return let(peaks, lambda x: _merged(x, tol))


def _merged(peaks: Column, tol: float) -> Column:
    n = F.size(peaks)

    def keep(p, i):
        left, right = F.try_element_at(peaks, i), F.try_element_at(peaks, i + 2)
        by_right = (i + 1 < n) & (right["mz"] - p["mz"] < tol) & (right["it"] >= p["it"])
        by_left = (i > 0) & (p["mz"] - left["mz"] < tol) & (p["it"] < left["it"])
        return ~(F.coalesce(by_right, F.lit(False)) | F.coalesce(by_left, F.lit(False)))

    marked = F.transform(peaks, lambda p, i: F.struct(p["mz"].alias("mz"), p["it"].alias("it"), F.when(i > 0, keep(p, i)).otherwise(~F.coalesce((n > 1) & (F.try_element_at(peaks, F.lit(2))["mz"] - p["mz"] < tol) & (F.try_element_at(peaks, F.lit(2))["it"] >= p["it"]), F.lit(False))).alias("k")))
    return F.transform(F.filter(marked, lambda p: p["k"]), lambda p: F.struct(p["mz"].alias("mz"), p["it"].alias("it")))


def pool(peaks: Column, tol: float) -> Column:
    """Anchored clusters of peaks in mz order: a peak joins while it is within tol of the cluster's first. mz is the intensity-weighted mean, it the maximum."""
    kind = "struct<a:double,wm:double,w:double,top:double,out:array<struct<mz:double,it:double>>>"
    start = F.struct(F.lit(None).alias("a"), F.lit(0.0).alias("wm"), F.lit(0.0).alias("w"), F.lit(0.0).alias("top"), F.array().alias("out")).cast(kind)

    def flushed(s):
        return F.when(s["a"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["wm"] / s["w"]).alias("mz"), s["top"].alias("it")))))

    def step(s, p):
        joined = F.struct(s["a"].alias("a"), (s["wm"] + p["mz"] * p["it"]).alias("wm"), (s["w"] + p["it"]).alias("w"), F.greatest(s["top"], p["it"]).alias("top"), s["out"].alias("out"))
        fresh = F.struct(p["mz"].alias("a"), (p["mz"] * p["it"]).alias("wm"), p["it"].alias("w"), p["it"].alias("top"), flushed(s).alias("out"))
        return F.when(s["a"].isNotNull() & (p["mz"] - s["a"] <= tol), joined.cast(kind)).otherwise(fresh.cast(kind))

    return F.aggregate(peaks, start, step, flushed)


def _beyond(m: np.ndarray, tol: float) -> np.ndarray:
    """For each of the ascending m the place of the first that lies beyond tol of it."""
    at, n = np.searchsorted(m, m + tol, "right"), len(m)
    while (low := (at < n) & (m[np.minimum(at, n - 1)] - m <= tol)).any():
        at = at + low
    while (high := m[np.maximum(at - 1, 0)] - m > tol).any():
        at = at - high
    return at


def pooled(df: DataFrame, key: str, tol: float, sized_by: DataFrame) -> DataFrame:
    """Long peaks (key, mz, it) to the clusters of `pool`, as rows (key, mz, it), in partitions that grow with the rows of sized_by.

    A cluster's anchor depends on the one before, so the axis is cut into cells of at least 32 tol, and three steps find the same clusters: each cell states, for every peak at its
    beginning that may become its first anchor, which anchor is then its last; these few peaks are walked from cell to cell for a key; each cell makes its clusters from its first
    anchor on. Its last cluster reaches into the next cell by tol at most, so peaks there are in both. Sums go in the order of (mz, it), as in `pool`.
    """
    width = 2.0 ** math.ceil(math.log2(32 * tol))  # a power of two, by which division is exact

    @F.pandas_udf("struct<entries:array<double>,lasts:array<double>>")
    def passages(mz: pd.Series, cell: pd.Series) -> pd.DataFrame:
        out = []
        for m, c in zip(mz, cell, strict=True):
            own, after = int(np.searchsorted(m, (c + 1) * width, "left")), _beyond(m, tol)
            first = at = np.arange(min(int((m - c * width <= tol).sum()) + 1, own))
            while (go := after[at] < own).any():
                at = np.where(go, after[at], at)
            out.append((m[first], m[at]))
        return pd.DataFrame(out, columns=["entries", "lasts"])

    @F.pandas_udf("array<double>")
    def walked(entries: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for cells, ends in zip(entries, lasts, strict=True):
            a, found = -math.inf, []
            for m, last in zip(cells, ends, strict=True):
                free = np.flatnonzero(m - a > tol)
                found.append(m[free[0]] if len(free) else None)
                a = last[free[0]] if len(free) else a
            out.append(found)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<struct<wm:double,w:double,top:double>>")
    def clusters(mz: pd.Series, it: pd.Series, cell: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for m, x, c, e in zip(mz, it, cell, entry, strict=True):
            at = int(np.searchsorted(m, e, "left"))
            m, x = m[at:], x[at:]
            after, starts = _beyond(m, tol), [0]
            while (j := int(after[starts[-1]])) < len(m) and m[j] < (c + 1) * width:
                starts.append(j)
            of = np.repeat(np.arange(len(starts)), np.diff([*starts, j]))
            sums = np.bincount(of, m[:j] * x[:j]), np.bincount(of, x[:j]), np.fmax.reduceat(x[:j], starts)
            out.append([{"wm": a, "w": b, "top": t} for a, b, t in zip(*(s.tolist() for s in sums), strict=True)])
        return pd.Series(out, dtype=object)

    spark, path = df.sparkSession, scratch(df.sparkSession, "cells")
    own = F.floor(F.col("mz") / width)
    rows = df.where("mz is not null").withColumn("_c", F.explode(F.when((F.col("mz") - own * width <= tol), F.array(own, own - 1)).otherwise(F.array(own))))
    cells = together(rows, sized_by, key, "_c").groupBy(key, "_c").agg(F.array_sort(F.collect_list(F.struct("mz", "it"))).alias("p"))
    cells = cells.select(key, "_c", F.col("p.mz").alias("m"), F.col("p.it").alias("x")).where(F.get("m", F.lit(0)) < (F.col("_c") + 1) * width)
    cells.write.parquet(path)
    cells = spark.read.schema(cells.schema).parquet(path)
    ways = cells.select(key, "_c", passages("m", "_c").alias("w")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_c", "w"))).alias("w"))
    ways = ways.select(key, F.explode(F.arrays_zip(F.col("w._c").alias("c"), walked("w.w.entries", "w.w.lasts").alias("e"))).alias("z"))
    first = ways.select(key, F.col("z.c").alias("_c"), F.col("z.e").alias("_e")).where("_e is not null")
    made = together(cells, sized_by, key, "_c").join(together(first, sized_by, key, "_c"), [key, "_c"]).select(key, F.explode(clusters("m", "x", "_c", "_e")).alias("c"))
    known = lambda c: F.when(~F.isnan(c), F.col(c))  # noqa: E731 - a missing intensity is NaN in an array
    return made.select(key, (known("c.wm") / known("c.w")).alias("mz"), known("c.top").alias("it"))


def window_quota(df: DataFrame, key: list[str], most: int = 128, width: float = 50.0, per: int = 8) -> DataFrame:
    """Long peaks (key, mz, it): spectra of over `most` peaks keep at most `per` of the strongest in each mz window, topped up or cut to `most` by intensity."""
    spectrum = Window.partitionBy(*key)
    n = F.count("*").over(spectrum)
    in_window = F.row_number().over(Window.partitionBy(*key, F.floor(F.col("mz") / width)).orderBy(F.desc("it"), "mz"))
    rows = df.withColumns({"_n": n, "_q": in_window}).withColumn("_first", (F.col("_q") <= per).cast("int"))
    place = F.row_number().over(spectrum.orderBy(F.desc("_first"), F.desc("it"), "mz"))
    return rows.withColumn("_p", place).where((F.col("_n") <= most) | (F.col("_p") <= most)).drop("_n", "_q", "_first", "_p")


def binned(df: DataFrame, key: list[str], lo: float, hi: float, n: int) -> DataFrame:
    """Long peaks to sparse bins: (key, bin, v), the square root of each bin's maximum over the largest."""
    width = (hi - lo) / n
    rows = df.where((F.col("mz") >= lo) & (F.col("mz") < hi)).withColumn("bin", F.floor((F.col("mz") - lo) / width).cast("int"))
    top = rows.groupBy(*key, "bin").agg(F.sqrt(F.max("it")).alias("v"))
    best = F.max("v").over(Window.partitionBy(*key))
    return top.withColumn("v", F.when(best > 0, F.col("v") / best).otherwise(0.0))


def ce_weight(ce: Column) -> Column:
    """Information weight of collision energies (array): stepped ones 1.40, else by the range of the first, 30 if unknown."""
    e = F.coalesce(F.try_element_at(ce, F.lit(1)), F.lit(30.0))
    return F.when(F.size(ce) > 1, 1.40).when(e.between(30, 45), 1.25).when(e.between(50, 70), 1.0).when(e.between(10, 25), 0.75).otherwise(1.0)


def tensor(peaks: Column, precursor: Column, n: int) -> Column:
    """n rows (mz / 1000, sqrt(it), log(1 + 100 it) / log 101, loss / 1000) of base-normalised peaks; zeros pad."""
    row = lambda p: F.array(p["mz"] / 1000, F.sqrt(p["it"]), F.log1p(100 * p["it"]) / F.log1p(F.lit(100.0)), (precursor - p["mz"]) / 1000)
    rows = F.transform(F.slice(peaks, 1, n), row)
    return F.concat(rows, F.array_repeat(F.array(*[F.lit(0.0)] * 4), F.greatest(F.lit(0), n - F.size(peaks))))


def metadata(precursor: Column, energy: Column, polarity: Column, adduct: Column) -> Column:
    """(precursor / 1000, energy cut to 0..500 / 100, energy known, polarity); an unknown polarity is that of the adduct's sign."""
    sign = F.coalesce(polarity, F.when(adduct.endswith("-"), -1).when(adduct.endswith("+"), 1).otherwise(0))
    known = energy.isNotNull()
    e = F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(500.0), energy))).otherwise(0.0) / 100
    return F.array((precursor / 1000).cast("double"), e.cast("double"), known.cast("double"), sign.cast("double"))


def jittered(peaks: Column, seed: int, spread: float = 0.08) -> Column:
    """Intensities times exp(spread * normal), base-normalised. The noise is Box-Muller over hashes of peak and seed, so a retried task repeats it."""
    u = lambda p, k: (F.pmod(F.xxhash64(p["mz"], p["it"], F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1) / float(1 << 30)
    return base_normalise(_map(peaks, lambda p: p["it"] * F.exp(spread * F.sqrt(-2 * F.ln(u(p, 0))) * F.cos(6.283185307179586 * u(p, 1)))))


def surrogates(df: DataFrame, polarity: str, adduct: str, precursor: str, peaks: str, margin: float = 0.5) -> DataFrame:
    """Positive spectra of ammonium and water-loss adducts as if protonated: ammonia's mass goes from the precursor of the former, peaks beyond the precursor by more than margin go, and so do spectra left without peaks."""
    rows = df.where((F.col(polarity) > 0) & F.col(adduct).isin("[M+NH4]+", "[M-H2O+H]+", "[M-2H2O+H]+"))
    rows = rows.withColumn(precursor, F.when(F.col(adduct) == "[M+NH4]+", F.col(precursor) - 17.026549).otherwise(F.col(precursor))).withColumn(adduct, F.lit("[M+H]+"))
    return rows.withColumn(peaks, cut_precursor(F.col(peaks), F.col(precursor), margin)).where(F.size(peaks) > 0)


def extend(items: DataFrame, extra: DataFrame, key: str, mode: str) -> DataFrame:
    """items and extra together: all of extra, or (gap) only the keys that items lack."""
    if mode not in ("gap", "all"):
        raise ValueError(mode)
    more = extra if mode == "all" else extra.join(items.select(key).distinct(), key, "left_anti").select(*extra.columns)
    return items.unionByName(more)
