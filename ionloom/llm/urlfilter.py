"""URL filter: host/path rules first, then a ratio of two character language models.

URLs that a rule decides teach two smoothed variable-order Markov models, one of accepted and one of rejected URLs.
Every other URL is judged by the length-normalised difference of its log-likelihoods under both, against a threshold
calibrated on labelled URLs that were kept out of the counts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, cut, remove, table

#: Verdict, host, path prefix. Fixed values of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The longest context of a character. The model holds every gram of ORDER + 1 characters of the corpus, so it grows with it.
ORDER = 5
#: What pads the front of a URL and what ends it.
PAD, END = "\x02", "\x03"
#: Grams that are at least one in HOT of all occurrences are broadcast, HOT of them at most; the others are joined by shuffle.
HOT = 20_000
BINS = 400


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` and for null."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits. Of equally long ones the first listed wins."""
    name, verdict = None, None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = (F if name is None else name).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(what))
    return name, verdict


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each character of _sym and the end, after its context of ORDER characters."""
    chars = F.filter(F.split(F.concat(F.lit(PAD * ORDER), "_sym", F.lit(END)), ""), lambda c: c != "")
    rows = rows.select(*keep, chars.alias("_c"))
    return rows.select(*keep, F.explode(F.expr(f"transform(sequence(1, size(_c) - {ORDER}), i -> array_join(slice(_c, i, {ORDER + 1}), ''))")).alias("gram"))


def fit(rows: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(gram, n, ratio): occurrences, and log p_accept - log p_reject of a gram's last character after the others.

    rows has _sym and accept (boolean); rows with a null there teach nothing, but their grams get a ratio too. Witten-Bell
    smoothing: an order trusts its own counts by n / (n + t), t the number of distinct characters seen after the context,
    and leaves the rest to the next shorter one, all of it where the context is unseen; below order 0 all characters are
    alike. Each order is a table of distinct grams; a key of its joins and windows has as many rows as there are characters.
    The counts are cut into the shared folder, at a path that is added to paths.
    """
    counts = _grams(rows, ["accept"]).groupBy("gram").agg(F.count("*").alias("n"), F.count_if("accept").alias("na"), F.count_if(~F.col("accept")).alias("nr"))
    counts = cut(counts, "url-grams", paths)
    probs = None
    for order in range(ORDER + 1):
        own = counts.groupBy(F.substring("gram", ORDER + 1 - order, order + 1).alias("k")).agg(*[F.sum(x).alias(x) for x in ("n", "na", "nr")])
        w = Window.partitionBy(F.substring("k", 1, order))
        seen = {f"t{x}": F.sum(f"n{x}").over(w) for x in "ar"} | {f"d{x}": F.count_if(F.col(f"n{x}") > 0).over(w) for x in "ar"}
        if probs is None:
            own = own.withColumns({**seen, "pa": 1 / (F.count("*").over(w) + 1), "pr": 1 / (F.count("*").over(w) + 1)})
        else:
            own = own.withColumns(seen).withColumn("s", F.substring("k", 2, order)).join(probs.select(F.col("k").alias("s"), "pa", "pr"), "s")
        for x in "ar":
            total = F.col("t" + x) + F.col("d" + x)
            own = own.withColumn("p" + x, F.when(total > 0, (F.col("n" + x) + F.col("d" + x) * F.col("p" + x)) / total).otherwise(F.col("p" + x)))
        probs = own.select("k", "n", "pa", "pr")
    return probs.select(F.col("k").alias("gram"), "n", (F.ln("pa") - F.ln("pr")).alias("ratio"))


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(_id, score): the mean log ratio over the characters and the end of each distinct _sym; model has all of their grams."""
    total = model.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT >= total
    grams = _grams(rows.select("_id", "_sym").distinct(), ["_id"]).join(F.broadcast(model.where(often).select("gram", "ratio")), "gram", "left")
    sums = lambda x: x.groupBy("_id").agg(F.sum("ratio").alias("x"), F.count("*").alias("m"))
    rest = grams.where("ratio is null").select("_id", "gram").join(model.where(~often).select("gram", "ratio"), "gram")
    both = sums(grams.where("ratio is not null")).union(sums(rest)).groupBy("_id").agg(F.sum("x").alias("x"), F.sum("m").alias("m"))
    return both.select("_id", F.round(F.col("x") / F.col("m"), 9).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy over (score, accept), from counts in bins of 2 / BINS; 0 if a label is missing. A score is a mean of log ratios, whose size the log of the corpus bounds, so bins are few."""
    step = 2.0 / BINS
    bins = scored.select(F.floor(F.col("score") / step).alias("b"), "accept")
    rows = bins.groupBy("b").agg(F.count_if("accept").alias("a"), F.count_if(~F.col("accept")).alias("r")).collect()  # a row for each bin
    accepts, rejects = sum(x.a for x in rows), sum(x.r for x in rows)
    if not accepts or not rejects:
        return 0.0
    best, above = [], [0, 0]
    for x in sorted(rows, key=lambda x: -x.b):
        above = [above[0] + x.a, above[1] + x.r]
        best.append((above[0] / accepts + 1 - above[1] / rejects, -abs(x.b), x.b))
    return max(best)[2] * step


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of (page_id, url).

    Null urls have empty host and path and are scored as an empty URL; without labelled URLs every score is 0, which allows.
    Repeated rows stay; other columns are ignored.
    """
    rows = pages.select("page_id", "url")
    host, path = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "decided": verdict, "_sym": F.coalesce("url", F.lit(""))}).withColumn("_id", F.md5("_sym"))
    accept, held = F.col("decided") == "allow", crc_mod("_sym", 5) == 0
    paths: list[str] = []
    model = cut(fit(rows.select("_sym", F.when(~held, accept).alias("accept")), paths), "url-model", paths)
    scores = cut(score(rows, model), "url-scores")
    remove(pages.sparkSession, paths)
    out = rows.join(scores, "_id")
    threshold = calibrate(out.where(F.col("decided").isNotNull() & held).select("score", accept.alias("accept")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge of all pages."""
    return judge(table(spark, sf_dir, "pages")).drop("score")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE = {}
