"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are hashed to BUCKETS ids, and their stems (the first STEM characters) to as many more. Log-odds of toxic against
other labelled text use a Dirichlet prior with a part proportional to the frequency in all documents, and are shrunk by
their standard error; a token scores by the stronger of its own and its stem's, so rare forms of a word lean on the others.
A drift makes the mean negative, as segment statistics ask. A linear scan finds every maximal scoring segment of a text (disjoint segments no
extension or shortening improves). By chance a text of n tokens holds E = K n exp(-lambda S) segments of score S, and its
best segment stays below S with probability exp(-E); lambda and K are fitted to the best segments of clean texts that took
no part in the log-odds, by maximum likelihood of that extreme-value distribution.
The evidence -log10(E) of a text's significant segments is mapped to a probability by a logistic curve fitted to the labels
of those texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, chunks, crc_mod, cut, remove, small_batches, stems_of, table

BUCKETS = 1 << 19
#: Characters of a stem, as truncating stemmers take.
STEM = 5
#: The classifier is fitted on at most so many labelled rows, the first by a hash of their id. The prior counts all documents.
LABELLED = 50_000
PRIOR, FLOOR = 200.0, 0.5
#: Standard errors by which log-odds are shrunk.
SHRINK = 1.645
#: Of the labelled rows one in FOLDS calibrates.
FOLDS = 4
DRIFT = 0.5
SIGNIFICANT = 0.05
_U = np.uint64
_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[65:91] = _SEP[97:123] = _SEP[128:] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, id of the stem) of each token: runs of ASCII letters, digits and other scripts, A-Z lower-cased."""
    row, h, stem = stems_of(data, offsets, STEM, _SEP)
    return row, (h % _U(BUCKETS)).astype(np.int64), (stem % _U(BUCKETS)).astype(np.int64) + BUCKETS


def _pieces(column: pa.Array):
    data, offsets = byte_view(column)
    for i, j in chunks(offsets):
        part = offsets[i : j + 1]
        row, *token = tokens(data[part[0] : part[-1]], part - part[0])
        ends = np.cumsum(np.bincount(row, minlength=j - i))
        yield i, j, token, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each token and stem id in all texts, and in those labelled clean (0) and toxic (1); 2 and 3 are the same of the calibrating fold."""
    total = np.zeros((5, 2 * BUCKETS), np.int64)
    for batch in batches:
        label = batch.column(1).fill_null(-1).to_numpy()
        for i, j, token, ends in _pieces(batch.column(0)):
            each = np.repeat(label[i:j], np.diff(ends, prepend=0))
            for ids in token:
                total[4] += np.bincount(ids, minlength=2 * BUCKETS)
                for x in range(4):
                    if (each == x).any():
                        total[x] += np.bincount(ids[each == x], minlength=2 * BUCKETS)
    t = np.flatnonzero(total[4])
    for i in range(0, len(t), 100_000):
        x = t[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), *(pa.array(total[k][x]) for k in (4, 0, 1, 2, 3))], ["t", "n", "n0", "n1", "n2", "n3"])


def log_odds(n: str, y0: Column, y1: Column, total: float, all0: float, all1: float) -> Column:
    """Shrunk log-odds of a token from its counts in all, clean and toxic texts; 0 without clean or toxic texts."""
    if not all0 or not all1:
        return F.lit(0.0)
    prior = FLOOR + PRIOR * F.col(n) / total
    a1, a0 = y1 + prior, y0 + prior
    raw = F.ln(a1 / (all1 + PRIOR)) - F.ln(a0 / (all0 + PRIOR))
    return F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - SHRINK * F.sqrt(1 / a1 + 1 / a0))


def _array(t: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Log-odds by id; 0 for any other."""
    out = np.zeros(2 * BUCKETS, np.float32)
    out[t] = value
    return out


def weigh(weights: np.ndarray, token: list[np.ndarray]) -> np.ndarray:
    """The stronger of each token's and its stem's log-odds, less the drift."""
    own, stem = weights[token[0]], weights[token[1]]
    return np.clip(np.where(np.abs(stem) > np.abs(own), stem, own) - DRIFT, -4, 6)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in linear time. Only tokens of positive score start steps; equal sums keep the earlier segment whole."""
    before = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    stack: list[list] = []  # start, end, sum before, sum at end, place of the nearest earlier entry with a smaller sum before
    for p in np.flatnonzero(score > 0).tolist():
        start, low, high = p, before[p], before[p + 1]
        end = p + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([start, end, low, high, j])
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(h - lo)) for a, b, lo, h, _ in stack]


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> dict:
    """The model from (doc_id, text) and (doc_id, toxic): token weights, extreme-value parameters, logistic curve.

    Labels other than 0 and 1 and rows without id are left out; of several labels of one id the largest counts. Without
    toxic or without clean labels every score is the share of toxic labels, or 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.select(F.col("doc_id").alias("_id"), "toxic").where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # bounded by rows
    fold = F.when(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)) == 0, 2).otherwise(0)
    sample = sample.select("_id", (F.col("toxic") + fold).cast("int").alias("label"))
    sample = F.broadcast(spark.createDataFrame(sample.toPandas(), sample.schema))
    joined = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"), "left").select("text", "label")
    names = ["n", "n0", "n1", "n2", "n3"]
    counts = joined.mapInArrow(_count, "t int, n long, n0 long, n1 long, n2 long, n3 long").groupBy("t").agg(*[F.sum(c).alias(c) for c in names])
    counts = cut(counts, "toxicity-counts", paths := [])
    n, y0, y1, z0, z1 = (float(x or 0) for x in counts.where(F.col("t") < BUCKETS).agg(*[F.sum(c) for c in names]).first())
    final = log_odds("n", F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3"), n, y0 + z0, y1 + z1)
    trial = log_odds("n", F.col("n0"), F.col("n1"), n, y0, y1)
    known = counts.select("t", final.cast("float").alias("final"), trial.cast("float").alias("trial")).where("final <> 0 or trial <> 0").toPandas()  # at most 2 * BUCKETS rows
    remove(spark, paths)
    t = known["t"].to_numpy(np.int64)
    model = {"weights": _array(t, known["final"].to_numpy()), "lambda": 1.0, "k": 1e-4, "slope": 0.0, "cut": 0.0}
    shared = spark.sparkContext.broadcast(_array(t, known["trial"].to_numpy()))

    def best(batches):
        for batch in batches:
            lengths, sums = [], []
            for _, _, token, ends in _pieces(batch.column(0)):
                s = weigh(shared.value, token)
                for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    lengths.append(int(b - a))
                    sums.append([x[2] for x in segments(s[a:b])])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], ["label", "length", "sums"])

    fitted = joined.where("label >= 2").mapInArrow(best, "label int, length long, sums array<double>").toPandas()  # a share of the bounded sample
    toxic = fitted["label"].to_numpy() == 3
    clean = fitted[~toxic]
    if len(clean):
        best_sums = np.array([max(each, default=0.0) for each in clean["sums"]])
        model["lambda"], model["k"] = extreme_value(best_sums, clean["length"].to_numpy(float))
    if toxic.any() and (~toxic).any():
        x = np.array([evidence(model, int(m), list(sums)) for m, sums in zip(fitted["length"], fitted["sums"], strict=True)])
        model["slope"], model["cut"] = _logistic(x, toxic)
    elif toxic.any():
        model["cut"] = -np.inf
    else:
        model["cut"] = np.inf
    return model


def extreme_value(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """lambda and K of P(best <= s) = exp(-K n exp(-lambda s)) by maximum likelihood; texts without a segment have a best of 0 and are censored there.

    For a given lambda the best K is the number of segments over the sum of n exp(-lambda s), so one equation in lambda is
    left, which falls in lambda; it is solved by halving. One segment of score 1 in a text of mean length is added, so that
    both are defined without any segment.
    """
    n = np.append(length, max(1.0, length.mean() if len(length) else 1.0))
    s = np.append(best, 1.0)
    found = s > 0
    many, mean = found.sum(), s[found].mean()

    def excess(lam):
        weight = n * np.exp(-lam * s)
        return 1 / lam - mean + (weight @ s) / weight.sum()

    low, high = 1e-3, 1e3
    for _ in range(100):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if excess(middle) > 0 else (low, middle)
    lam = math.sqrt(low * high)
    return lam, float(many / (n * np.exp(-lam * s)).sum())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and centre of a one-variable logistic regression with a small ridge, by damped Newton steps."""
    scale = max(1e-9, float(x.std()))
    z = np.stack([x / scale, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (y - p) - 0.01 * b
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(b[0], 1e-6) / scale
    return float(slope), float(-b[1] / slope)


def evidence(model: dict, length: int, sums: list[float]) -> float:
    """-log10(E), summed over the significant segments, or of the best one if none is; -2 without segments. At most 30."""
    if not sums or length <= 0:
        return -2.0
    e = [(model["lambda"] * s - np.log(model["k"] * length)) / np.log(10) for s in sums]
    strong = [x for x in e if x >= -np.log10(SIGNIFICANT)]
    return float(min(30.0, max(-2.0, sum(strong) if strong else max(e))))


def probability(model: dict, x: float) -> float:
    if np.isinf(model["cut"]):
        return 1.0 if model["cut"] < 0 else 0.0
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * (x - model["cut"]), -30, 30))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and passages: (first word, end word, sum) of each significant segment, by place. Empty and null texts have no segment and a low score. Repeated rows stay, each with the same score. Columns of those names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score", "passages")
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for _, _, token, ends in _pieces(batch.column(at)):
                s = weigh(m["weights"], token)
                for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    n = int(b - a)
                    found = segments(s[a:b])
                    scores.append(probability(m, evidence(m, n, [x[2] for x in found])))
                    passages.append([{"first": f, "end": e, "sum": v} for f, e, v in found if evidence(m, n, [v]) >= -np.log10(SIGNIFICANT)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], [*batch.schema.names, "score", "passages"])

    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sum", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score over all documents, learnt from the labels whose remainder isn't 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE = {}
