"""Spectra matched in blocks, held against matchings of one pair at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ionloom.operators import pairblocks, similarity

RNG = np.random.default_rng(3)
#: Dense peaks of few intensities: long chains of rivals and many ties.
SPECTRA = [(i, 100.0 + (i % 7) * 0.006, np.unique(np.round(RNG.uniform(50, 62, RNG.integers(0, 25)), 2))) for i in range(60)]
SPECTRA = [(i, v, mz, RNG.integers(1, 4, len(mz)).astype(float)) for i, v, mz in SPECTRA]


def side(rows=SPECTRA):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    value = [r[1] for r in rows]
    return pairblocks.Side(pa.table({"_i": [r[0] for r in rows], "_v": value, "_lo": [v - 0.02 for v in value], "_hi": [v + 0.02 for v in value], "_mz": pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64())), "_it": pa.array([r[3].tolist() for r in rows], pa.list_(pa.float64()))}))


def pairs():
    return [(a, b) for a in SPECTRA for b in SPECTRA if a[0] < b[0] and a[1] - 0.02 <= b[1] <= a[1] + 0.02]


def blocks(monkeypatch, score, *searches, found=100, some=200):
    """score of every pair, by ids, in small blocks."""
    monkeypatch.setattr(pairblocks, "FOUND", found)
    monkeypatch.setattr(pairblocks, "PAIRS", some)
    out = {}
    for block, *near in pairblocks.pieces(side(), side(), True, *searches):
        x = block.pairs(**score(block, *near))
        for i, key in enumerate(zip(x.pop("a").tolist(), x.pop("b").tolist(), strict=True)):
            assert key not in out
            out[key] = tuple(v[i].item() for v in x.values())
    assert set(out) == {(a[0], b[0]) for a, b in pairs()}
    return out


def cosine(total, a, b):
    norm = np.sqrt((a[3] @ a[3]) * (b[3] @ b[3]))
    return total / norm if norm > 0 else 0.0


def test_greedy_by_product(monkeypatch):
    got = blocks(monkeypatch, pairblocks.greedy_cosines(0.5), (0.5,))
    for a, b in pairs():
        total, n = similarity._by_product(*a[2:], *b[2:], 0.0, 0.5, 0.0)
        assert got[a[0], b[0]] == (pytest.approx(cosine(total, a, b), abs=1e-6), n)


def test_two_pass_and_best_shift(monkeypatch):
    got = blocks(monkeypatch, pairblocks.moved_cosines(0.6, 1.5), (0.6,), (0.6, 1.5))
    for a, b in pairs():
        used, shift = set(), a[1] - b[1] + 1.5
        one, two = (similarity._by_gap(*a[2:], *b[2:], *x) for x in ((0.0, 0.6, used), (shift, 0.6, used)))
        plain, moved = (similarity._by_gap(*a[2:], *b[2:], s, 0.6, set()) for s in (0.0, shift))
        best = moved if moved[0] > plain[0] else plain
        assert got[a[0], b[0]] == (pytest.approx(cosine(one[0] + two[0], a, b), abs=1e-6), one[1] + two[1], pytest.approx(cosine(best[0], a, b), abs=1e-6), best[1])


def walk(a, b, tol, gain):
    i = j = n = 0
    s = 0.0
    while i < len(a[2]) and j < len(b[2]):
        if abs(a[2][i] - b[2][j]) <= tol:
            s, n, i, j = s + gain(a[3][i], b[3][j]), n + 1, i + 1, j + 1
        elif a[2][i] < b[2][j]:
            i += 1
        else:
            j += 1
    return s, n


def test_two_pointers(monkeypatch):
    h = lambda x: x * np.log(x)
    gain = lambda x, y: h(x + y) - h(x) - h(y)
    got = blocks(monkeypatch, pairblocks.entropies(0.3), (0.3,), (0.3, 0.0))
    for a, b in pairs():
        by = a[1] - b[1]
        both = [walk(a, b, 0.3, gain)[0]] + ([walk(a, (*b[:2], b[2] + by, b[3]), 0.3, gain)[0]] if abs(by) >= 0.001 else [])
        assert got[a[0], b[0]][0] == pytest.approx(max(min(1.0, max(0.0, s / (2 * np.log(2)))) for s in both), abs=1e-6)


@pytest.mark.parametrize("rows", [4, 2048])
def test_best_of_groups_and_references(spark, monkeypatch, rows):
    """Groups and references of spectra that meet in one cell and in many."""
    monkeypatch.setattr(pairblocks, "ROWS", rows)
    df = spark.createDataFrame([(i, v, f"m{i % 5}", i % 2, [(float(m), float(t)) for m, t in zip(mz, it, strict=True)]) for i, v, mz, it in SPECTRA], "sid long, v double, mol string, pol int, peaks array<struct<mz:double,it:double>>")
    band = F.col("v") - 0.006, F.col("v") + 0.006
    cells = pairblocks.near_blocks(df, "sid", "v", *band, ["pol"], ["mol"], counted=True)
    assert (cells.where("_s = 0 and _cells > 1").count() > 0) == (rows == 4)
    near = [(a, b) for a in SPECTRA for b in SPECTRA if a[0] != b[0] and a[0] % 2 == b[0] % 2 and a[1] - 0.006 <= b[1] <= a[1] + 0.006]
    best, refs = {}, {}
    for a, b in near:
        s, n = walk(a, b, 0.5, lambda x, y: x * y)
        at = best.setdefault(a[0], {}).setdefault(f"m{b[0] % 5}", [-1.0, 0])
        at[:] = max(at[0], round(cosine(s, a, b), 6)), max(at[1], n)
        total, n = similarity._by_gap(*a[2:], *b[2:], 0.0, 0.5, set())
        refs.setdefault(a[0], []).append((b[0], round(cosine(total, a, b), 9), n))
    want = sorted((sid, key, pytest.approx(s, abs=2e-6), n, k + 1) for sid, found in best.items() for k, (key, (s, n)) in enumerate(sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:3]))
    assert sorted(map(tuple, pairblocks.best_by_group(cells, df, "sid", "mol", 0.5, 3, ["pol"]).select("sid", "key", "score", "matches", "rank").collect())) == want
    got = {r.sid: r for r in pairblocks.references(cells, df, "sid", 0.5, 3, 4, ["pol"]).collect()}
    assert set(got) == set(refs)
    for sid, found in refs.items():
        fit = sorted((-s, key, n) for key, s, n in found if n >= 3)
        assert (got[sid].best and (got[sid].best.key, got[sid].best.matches)) == (fit[0][1:] if fit else None)
        assert got[sid].keys == sorted(key for key, _, _ in found)[:4]
        assert got[sid].top == (pytest.approx(max((s for key, s, _ in found if key % 2 == 0)), abs=1e-9) if any(key % 2 == 0 for key, _, _ in found) else None)


@pytest.mark.parametrize("name", ["entropy_similarity", "greedy_cosine", "library_search", "peak_matches", "modified_cosines"])
def test_pairs_are_not_shuffled(spark, name):
    """Nothing stands between what a task scores and the result: each pair was shuffled twice to be joined with its spectra before."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    after = plan.split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and "Join" not in after and "Aggregate" not in after and "Window" not in after


def test_reference_pairs_stay_in_tasks(spark):
    plan = entry.queries()["reference_tiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "ArrowEvalPython" not in plan  # scored once, before what reads it three times
