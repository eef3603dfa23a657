"""N-gram Jaccard join in the metric space of shingle sets, exact for any threshold of at least one half.

Nodes are distinct shingle sets (copies share a node); links are pairs at a Jaccard distance of at most r = 1 - threshold.

Level 0. Under the Jaccard metric unrelated documents all lie at distance 1 of each other, so document pivots alone can't
part them: a window of any width holds them all. The shingle universe is therefore cut into ranges of hash values first.
Two linked sets differ in at most k shingles, so of the first k + 1 + e filled ranges of one of them 1 + e are untouched,
and both hold the same shingles there: nodes with equal content of a range form a cell, and linked nodes share 1 + e cells
or more. A node that shares fewer cells than that with others has no link; one that shares more may leave its `need` - 1 most
populous cells, as at least one common cell remains (the same order of cells holds for all nodes). Cells are bundled by the
least node that they can reach in BUNDLE steps; a bundle that fits a task is a group, otherwise each of its cells is one.

Voronoi regions. A group is joined recursively: pivots are drawn from it and measured against all of its nodes; a node
belongs to the region of its nearest pivot, and is replicated into that of every other pivot p with

    d(y, p) <= d(y, nearest pivot of y) + 2 r    and    d(y, p) <= (radius of the region of p) + r.

If x belongs to p and d(x, y) <= r, then d(y, p) <= d(x, p) + r, and d(x, p) is at most x's distance to y's own pivot, so
both conditions hold and x and y meet in the region of p. Nodes linked with a pivot are one component; regions within one
component are finished. A region that windows no longer shrink is joined pair by pair, by products of incidence matrices.
Groups that fit a task do all that in memory; larger ones are split by the same rule as Spark rows, and what even that does
not shrink is joined in blocks of nodes. Only links that join two components of a group leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_view, chunks, cut, mix, remove, shingle_sets, small_batches, table
from .graph import components

K, THRESHOLD = 4, Fraction(85, 100)
#: Nodes and shingles of a group that one task holds.
MOST_NODES, MOST_SHINGLES = 2048, 1 << 22
#: Nodes that are joined pair by pair without a try at splitting, and pivots of a split.
LEAF, PIVOTS = 64, 8
#: A split is worth its windows if the pairs left are at most this share of those before.
GAIN = 0.6
#: Splits of large groups as Spark rows before they are cut into blocks.
SPLITS = 3
#: Steps in which cells learn the least node that they can reach.
BUNDLE = 2
#: Bits of the filter that tells which nodes' sets are needed; its size doesn't depend on the input. Once it is full, all sets are written.
FILTER_BITS = 1 << 23
#: Rounds in which nodes that share too few cells leave them, which may empty others.
PRUNE = 2
#: One text in SAMPLE tells which cells are hot: HOT nodes of a cell there. Only how rows are dealt to tasks depends on it.
SAMPLE, HOT, SALTS = 64, 8, 64
_U = np.uint64
_EPS = 1e-9


def _sets(column: pa.Array, k: int):
    """Chunks of (first row, rows, row of each shingle, shingles, size of each row, node of each row)."""
    data, offsets = byte_view(column)
    for i, j in chunks(offsets):
        part = offsets[i : j + 1]
        row, h = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
        size = np.bincount(row, minlength=j - i)
        with np.errstate(over="ignore"):
            first = np.minimum(np.cumsum(size) - size, max(0, len(h) - 1))
            total = np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), first) if len(h) else np.zeros(j - i, np.uint64)
            node = mix(total * _U(3) + size.astype(np.uint64)).view(np.int64)
        yield i, j, row, h, size, node


# ---------------------------------------------------------------- level 0: cells


def most_apart(size: np.ndarray, t: Fraction) -> np.ndarray:
    """The largest symmetric difference of a set of this size and one linked to it."""
    p, q = t.numerator, t.denominator
    both = size + size * q // p
    return both * (q - p) // (q + p)


def spare(apart: np.ndarray) -> np.ndarray:
    """Ranges given beyond the necessary ones, so that linked nodes share several cells."""
    return apart // 4 + 1


def _cells(row, h, size, seen: set, node, t: Fraction):
    """(key, node, need) of each cell of each node that isn't in seen; need: cells that it shares with another if they are linked."""
    new = np.array([s > 0 and x not in seen and not seen.add(x) for s, x in zip(size.tolist(), node.tolist(), strict=True)], bool)
    take = new[row]
    row, h = row[take], h[take]
    level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1  # size is in [2 ** level, 2 ** (level + 1))
    apart = most_apart(size, t)
    give = apart + 1 + spare(apart)
    need = 1 + spare(most_apart((size * t.numerator) // t.denominator, t))
    keys, owners = [], []
    strong = new.copy()
    with np.errstate(over="ignore"):
        for up in (0, 1):
            lv = level + up
            # a set reaches into the next level if one linked to it can lie there
            reach = new & ((up == 0) | (size * t.denominator >= (np.int64(1) << lv) * t.numerator))
            inside = reach[row]
            r, x = row[inside], h[inside]
            if not len(x):
                continue
            ranges = np.maximum(16, (np.int64(1) << lv) * 28 * (t.denominator - t.numerator) // (9 * t.numerator)).astype(np.uint64)
            cell = ((x >> _U(32)) * ranges[r]) >> _U(32)
            start = np.ones(len(x), bool)
            start[1:] = (r[1:] != r[:-1]) | (cell[1:] != cell[:-1])
            at = np.flatnonzero(start)
            content = np.add.reduceat(mix(x + _U(0x2545F4914F6CDD1D)), at)
            owner = r[at]
            filled = np.bincount(owner, minlength=len(size))
            rank = np.arange(len(at)) - (np.cumsum(filled) - filled)[owner]
            use = rank < give[owner]
            strong &= ~reach | (filled >= give)
            tag = mix(cell[at] * _U(64) + lv[owner].astype(np.uint64))
            keys.append(mix(content ^ tag)[use])
            owners.append(owner[use])
        # too few filled ranges for the argument: such sets also meet on the shingles of their prefix
        weak = new & ~strong
        need[weak] = 1
        inside = weak[row]
        r, x = row[inside], h[inside]
        count = np.bincount(r, minlength=len(size))
        rank = np.arange(len(x)) - (np.cumsum(count) - count)[r]
        prefix = size - (size * t.numerator + t.denominator - 1) // t.denominator + 1
        use = rank < prefix[r]
        keys.append(mix(x[use] ^ _U(0xA5A5A5A5DEADBEEF)))
        owners.append(r[use])
    owner = np.concatenate(owners)
    return np.concatenate(keys).view(np.int64), node[owner], need[owner].astype(np.int32)


def _cell_rows(t: Fraction, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, row, h, size, node in _sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _cells(row, h, size, seen, node, t)], ["key", "node", "need"])

    return run


def _node_rows(bits, k: int):
    """(doc_id, n_shingles, node, set) of each row of (doc_id, text); sets only of nodes in the filter, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        seen: set[int] = set()
        for batch in batches:
            for i, j, _, h, size, node in _sets(batch.column(1), k):
                ends = np.cumsum(size)
                slot = node.view(np.uint64) % _U(FILTER_BITS)
                needed = (words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == 1
                sets = [None] * (j - i)
                for x in np.flatnonzero(needed & (size > 0)).tolist():
                    n = int(node[x])
                    if n not in seen:
                        seen.add(n)
                        sets[x] = h[ends[x] - size[x] : ends[x]].tobytes()
                out = [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_shingles", "node", "set"])

    return run


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """A bit set of FILTER_BITS bits: at most FILTER_BITS / 64 rows come to the driver."""
    slot = F.expr(f"pmod(node, {FILTER_BITS}L)")
    bit = F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {FILTER_BITS}L) & 63 as int))").alias("b")
    rows = nodes.select(*bit).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def _open(rows: DataFrame, key: str = "key", column: str = "node") -> DataFrame:
    """Rows of the keys with more than one value: two steps, not a window, as a key may hold any share of the rows."""
    keys = rows.groupBy(key).agg(F.min(column).alias("_a"), F.max(column).alias("_b")).where("_a < _b").select(key)
    return rows.join(keys, key, "left_semi")


def shared_cells(texts: DataFrame, k: int, t: Fraction, paths: list[str]) -> DataFrame:
    """Distinct (key, node) of the cells in which links can be found."""
    rows = "key long, node long, need int"
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_cell_rows(t, k), rows)
    # of distinct nodes, so a hot cell has two at least and its rows needn't meet
    hot = sample.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(50_000)
    cells = texts.mapInArrow(_cell_rows(t, k), rows).join(F.broadcast(hot.select("key", F.lit(True).alias("hot"))), "key", "left")
    cells = cells.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)))
    dealt = Window.partitionBy("key", "salt")
    cells = cells.withColumns({"least": F.min("node").over(dealt), "most": F.max("node").over(dealt)}).where("hot or least < most")
    shared = cut(cells.select("key", "node", "need").distinct(), "jaccard-cells", paths)
    for _ in range(PRUNE):
        enough = shared.groupBy("node").agg(F.count("*").alias("has"), F.max("need").alias("need")).where("has >= need").select("node")
        shared = cut(_open(shared.join(enough, "node", "left_semi")), "jaccard-cells", paths)
    # a node has as many cells as its size allows, so the window over it is bounded
    many = shared.groupBy("key").agg(F.count("*").alias("many"))
    own = Window.partitionBy("node")
    ranked = shared.join(many, "key").withColumns({"place": F.row_number().over(own.orderBy("many", "key")), "has": F.count("*").over(own), "most": F.max("need").over(own)})
    return cut(_open(ranked.where("place <= has - most + 1").select("key", "node")), "jaccard-cells", paths)


def bundles(shared: DataFrame, paths: list[str]) -> DataFrame:
    """shared with the bundle of each cell: the least node within BUNDLE steps. Nodes that share a cell share a bundle."""
    labels = shared.select("node", F.col("node").alias("label")).distinct()
    for step in range(BUNDLE):
        rows = shared.join(labels, "node") if step else shared.withColumn("label", F.col("node"))
        keys = rows.groupBy("key").agg(F.min("label").alias("bundle"))
        out = cut(shared.join(keys, "key"), "jaccard-bundles", paths)
        labels = out.groupBy("node").agg(F.min("bundle").alias("label"))
    return out


# ---------------------------------------------------------------- Voronoi regions


def _incidence(sets: list[np.ndarray]):
    """(row, column) of the shingles that two sets at least hold, by column, and the number of columns."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    start = np.ones(len(every), bool)
    start[1:] = every[1:] != every[:-1]
    number = np.cumsum(start) - 1
    keep = (np.bincount(number) > 1)[number]
    return row[keep], np.cumsum(start[keep]) - 1, int(start[keep].sum())


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets numbered a and those numbered b."""
    number = np.unique(np.concatenate([a, b]))
    row, column, width = _incidence([sets[i] for i in number.tolist()])
    at, bt = np.searchsorted(number, a), np.searchsorted(number, b)
    found = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, width, step):
        i, j = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(number), min(step, width - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        found += m[at] @ m[bt].T
    return found.astype(np.int64)


def _distances(sets, size, a, b, t: Fraction):
    """Jaccard distances of the sets a and b, and which pairs are linked (by whole numbers)."""
    common = intersections(sets, a, b)
    union = size[a][:, None] + size[b][None, :] - common
    return 1 - common / union, common * t.denominator >= union * t.numerator


def regions_of(d: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """For distances d of nodes to pivots: the nearest pivot of each node, and which nodes belong to or are replicated into each region."""
    home = d.argmin(1)
    near = d[np.arange(len(d)), home]
    radius = np.full(d.shape[1], -np.inf)
    np.maximum.at(radius, home, near)
    return home, (d <= near[:, None] + 2 * r + _EPS) & (d <= radius[None, :] + r + _EPS)


class _Join:
    """Links that join the components of one group, found by recursive Voronoi regions in memory."""

    def __init__(self, nodes: list[int], comps: list[int], sets: list[np.ndarray], t: Fraction):
        self.nodes, self.sets, self.t, self.r = nodes, sets, t, float(1 - t)
        self.size = np.array([len(s) for s in sets], np.int64)
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(comps)]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((self.nodes[i], self.nodes[j]))

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in at.tolist()], np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray, step: int = 512) -> None:
        """All pairs of a and b."""
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            linked = _distances(self.sets, self.size, part, b, self.t)[1] & (self.roots(part)[:, None] != self.roots(b)[None, :])
            for i, j in zip(*np.nonzero(linked), strict=True):
                self.link(int(part[i]), int(b[j]))

    def split(self, at: np.ndarray) -> None:
        """All pairs within at, by Voronoi regions as long as these part it."""
        if len(at) < 2 or len(set(self.roots(at).tolist())) < 2:
            return
        if len(at) > LEAF:
            pivots = at[np.argsort(mix(np.array([self.nodes[i] for i in at.tolist()], np.int64).view(np.uint64) + _U(len(at))), kind="stable")[:PIVOTS]]
            d, linked = _distances(self.sets, self.size, at, pivots, self.t)
            for i, j in zip(*np.nonzero(linked), strict=True):
                self.link(int(at[i]), int(pivots[j]))
            inside = regions_of(d, self.r)[1]
            held = inside.sum(0).astype(np.float64)
            if (held**2).sum() <= GAIN * len(at) ** 2:
                for p in range(len(pivots)):
                    self.split(at[inside[:, p]])
                return
        self.pairs(at, at)


def _group_links(t: Fraction):
    """Links from rows (gid, bi, bj, block, node, comp, set) in which groups stand together; a group that a batch cuts is held until its end comes."""

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        ids = [rows[f].to_numpy() for f in ("gid", "bi", "bj")]
        start = np.ones(len(rows), bool)
        start[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
        nodes, comps, block = rows["node"].to_pylist(), rows["comp"].to_pylist(), rows["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
        out = []
        ends = np.append(np.flatnonzero(start), len(rows)).tolist()
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            group = _Join(nodes[i:j], comps[i:j], sets[i:j], t)
            if ids[1][i] == ids[2][i]:
                group.split(np.arange(j - i))
            else:
                group.pairs(np.flatnonzero(block[i:j] == ids[1][i]), np.flatnonzero(block[i:j] == ids[2][i]))
            out += group.links
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done(rows: pa.Table) -> pa.RecordBatch:
            found = links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            ids = [batch.column(batch.schema.get_field_index(f)).to_numpy() for f in ("gid", "bi", "bj")]
            end = tuple(int(x[-1]) for x in ids)
            if held and end == last:
                held.append(batch)
                continue
            whole = int(np.argmax(np.logical_and.reduce([x == v for x, v in zip(ids, end, strict=True)])))
            if held or whole:
                yield done(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held, last = [batch.slice(whole)], end
        if held:
            yield done(pa.Table.from_batches(held))

    return run


_ROWS = ("gid", "bi", "bj", "block", "node", "comp", "set")


def join_groups(rows: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Links (u, v) that join the components of groups (gid, bi, bj), from rows (gid, bi, bj, block, node, comp)."""
    rows = rows.join(sets.select("node", "set"), "node").select(*_ROWS)
    return rows.repartition("gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj").mapInArrow(_group_links(t), "u long, v long")


def _weights(rows: DataFrame, nodes: int, shingles: int) -> DataFrame:
    """(gid, many, parts): nodes of each group, and tasks that its nodes need."""
    found = rows.groupBy("gid").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("many") / nodes), F.least("many", F.ceil(F.col("shingles") / shingles)))
    return found.select("gid", "many", parts.cast("int").alias("parts"))


def _measured(t: Fraction):
    """Nodes of one part of a group against the pivots of the group: a row for each region that a node's own window allows."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, pivots = left["node"].to_numpy(), right["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in left["set"].to_pylist() + right["set"].to_pylist()]
        if len(nodes) and len(pivots):
            size = np.array([len(s) for s in sets], np.int64)
            d, linked = _distances(sets, size, np.arange(len(nodes)), np.arange(len(nodes), len(sets)), t)
            home = d.argmin(1)
            x, p = np.nonzero(d <= d.min(1)[:, None] + 2 * float(1 - t) + _EPS)
            out = [nodes[x], pivots[p], d[x, p], home[x] == p, linked[x, p]]
        else:  # no pivot was drawn: the group stays whole
            out = [nodes, nodes * 0, np.zeros(len(nodes)), np.ones(len(nodes), bool), np.zeros(len(nodes), bool)]
        return pa.Table.from_arrays([pa.array(np.full(len(out[0]), key[0].as_py(), np.int64)), *[pa.array(c) for c in out]], ["gid", "node", "pivot", "d", "home", "linked"])

    return run


def split_groups(rows: DataFrame, about: DataFrame, sets: DataFrame, t: Fraction, level: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Voronoi regions of large groups (gid, node, n): (gid, node, n, was) of the regions, `was` the nodes of the group before, and the links found."""
    parts = F.col("parts")
    dealt = rows.join(about, "gid").withColumn("part", F.pmod(F.xxhash64("node"), parts)).join(sets.select("node", "set"), "node")
    drawn = F.pmod(F.xxhash64("node", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("many") / F.least(F.lit(4 * PIVOTS), 2 * parts)).cast("long"))) == 0
    pivots = rows.join(about, "gid").where(drawn).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).join(sets.select("node", "set"), "node")
    left, right = dealt.select("gid", "part", "node", "set"), pivots.select("gid", "part", "node", "set").toDF("g", "p", "node", "set")
    found = left.groupBy("gid", F.col("part").cast("int")).cogroup(right.groupBy("g", F.col("p").cast("int"))).applyInArrow(_measured(t), "gid long, node long, pivot long, d double, home boolean, linked boolean")
    found = cut(found, "jaccard-regions", paths)
    radius = found.where("home").groupBy("gid", "pivot").agg(F.max("d").alias("radius"))
    inside = found.join(radius, ["gid", "pivot"]).where(F.col("home") | (F.col("d") <= F.col("radius") + float(1 - t) + _EPS))
    inside = inside.join(about.select("gid", F.col("many").alias("was")), "gid").select(F.xxhash64("gid", "pivot").alias("gid"), "node", "was")
    return inside.join(sets.select("node", "n"), "node"), found.where("linked and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))


def _with_comps(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _unfinished(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows of the groups that hold more than one component, with comp."""
    return _open(_with_comps(rows, comps), "gid", "comp")


def link_groups(shared: DataFrame, sets: DataFrame, t: Fraction, caps: tuple[int, int], paths: list[str]) -> DataFrame:
    """(node, comp) of the nodes with links, from (key, bundle, node) of cells and (node, n, set)."""
    whole = {"bi": F.lit(0), "bj": F.lit(0), "block": F.lit(0)}
    rows = shared.select(F.col("bundle").alias("gid"), "node").distinct().join(sets.select("node", "n"), "node")
    rows = cut(rows.join(_weights(rows, *caps), "gid"), "jaccard-groups", paths)
    links = join_groups(_with_comps(rows.where("parts = 1"), None).withColumns(whole), sets, t)
    large = rows.where("parts > 1")
    if large.isEmpty():
        return components(links)
    # what is near a few pivots of the bundle becomes one component before its cells are joined
    about = large.select("gid", "many", "parts").distinct()
    near = split_groups(large.select("gid", "node", "n"), about, sets, t, SPLITS, paths)[1]
    rows = shared.join(about.select(F.col("gid").alias("bundle")), "bundle", "left_semi").select(F.col("key").alias("gid"), "node")
    rows = rows.join(sets.select("node", "n"), "node").withColumn("was", F.lit(None).cast("long"))
    for level in range(SPLITS + 1):
        links = cut(links.union(near), "jaccard-links", paths)
        comps = components(links)
        rows = cut(_unfinished(rows, comps).select("gid", "node", "n", "was", "comp"), "jaccard-groups", paths)
        about = cut(_weights(rows, *caps), "jaccard-weights", paths)
        links = links.union(join_groups(rows.join(about.where("parts = 1"), "gid", "left_semi").withColumns(whole), sets, t))
        rest = rows.join(about.where("parts > 1"), "gid")
        # a region that kept most of its group's nodes isn't worth another split
        past = (F.col("was").isNotNull() & (F.col("many") > GAIN * F.col("was"))) | F.lit(level == SPLITS)
        blocks = rest.where(past).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = blocks.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        links = links.union(join_groups(blocks, sets, t))
        rest = cut(rest.where(~past).select("gid", "node", "n"), "jaccard-groups", paths)
        if rest.isEmpty():
            break
        rows, near = split_groups(rest, about, sets, t, level, paths)
    return components(links)


# ---------------------------------------------------------------- the operator


def jaccard_nodes(docs: DataFrame, k: int = K, t: Fraction = THRESHOLD, caps: tuple[int, int] = (MOST_NODES, MOST_SHINGLES)) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every row, node null for an empty set, and (node, comp) of the nodes with links."""
    if not Fraction(1, 2) <= t <= 1:
        raise ValueError("the threshold must lie between one half and 1")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    paths: list[str] = []
    shared = shared_cells(docs.select("text"), k, t, paths)
    bits = spark.sparkContext.broadcast(_filter_bits(shared.select("node")))
    rows = cut(docs.mapInArrow(_node_rows(bits, k), "doc_id long, n_shingles long, node long, set binary"), "jaccard-nodes", paths)
    ids = cut(rows.select("doc_id", "n_shingles", "node"), "jaccard-ids")
    sets = rows.where("set is not null").select("node", F.col("n_shingles").alias("n"), "set")
    sets = cut(sets.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets", paths)
    comps = link_groups(bundles(shared, paths), sets, t, caps, paths)
    remove(spark, paths)
    return ids, comps


def near_duplicates(docs: DataFrame, k: int = K, t: Fraction = THRESHOLD, **caps) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text).

    Empty and null texts have no shingles and are linked with nothing: their component is their own id. Rows with equal
    sets are linked. Null ids take part but name a component only if all its ids are null. Repeated rows stay; other
    columns are ignored.
    """
    rows, comps = jaccard_nodes(docs, k, t, **caps)
    filled = rows.where("node is not null")
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    out = filled.join(nodes.join(least, "comp").select("node", "component_id"), "node").select("doc_id", "n_shingles", "component_id")
    return out.union(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; documents without shingles or without id stay. All columns of docs."""
    found = near_duplicates(docs.select("doc_id", "text"))
    extra = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
    return kept


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents: 4-word shingles, threshold 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}

ORACLE = {
    "op8_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
     e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
}
