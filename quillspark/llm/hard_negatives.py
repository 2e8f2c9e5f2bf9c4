"""Hard negatives by a vantage-point tree: for each anchor and positive, the best-scored rows of other labels in a window of scores.

Scores are inner products of integer vectors. A row gets one entry more, so that all rows have the same length ``M`` (the
longest row's); an anchor gets 0 there. Then ``distance ** 2 = |anchor| ** 2 + M ** 2 - 2 * score``: higher scores are
nearer, and a window of scores is an annulus around the anchor. Distances only tell where to look; scores are exact.

The tree has two parts. Its upper levels, up to ``LEAVES`` leaves, have their vantage points from a bounded sample; every
row goes down to its leaf, and for each leaf the exact least and greatest distance to the vantage points above it are
aggregated. A leaf with more rows than fit a block is dealt over several blocks by a hash of the id, so copies of one vector
never meet in one task. In a block the tree goes on down to buckets of about ``BUCKET`` rows; a block is one row of a table.

Anchors travel in chunks, each with all its windows, to the leaves whose bounds meet their annuli: first to the nearest leaf
only, then to the others that may still hold something as near as what the first gave. In the second round a chunk goes once
to each of at most ``SHELVES`` runs of blocks, whatever the number of blocks, so what is shuffled grows as the anchors do; the
blocks of a shelf meet it there. In a block each window takes its nearest bucket first, and then those that do not lie beyond
the annulus or beyond its k-th best row. The best of each block meet in a ranked window.

Defined results: rows without id, label or vector, and those with null, NaN or infinite entries, take no part; of rows with
one id the least (by label, then vector) counts; a short vector counts as filled up with zeros; equal scores go by smaller
id; anchors without a positive, or with a negative positive score (its window is empty), have no rows; an empty table gives
none; other columns are ignored. Vectors longer than 2**26 after scaling raise, as their scores would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._spark import discard, scratch
from quillspark.llm._text import list_array
from quillspark.llm.whitening import finite, integers

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Upper leaves at most, bytes of the sample that their vantage points come from, bytes of vectors in a block.
LEAVES, SAMPLE_BYTES, BLOCK_BYTES = 256, 8 << 20, 2 << 20
#: Rows of a bucket; a chunk of anchors has a share of a block's bytes; shelves at most.
BUCKET, CHUNK_SHARE, SHELVES = 64, 4, 64
#: Of squared distances: beyond what rounding can do to them.
SLACK = 1e-6


class Tree(NamedTuple):
    """A complete binary tree: vantage points and radii in heap order (those of node i at ``i - 1``)."""

    points: np.ndarray
    heights: np.ndarray
    radii: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.radii) + 1).bit_length() - 1

    def path(self, leaf: np.ndarray) -> np.ndarray:
        """The nodes above each leaf, from the root on, counted from 0."""
        return ((leaf[:, None] + (1 << self.depth)) >> np.arange(self.depth, 0, -1)) - 1


def _heights(x: np.ndarray, whole: float) -> np.ndarray:
    """The entry that brings a row's squared length up to ``whole``."""
    return np.sqrt(np.maximum(whole - (x * x).sum(1), 0))


def _apart(x: np.ndarray, h: np.ndarray, points: np.ndarray, heights: np.ndarray, square: np.ndarray | float, whole: float) -> np.ndarray:
    """Distances from rows (``x`` with the entry ``h`` and the squared length ``square``) to vantage points."""
    return np.sqrt(np.maximum(np.add.outer(np.broadcast_to(square, len(x)), np.full(len(points), whole)) - 2 * (x @ points.T + np.outer(h, heights)), 0))


def grow(x: np.ndarray, depth: int, whole: float) -> tuple[Tree, np.ndarray]:
    """A tree over rows and the order that puts the rows of each leaf together; leaves differ by one row at most."""
    h, order = _heights(x, whole), np.arange(len(x))
    points, heights, radii = np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1), np.zeros((1 << depth) - 1)
    cuts = leaf_bounds(len(x), depth)
    for level in range(depth):
        step = 1 << (depth - level)
        for k in range(1 << level):
            a, b, mid = cuts[k * step], cuts[(k + 1) * step], cuts[k * step + step // 2]
            rows, node = order[a:b], (1 << level) - 1 + k
            if not len(rows):
                continue
            # The row farthest from another one sees the rest spread out the most.
            far = rows[_apart(x[rows], h[rows], x[rows[:1]], h[rows[:1]], whole, whole)[:, 0].argmax()]
            d = _apart(x[rows], h[rows], x[[far]], h[[far]], whole, whole)[:, 0]
            by = np.argsort(d, kind="stable")
            order[a:b] = rows[by]
            points[node], heights[node], radii[node] = x[far], h[far], d[by[max(mid - a - 1, 0)]]
    return Tree(points, heights, radii), order


def leaf_bounds(rows: int, depth: int) -> np.ndarray:
    return rows * np.arange((1 << depth) + 1) >> depth


def reach(tree: Tree, near: np.ndarray, far: np.ndarray, q: np.ndarray, square: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distance of each query to the rows of each leaf, given each leaf's bounds to its path."""
    to = _apart(q, np.zeros(len(q)), tree.points, tree.heights, square, whole)
    low, high = np.zeros((len(q), len(near))), np.full((len(q), len(near)), np.inf)
    path = tree.path(np.arange(len(near)))
    for level in range(tree.depth):
        d = to[:, path[:, level]]
        low, high = np.maximum(low, np.maximum(d - far[:, level], near[:, level] - d)), np.minimum(high, d + far[:, level])
    slack = SLACK * (square + whole)[:, None]
    return low * low - slack, high * high + slack


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _descend(tree: Tree, dims: int, whole: float):
    """Each row's leaf and its distances to the vantage points on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dims)
            h, node, seen = _heights(x, whole), np.zeros(len(x), np.int64), np.zeros((len(x), tree.depth))
            to = _apart(x, h, tree.points, tree.heights, whole, whole) if tree.depth else None
            for level in range(tree.depth):
                seen[:, level] = d = to[np.arange(len(x)), node]
                node = 2 * node + 1 + (d > tree.radii[node])
            leaf = node - ((1 << tree.depth) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array(leaf, pa.int32()), list_array(seen.ravel(), np.full(len(x), tree.depth), pa.float64())], names=["vec_id", "label", "x", "leaf", "seen"]
            )

    return run


_PLACED = "vec_id long, label int, x array<long>, leaf int, seen array<double>"
_BLOCK = "block int, ids array<long>, labels array<int>, x array<int>, points array<int>, near array<double>, far array<double>"


def _block(dims: int, whole: float):
    """The rows of a block as one row: in the order of the buckets of its tree, with each bucket's bounds."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, rows = _matrix(table.column("x").combine_chunks(), dims), table.num_rows
        depth = max(0, (rows // BUCKET).bit_length() - 1)
        tree, order = grow(x, depth, whole)
        x, h, cuts, path = x[order], _heights(x[order], whole), leaf_bounds(rows, depth), tree.path(np.arange(1 << depth))
        near, far = np.zeros((1 << depth, depth)), np.zeros((1 << depth, depth))
        for b in range(1 << depth):
            d = _apart(x[cuts[b] : cuts[b + 1]], h[cuts[b] : cuts[b + 1]], tree.points[path[b]], tree.heights[path[b]], whole, whole)
            near[b], far[b] = d.min(0), d.max(0)
        # A vantage point is one of the block's rows: its place is enough.
        where = {p.tobytes(): i for i, p in enumerate(x)}
        points = [where[p.tobytes()] for p in tree.points]
        one = lambda v, kind: pa.array([v], pa.list_(kind))
        taken = table.take(pa.array(order))
        return pa.table(
            [
                table.column("block").slice(0, 1), one(taken.column("vec_id").to_numpy(), pa.int64()), one(taken.column("label").to_numpy(), pa.int32()), one(x.astype(np.int32).ravel(), pa.int32()),
                one(points, pa.int32()), one(near.ravel(), pa.float64()), one(far.ravel(), pa.float64()),
            ],
            names=["block", "ids", "labels", "x", "points", "near", "far"],
        )

    return run


class Index(NamedTuple):
    #: ``_BLOCK`` rows: a scratch table.
    blocks: DataFrame
    tree: Tree
    #: Of each upper leaf: bounds to its path, its first block and how many it has.
    near: np.ndarray
    far: np.ndarray
    first: np.ndarray
    number: np.ndarray
    dims: int
    whole: float
    #: Rows of a block.
    most: int

    @property
    def shelf(self) -> int:
        """Blocks of a shelf."""
        return max(1, -(-int(self.number.sum()) // SHELVES))

    def leaves(self, rows: DataFrame) -> DataFrame:
        """``(vec_id, leaf)``: where rows would stand in the tree."""
        return rows.mapInArrow(_descend(self.tree, self.dims, self.whole), _PLACED).select("vec_id", "leaf")


def index(rows: DataFrame, leaves: int = LEAVES, block_bytes: int = BLOCK_BYTES) -> Index:
    """The tree over all of ``rows(vec_id, label, x)``; ``leaves`` bounds its upper part."""
    square = F.aggregate("x", F.lit(0).cast("double"), lambda s, e: s + e.cast("double") * e)
    n, dims, whole = rows.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    dims, whole = max(dims or 0, 1), float(whole or 0)
    if whole >= 2.0**52:
        raise ValueError("vectors are too long for exact scores: scale them down")
    most = max(BUCKET, block_bytes // (8 * dims))
    depth = max(0, min(leaves, n // most)).bit_length() - 1 if n >= most else 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(max(leaves, SAMPLE_BYTES // (8 * dims))) if depth else rows.select("x").limit(0)
    tree, _ = grow(_matrix(sample.toArrow().column("x").combine_chunks(), dims), depth, whole)
    placed = scratch(rows.mapInArrow(_descend(tree, dims, whole), _PLACED), "vp-rows")
    ends = [f(F.col("seen")[k]) for f in (F.min, F.max) for k in range(depth)]
    near, far = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
    number = np.zeros(1 << depth, np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*"), *ends).collect():  # one row for each of at most LEAVES leaves
        number[r[0]], near[r[0]], far[r[0]] = -(-r[1] // most), r[2 : 2 + depth], r[2 + depth :]
    first = np.cumsum(number) - number
    at = lambda v: F.element_at(F.array(*(F.lit(int(i)) for i in v)), F.col("leaf") + 1)
    block = (at(first) + F.pmod(F.xxhash64("vec_id"), at(number))).cast("int")
    blocks = placed.select(block.alias("block"), "vec_id", "label", "x").groupBy("block").applyInArrow(_block(dims, whole), _BLOCK)
    blocks = scratch(blocks, "vp-blocks")
    discard(placed)
    return Index(blocks, tree, near, far, first, number, dims, whole, most)


_WINDOW = "slot: long, low: double, high: double, floor: double, done: int"
_SENT = f"place int, queries array<struct<anchor_id: long, label: int, x: array<int>, windows: array<struct<{_WINDOW}>>>>"


class Queries(NamedTuple):
    """Anchors, and their windows; ``owner`` tells the anchor of each window."""

    anchor: np.ndarray
    label: np.ndarray
    x: np.ndarray
    square: np.ndarray
    owner: np.ndarray
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    #: The leaf that has been searched already.
    done: np.ndarray

    @staticmethod
    def of(structs: pa.StructArray, dims: int) -> Queries:
        parts = lambda v: dict(zip((x.name for x in v.type), v.flatten(), strict=True))
        f = parts(structs)
        x, w = _matrix(f["x"], dims), parts(f["windows"].flatten())
        owner = np.repeat(np.arange(len(x)), f["windows"].value_lengths().to_numpy(zero_copy_only=False))
        plain = (w[k].to_numpy(zero_copy_only=False) for k in ("slot", "low", "high", "floor", "done"))
        return Queries(f["anchor_id"].to_numpy(zero_copy_only=False), f["label"].to_numpy(zero_copy_only=False), x, (x * x).sum(1), owner, *plain)

    def structs(self, some: np.ndarray, done: np.ndarray) -> pa.StructArray:
        """The windows at the places ``some``, which ascend, with their anchors."""
        own, size = np.unique(self.owner[some], return_counts=True)
        windows = [pa.array(v[some], k) for v, k in ((self.slot, pa.int64()), (self.low, pa.float64()), (self.high, pa.float64()), (self.floor, pa.float64()), (done, pa.int32()))]
        windows = pa.StructArray.from_arrays(windows, names=["slot", "low", "high", "floor", "done"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), windows)
        x = list_array(self.x[own].astype(np.int32).ravel(), np.full(len(own), self.x.shape[1]), pa.int32())
        return pa.StructArray.from_arrays([pa.array(self.anchor[own], pa.int64()), pa.array(self.label[own], pa.int32()), x, lists], names=["anchor_id", "label", "x", "windows"])

    def least(self) -> np.ndarray:
        return np.maximum(self.low, self.floor)

    def annulus(self, whole: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared radii between which rows that can still count lie, for each window."""
        return self.square[self.owner] + whole - 2 * self.high, self.square[self.owner] + whole - 2 * self.least()


def _route(tree: Tree, near: np.ndarray, far: np.ndarray, first: np.ndarray, number: np.ndarray, dims: int, whole: float, shelf: int):
    """Queries of a chunk for each place where they must look: without ``shelf`` the blocks of each window's nearest leaf, else the shelves of all others that meet its annulus."""
    size = shelf or 1
    places = np.arange(-(-int(number.sum()) // size)) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = Queries.of(batch.column("queries").slice(i, 1).flatten(), dims)
                low, high = (v[q.owner] for v in reach(tree, near, far, q.x, q.square, whole))
                inner, outer = q.annulus(whole)
                # The nearest leaf is told by the window alone, so that both rounds agree on it.
                fits = (high >= inner[:, None]) & (number > 0)
                best = np.where(fits & (low <= (q.square[q.owner] + whole - 2 * q.low)[:, None]), low, np.inf).argmin(1)
                mine = np.arange(len(near)) == best[:, None]
                goes = fits & (low <= outer[:, None]) & (~mine if shelf else mine)
                for place, start in enumerate(places):
                    some = np.flatnonzero(goes[:, (first < start + size) & (first + number > start)].any(1))
                    if len(some):
                        sent = q.structs(some, best if shelf else np.full(len(best), -1))
                        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(sent)], pa.int32()), sent)], names=["place", "queries"])

    return run


def _within(q: Queries, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, tree: Tree, near: np.ndarray, far: np.ndarray, whole: float, same: bool, k: int, leaf: int = -2) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of each window's k best rows of a block of ``leaf`` (score -inf: none)."""
    cuts = leaf_bounds(len(ids), tree.depth)
    low, high = (v[q.owner] for v in reach(tree, near, far, q.x, q.square, whole))
    inner, _ = q.annulus(whole)
    low = np.where((high >= inner[:, None]) & (q.done != leaf)[:, None], low, np.inf)
    score, found = np.full((len(q.slot), k), -np.inf), np.full((len(q.slot), k), np.iinfo(np.int64).max)
    given, square = q.least(), q.square[q.owner]

    def look(b: int, asked: np.ndarray) -> None:
        # The outer bound shrinks to the k-th best row.
        least = np.maximum(given[asked], score[asked, -1])
        go = low[asked, b] <= square[asked] + whole - 2 * least
        asked, least = asked[go], least[go]
        if not len(asked):
            return
        rows = slice(cuts[b], cuts[b + 1])
        own, at = np.unique(q.owner[asked], return_inverse=True)
        s = q.x[own] @ x[rows].T
        # Few windows still find a row: by their anchor's best score first.
        some = s.max(1)[at] >= least
        asked, at, least = asked[some], at[some], least[some]
        if not len(asked):
            return
        alike = labels[rows] == q.label[own][:, None]
        kin = alike & (ids[rows] != q.anchor[own][:, None]) if same else ~alike
        s = np.where(kin, s, -np.inf)[at]
        fits = (s >= least[:, None]) & (s <= q.high[asked][:, None]) & (s > -np.inf)
        some = fits.any(1)
        if not some.any():
            return
        asked = asked[some]
        s = np.concatenate([score[asked], np.where(fits[some], s[some], -np.inf)], axis=1)
        i = np.concatenate([found[asked], np.broadcast_to(ids[rows], (len(asked), rows.stop - rows.start))], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, :k]
        score[asked], found[asked] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)

    nearest = low.argmin(1)
    for b in np.unique(nearest):
        look(b, np.flatnonzero(nearest == b))
    for b in np.argsort(low.min(0), kind="stable"):
        look(b, np.flatnonzero(nearest != b))
    return found, score


def _search(dims: int, whole: float, same: bool, k: int, number: np.ndarray):
    leaf_of = np.repeat(np.arange(len(number)), number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
                ids, labels = flat("ids").to_numpy(), flat("labels").to_numpy()
                x, points = flat("x").to_numpy().reshape(len(ids), dims).astype(np.float64), flat("points").to_numpy()
                tree = Tree(x[points], _heights(x[points], whole), np.zeros(len(points)))
                shape = (1 << tree.depth, tree.depth)
                q = Queries.of(flat("queries"), dims)
                leaf = int(leaf_of[batch.column("block")[i].as_py()])
                found, score = _within(q, ids, labels, x, tree, flat("near").to_numpy().reshape(shape), flat("far").to_numpy().reshape(shape), whole, same, k, leaf)
                at, place = np.nonzero(score > -np.inf)
                columns = q.anchor[q.owner[at]], q.slot[at], found[at, place], score[at, place].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["anchor_id", "slot", "id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    along = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k)


def _chunks(counts: list[int], most: int) -> tuple[list[int], list[int]]:
    """For each leaf its first chunk and how many it has: a leaf of many anchors has several, leaves of few share one."""
    first, chunks, at, held = [], [], 0, 0
    for n in counts:
        if held and held + n > most:
            at, held = at + 1, 0
        first.append(at)
        chunks.append(max(1, -(-n // most)))
        at, held = (at + chunks[-1], 0) if chunks[-1] > 1 else (at, held + n)
    return first, chunks


def nearest(asked: DataFrame, windows: DataFrame, to: Index, k: int, same: bool) -> DataFrame:
    """``(anchor_id, slot, id, score, rank)``: the k best rows with ``low <= score <= high`` of the anchor's label (``same``), or of others.

    ``asked(anchor_id, label, x, leaf)`` and ``windows(anchor_id, slot, low, high)``; ``slot`` tells windows of one anchor
    apart. Anchors of neighbouring upper leaves travel together, in chunks.
    """
    counts = [0] * len(to.number)
    for leaf, number in asked.groupBy("leaf").count().collect():
        counts[leaf] = number
    first, chunks = (F.element_at(F.array(*map(F.lit, v)), F.col("leaf") + 1) for v in _chunks(counts, max(16, to.most // CHUNK_SHARE)))
    asked = asked.select("anchor_id", "label", F.col("x").cast("array<int>").alias("x"), (first + F.pmod(F.xxhash64("anchor_id"), chunks)).alias("chunk"))

    def routed(windows: DataFrame, shelf: int) -> DataFrame:
        of = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "low", "high", "floor", F.lit(-1).alias("done"))).alias("windows"))
        queries = asked.join(of, "anchor_id").groupBy("chunk").agg(F.collect_list(F.struct("anchor_id", "label", "x", "windows")).alias("queries")).select("queries")
        sent = queries.mapInArrow(_route(to.tree, to.near, to.far, to.first, to.number, to.dims, to.whole, shelf), _SENT)
        blocks = to.blocks.withColumn("place", F.floor(F.col("block") / (shelf or 1)).cast("int"))
        # Never broadcast: Spark takes the rows for as few as the chunks, but there is one for each place.
        return sent.join(blocks.hint("merge"), "place").mapInArrow(_search(to.dims, to.whole, same, k, to.number), "anchor_id long, slot long, id long, score long")

    once = scratch(_ranked(routed(windows.withColumn("floor", F.lit(float("-inf"))), 0), k), "vp-first")
    if len(to.number) == 1:
        return once
    floor = once.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").cast("double").alias("floor"))
    later = windows.join(floor, ["anchor_id", "slot"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return scratch(_ranked(once.drop("rank").unionByName(routed(later, to.shelf)), k), "vp-found")


def vectors(table: DataFrame, scale: int = SCALE, label: Column | None = None) -> DataFrame:
    """``(vec_id, label, x)`` of the rows that take part; ``label`` may be an expression over the table."""
    label = (F.col("label") if label is None else label).cast("int")
    # An id that is a long stays the table's own column: callers may name it as such.
    vec_id = F.col("vec_id") if dict(table.dtypes)["vec_id"] == "bigint" else F.col("vec_id").cast("long").alias("vec_id")
    rows = table.where(finite(F.col("embedding"))).select(vec_id, label.alias("label"), integers(table, scale, 0).alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, **sizes: int) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``rows(vec_id, label, x)``.

    A negative's score is at least half of the positive's and at most 95 hundredths of it.
    """
    rows = scratch(rows.withColumn("asked", anchors), "vp-vectors")
    tree = index(rows, **sizes)
    asked = rows.where("asked")
    asked = scratch(asked.join(tree.leaves(asked), "vec_id").select(F.col("vec_id").alias("anchor_id"), "label", "x", "leaf"), "vp-anchors")
    discard(rows)
    alike = nearest(asked, asked.selectExpr("anchor_id", "0L AS slot", "double('-inf') AS low", "double('inf') AS high"), tree, positives, same=True)
    pairs = alike.where("score >= 0").selectExpr("anchor_id", "id AS slot", "score AS positive_score")
    windows = pairs.selectExpr("anchor_id", "slot", "double((positive_score + 1) div 2) AS low", "double((95 * positive_score) div 100) AS high")
    found = nearest(asked, windows, tree, negatives, same=False).join(pairs, ["anchor_id", "slot"])
    return found.selectExpr("anchor_id", "slot AS positive_id", "int(rank) AS rank", "id AS negative_id", "positive_score", "score AS negative_score")


def hard_negatives(table: DataFrame) -> DataFrame:
    """``mined`` over a table of embeddings, with anchors at every fiftieth id; every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors(table, SCALE, label), F.col("vec_id") % 50 == 0)
