"""Hard negatives by a GNAT-style multiway hyperplane tree.

The vectors are quantised to integers (``vectors``); a row's score for an
anchor is their inner product. An anchor's positives are its best other rows
of the same label, the hard negatives of a positive the best rows of other
labels whose score lies in a window below that of the positive.

The tree is fitted on at most ``SAMPLE`` rows (those with the least hashes of
vec_id; fewer if they would take more than ``SAMPLE_BYTES``), but holds every
row. A node has up to ``FANOUT`` split points, chosen far from each other, and
a row goes to the nearest one, that is, to one side of each hyperplane between
two of them. For each split point the node stores the least and the largest
distance to the rows below it and below each sibling, taken over all rows, and
for each subtree the range of norms.

A search knows a window of scores. As |a-x|^2 = |a|^2 + |x|^2 - 2ax, this is an
annulus around the anchor, per range of norms. From the distance of the anchor
to a split point follows where the distances of that split point to the
annulus can lie; a subtree with a stored range outside of it is eliminated,
whatever split point of the node says so. The remaining leaves are searched
exactly, so the answers are those of a full scan (recall 1). Windows are
narrowed beforehand by what the sample holds.

Rows of a leaf lie in blocks of about ``BLOCK`` rows, dealt by hash, so a hot
leaf is many blocks. The anchors that need a leaf are sent to each of its
blocks, and each block returns its best few rows for each anchor.

Defined cases: rows with a null label, or whose vector is null, empty or holds
null or non-finite components, take no part; neither do rows with a null
vec_id, or with vectors of another length than the most frequent one (of several
such lengths the largest). Of rows with the same vec_id only the one with the least
label, then the least packed vector, takes part. Scores beyond the range of a
long stop at its bounds. An anchor without positives, and a positive without
negatives, gives no row. An empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmark.llm.vectors import integer_vectors, unpack, usual_dims
from panelmark.session import cut

SAMPLE, SAMPLE_BYTES = 16384, 64 << 20
FANOUT, LEAF_SAMPLE = 8, 512
BLOCK = 32768
#: anchors in a group with a block; beyond it the block is read by several groups
ANCHORS = 65536
#: scores held at once in a task
_CHUNK = 1 << 21
#: allowance for rounding, as a share of the lengths involved
_SLACK = 1e-6


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as float64 if they fit and long else."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return a.astype(np.float64) @ x.astype(np.float64).T
    exact = a.astype(object) @ x.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _distances(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances [rows of x, points]."""
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Node:
    points: np.ndarray
    #: per split point the number of the node below it, or -1 - the number of the leaf
    below: list[int]
    #: distances of split point i to the rows below j
    near: np.ndarray = field(init=False)
    far: np.ndarray = field(init=False)
    #: squared norms of the rows below j
    short: np.ndarray = field(init=False)
    long: np.ndarray = field(init=False)

    def __post_init__(self):
        many = len(self.points)
        self.near, self.far = np.full((many, many), np.inf), np.full((many, many), -np.inf)
        self.short, self.long = np.full(many, np.inf), np.full(many, -np.inf)


def _far_apart(x: np.ndarray) -> np.ndarray:
    """Up to FANOUT distinct rows, each the farthest from those before it."""
    candidates = x[: 4 * FANOUT]
    chosen, distance = [0], _distances(candidates[:1], candidates)[:, 0]
    while len(chosen) < FANOUT and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, _distances(candidates[chosen[-1:]], candidates)[:, 0])
    return candidates[chosen]


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int

    def descend(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows that pass it, their distances to its points, the point each takes)."""
        waiting = [(0, np.arange(len(x)))] if self.nodes else []
        while waiting:
            number, rows = waiting.pop()
            if not len(rows):
                continue
            node = self.nodes[number]
            distance = _distances(node.points, x[rows])
            taken = distance.argmin(axis=1)
            yield number, rows, distance, taken
            waiting += [(below, rows[taken == j]) for j, below in enumerate(node.below) if below >= 0]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for number, rows, _, taken in self.descend(x):
            out[rows] = (-1 - np.array(self.nodes[number].below))[taken]
        return out

    def needed(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, anchors that may find a score from low to high there); low and high are [anchors, windows]."""
        if not self.nodes:
            yield 0, np.nonzero((low <= high).any(axis=1))[0]
            return
        squared = (a * a).sum(axis=1)[:, None]
        waiting = [(0, np.arange(len(a)))]
        while waiting:
            number, rows = waiting.pop()
            node = self.nodes[number]
            distance = _distances(node.points, a[rows])
            for j, below in enumerate(node.below):
                if node.short[j] > node.long[j]:
                    continue
                slack = _SLACK * (np.sqrt(squared[rows]) + math.sqrt(node.long[j]) + 1)
                least = np.sqrt(np.maximum(squared[rows] + node.short[j] - 2 * high[rows], 0))
                room = squared[rows] + node.long[j] - 2 * low[rows]
                most = np.sqrt(np.maximum(room, 0))
                alive = (low[rows] <= high[rows]) & (room >= -(slack**2))
                for i in range(len(node.points)):
                    d = distance[:, i][:, None]
                    alive &= (np.maximum(d - most, least - d) <= node.far[i, j] + slack) & (d + most >= node.near[i, j] - slack)
                left = rows[alive.any(axis=1)]
                if len(left) and below < 0:
                    yield -1 - below, left
                elif len(left):
                    waiting.append((below, left))


def grow(sample: np.ndarray) -> Tree:
    """A tree over the sample; its ranges are still to be taken."""
    tree = Tree([], 0)

    def place(rows: np.ndarray) -> int:
        points = _far_apart(rows) if len(rows) > LEAF_SAMPLE else rows[:1]
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        number = len(tree.nodes)
        tree.nodes.append(Node(points, []))
        taken = _distances(points, rows).argmin(axis=1)
        tree.nodes[number].below = [place(rows[taken == j]) for j in range(len(points))]
        return number

    place(sample)
    return tree


def best(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest entries of each row, the earlier column first among equals; NaN is none."""
    filled = np.where(np.isnan(values), -np.inf, values) if values.dtype.kind == "f" else values
    if values.shape[1] > k:
        edge = np.partition(filled, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
        row, column = np.nonzero((filled >= edge[:, None]) & ~np.isneginf(filled))
    else:
        row, column = np.nonzero(~np.isneginf(filled))
    value = filled[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, row, side="left")
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept], value[kept]


class _Rows:
    """Rows of a block or the sample, by vec_id."""

    def __init__(self, vec_id: np.ndarray, label: np.ndarray, packed: list[bytes]):
        order = np.argsort(vec_id, kind="stable")
        self.id, self.label = vec_id[order], label[order]
        self.x = unpack([packed[i] for i in order.tolist()])

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> _Rows:
        return cls(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("x").to_pylist())

    def __len__(self) -> int:
        return len(self.id)


def _searched(a_id, a_label, a, low, high, rows: _Rows, same: bool, k: int):
    """(anchor, window, row, score) of the best k rows of each window, for a few anchors."""
    value = scores(a, rows.x)
    whole = value.dtype.kind == "i"
    fits = (a_label[:, None] == rows.label[None, :]) == same
    fits &= a_id[:, None] != rows.id[None, :]
    for w in range(low.shape[1]):
        inside = fits & (value >= low[:, w][:, None]) & (value <= high[:, w][:, None])
        if whole:
            # beyond 2**53 floats cannot rank: integers do, one anchor at a time
            for i in np.nonzero(inside.any(axis=1))[0]:
                at = np.nonzero(inside[i])[0]
                at = at[np.lexsort((at, ~value[i, at]))][:k]
                yield from ((int(i), w, int(c), int(value[i, c])) for c in at)
        else:
            yield from ((i, w, c, int(v)) for i, c, v in zip(*(p.tolist() for p in best(np.where(inside, value, -np.inf), k))))


def _narrowed(a_id, a_label, a, low, high, sample: _Rows, same: bool, k: int) -> np.ndarray:
    """``low`` raised to the k-th best score that the sample holds in a window."""
    low, found = low.copy(), {}
    for i, w, _, score in _searched(a_id, a_label, a, low, high, sample, same, k):
        found.setdefault((i, w), []).append(score)
    for (i, w), values in found.items():
        if len(values) == k:
            low[i, w] = max(low[i, w], np.nextafter(float(values[-1]), -np.inf))
    return low


_ROWS = "vec_id long, label long, x binary"
_WINDOW = "array<struct<positive_id: bigint, score: bigint>>"
_FOUND = "vec_id long, positive_id long, positive_score long, found_id long, score long"


@dataclass
class Index:
    """The fitted tree, all rows with their leaf, and the number of blocks of each leaf."""

    tree: Tree
    rows: DataFrame
    blocks: dict[int, int]
    sample: _Rows


def _chunks(many: int, width: int) -> Iterator[slice]:
    step = max(1, _CHUNK // max(1, width))
    return (slice(a, a + step) for a in range(0, many, step))


def fit(rows: DataFrame, vector: Column, vec_id: Column, label: Column, sample: int = SAMPLE) -> Index | None:
    """The index of all usable rows; None if there are none."""
    coded = integer_vectors(rows, vector, {"vec_id": (vec_id, "long"), "label": (label, "long")}).where("vec_id IS NOT NULL AND label IS NOT NULL")
    dims = usual_dims(coded)
    if not dims:
        return None
    coded = coded.where(F.col("dims") == dims)
    one = F.min(F.struct("label", "x")).alias("one")
    unique = cut(coded.groupBy("vec_id").agg(one).select("vec_id", "one.label", "one.x"))
    few = min(sample, max(1, SAMPLE_BYTES // (8 * dims)))
    taken = unique.orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).toArrow()
    picked = unpack(taken.column("x").to_pylist()).astype(np.float64)
    tree = grow(picked)
    held = _Rows.of(taken)

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = unpack(batch.column("x").to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf_of(x))], names=["vec_id", "label", "x", "leaf"])

    hung = cut(unique.mapInArrow(hang, f"{_ROWS}, leaf int"))
    counts = {r["leaf"]: r["count"] for r in hung.groupBy("leaf").count().collect()}
    blocks = {leaf: math.ceil(count / BLOCK) for leaf, count in counts.items()}
    _take_ranges(tree, hung)
    return Index(tree, hung, blocks, held)


def _take_ranges(tree: Tree, rows: DataFrame) -> None:
    """The ranges of distances and norms below all nodes, over all rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = unpack(batch.column("x").to_pylist()).astype(np.float64)
            squares = (x * x).sum(axis=1)
            for number, passing, distance, taken in tree.descend(x):
                for j in np.unique(taken).tolist():
                    below = taken == j
                    # i = -1 stands for the squared norms
                    columns = [(-1, squares[passing[below]]), *enumerate(distance[below].T)]
                    for i, values in columns:
                        low, high = found.get((number, i, j), (np.inf, -np.inf))
                        found[number, i, j] = min(low, float(values.min())), max(high, float(values.max()))
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([k[c] for k in keys], pa.int32()) for c in range(3)],
             *[pa.array([found[k][c] for k in keys], pa.float64()) for c in range(2)]], names=["node", "i", "j", "low", "high"])

    told = rows.select("x").mapInArrow(measure, "node int, i int, j int, low double, high double")
    # as many rows as the tree has ranges, however many rows there are
    for node, i, j, low, high in told.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect():
        at = tree.nodes[node]
        if i < 0:
            at.short[j], at.long[j] = low, high
        else:
            at.near[i, j], at.far[i, j] = low, high


def _bounds(windows: list, low: Fraction, high: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest whole score of each window, padded by windows that hold nothing."""
    width = max([1, *(len(w) for w in windows)])
    lows, highs = np.full((len(windows), width), np.inf), np.full((len(windows), width), -np.inf)
    for i, several in enumerate(windows):
        for w, one in enumerate(several):
            lows[i, w] = math.ceil(one["score"] * low)
            highs[i, w] = math.floor(one["score"] * high)
    return lows, highs


def _search(index: Index, anchors: DataFrame, same: bool, k: int, low: Fraction, high: Fraction) -> DataFrame:
    """The best k rows of each window of each anchor (vec_id, label, x, windows; no windows: any score)."""
    tree, blocks, sample = index.tree, index.blocks, index.sample

    def windows_of(batch: pa.RecordBatch | pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        windows = batch.column("windows").to_pylist()
        if same:
            return windows, np.full((len(windows), 1), -np.inf), np.full((len(windows), 1), np.inf)
        return windows, *_bounds(windows, low, high)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _chunks(len(whole), len(sample)):
                batch = whole.slice(part.start, part.stop - part.start)
                a_id, a_label = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                a = unpack(batch.column("x").to_pylist())
                _, lows, highs = windows_of(batch)
                lows = _narrowed(a_id, a_label, a, lows, highs, sample, same, k)
                for leaf, needing in tree.needed(a.astype(np.float64), lows, highs):
                    for block in range(blocks.get(leaf, 0)):
                        sent = batch.take(pa.array(needing))
                        yield pa.RecordBatch.from_arrays(
                            [*sent.columns, pa.array(np.full(len(needing), leaf, np.int32)), pa.array(np.full(len(needing), block, np.int32))],
                            names=["vec_id", "label", "x", "windows", "leaf", "block"])

    def look(anchors_: pa.Table, rows_: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors_) and len(rows_):
            rows = _Rows.of(rows_)
            for part in _chunks(len(anchors_), len(rows)):
                batch = anchors_.slice(part.start, part.stop - part.start)
                a_id, a_label = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                windows, lows, highs = windows_of(batch)
                for i, w, c, score in _searched(a_id, a_label, unpack(batch.column("x").to_pylist()), lows, highs, rows, same, k):
                    of = windows[i][w] if windows[i] else {"positive_id": None, "score": None}
                    out.append((int(a_id[i]), of["positive_id"], of["score"], int(rows.id[c]), score))
        names = ["vec_id", "positive_id", "positive_score", "found_id", "score"]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=names)

    width = max(blocks.values())
    turns = max(1, math.ceil(anchors.count() / ANCHORS))
    of_leaf = F.element_at(F.create_map(*[F.lit(v) for pair in sorted(blocks.items()) for v in pair]), F.col("leaf"))
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), of_leaf.cast("long")).cast("int") if width > 1 else F.lit(0)
    rows = index.rows.withColumn("block", block).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    routed = anchors.mapInArrow(route, f"{_ROWS}, windows {_WINDOW}, leaf int, block int").withColumn(
        "turn", F.pmod(F.xxhash64(F.lit("turn"), "vec_id"), F.lit(turns).cast("long")).cast("int"))
    key = ["leaf", "block", "turn"]
    met = routed.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(look, _FOUND)
    order = Window.partitionBy("vec_id", "positive_id").orderBy(F.desc("score"), "found_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, vector: Column, vec_id: Column, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5,
         low: Fraction = Fraction(4, 5), high: Fraction = Fraction(1), sample: int = SAMPLE) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column vec_id. A negative's score is
    from ``low`` to ``high`` times that of its positive.
    """
    index = fit(rows, vector, vec_id, label, sample)
    if index is None:
        return rows.sparkSession.createDataFrame([], _MINED)
    anchors = index.rows.where(is_anchor).select("vec_id", "label", "x")
    alike = _search(index, anchors.withColumn("windows", F.array().cast(_WINDOW)), True, positives, low, high)
    windows = cut(alike.groupBy("vec_id").agg(F.collect_list(F.struct(F.col("found_id").alias("positive_id"), "score")).alias("windows")))
    found = _search(index, anchors.join(windows, "vec_id"), False, negatives, low, high)
    return found.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                        F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
