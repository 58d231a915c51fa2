"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of ``least`` or more have a squared distance of 2 - 2 * least or less. All vectors are turned by one fixed
rotation and cut into blocks of neighbouring coordinates; each block gets its share of that squared distance in proportion to its width.
Two vectors within the whole distance are within the share of one block at least, so a range join of each block on its own finds
every pair. The candidates are verified by their cosine in double precision, and a pair counts in the first block that finds it.

A block's range join lays a grid over the block's first axes, of cells twice the radius wide. A vector is at home in one cell and a guest in
those cells of higher number that its radius touches. Cells with more rows than TILE are cut into tiles that meet in pairs, so no
task holds more than two of them. Tasks return sums and a spanning forest of their links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.components import components
from rentscope.llm.words import release_memory, written

WIDTH = 8  # coordinates of a block
TILE = 1 << 16  # rows of a tile
MOST_AXES = 6
CELL_BITS = 10
STRIP = 1 << 21  # distances worked out at once
PAIRS = 1 << 15  # candidates verified at once
SEED = 13
ENTRY = "dims int, block int, cell long, i int, j int, tile int, home boolean, k long, copies long, vector binary"
LINKED = "k long, root long, links long"


def rotation(dims: int) -> np.ndarray:
    """The same orthogonal matrix in every task."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Every row is worked out alike, whatever rows are beside it."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(_dots(scaled, scaled))[:, None]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _turned(units: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated rows by element-wise sums: the same bits in every task, which a matrix product does not promise."""
    total = np.zeros((len(units), turn.shape[1]))
    for x, row in zip(units.T, turn, strict=True):
        total += x[:, None] * row
    return total


def blocks(dims: int, least: float) -> list[tuple[slice, float]]:
    """Coordinates and squared-distance budget of each block; budgets are a hair wide, so that rounding loses no pair."""
    whole = 2 - 2 * least
    parts = [slice(at, min(at + WIDTH, dims)) for at in range(0, dims, WIDTH)]
    return [(p, whole * (p.stop - p.start) / dims * (1 + 1e-9) + 1e-12) for p in parts]


def _cells(coords: np.ndarray, budget: float, axes: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cell numbers, at home?) of the cells that hold the rows' coordinates or that their radius touches above their own."""
    coords = coords[:, :axes]
    side = max(2 * budget**0.5, 4 / 2**CELL_BITS)
    at = np.floor(coords / side + 0.5).astype(np.int64)
    weights = 1 << (CELL_BITS * np.arange(coords.shape[1], dtype=np.int64))
    home = (at + 2 ** (CELL_BITS - 1)) @ weights
    yield np.arange(len(coords)), home, True
    below = coords - (at - 0.5) * side
    for step in product((-1, 0, 1), repeat=coords.shape[1]):
        if (shift := int(np.dot(step, weights))) > 0:
            gap = sum(((below if s < 0 else side - below)[:, a] ** 2 for a, s in enumerate(step) if s), np.zeros(len(coords)))
            rows = np.flatnonzero(gap <= budget * (1 + 1e-9))
            yield rows, home[rows] + shift, False


def _by_dims(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(coordinates, rows of vectors, keys, copies) for the vectors of one length in a batch."""
    for batch in batches:
        lists = batch.column(0)
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        keys, copies = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for dims in np.unique(np.diff(ends)).tolist():
            rows = np.flatnonzero(np.diff(ends) == dims)
            yield dims, flat[ends[rows][:, None] + np.arange(dims)], keys[rows], copies[rows]


def _entries(least: float, axes: int):
    """For each batch and block: the rows, cells and home flags of the range join."""

    def run(batches):
        for dims, vectors, keys, copies in _by_dims(batches):
            turned = _turned(unit(vectors.astype(float)), rotation(dims))
            for b, (part, budget) in enumerate(blocks(dims, least)):
                for rows, cells, home in _cells(turned[:, part], budget, axes):
                    if len(rows):
                        yield dims, b, rows, cells, home, vectors, keys, copies

    return run


def _counted(least: float, axes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, b, _, cells, *_ in _entries(least, axes)(batches):
            found, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), dims, np.int32)), pa.array(np.full(len(found), b, np.int32)), pa.array(found), pa.array(n)], names=["dims", "block", "cell", "n"]
            )

    return run


def _dealt(least: float, axes: int, tiles: dict[tuple[int, int, int], int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, b, rows, cells, home, vectors, keys, copies in _entries(least, axes)(batches):
            many = np.ones(len(cells), np.int32)
            for cell in np.unique(cells).tolist():
                many[cells == cell] = tiles.get((dims, b, cell), 1)
            tile = keys[rows] % many  # keys are dealt evenly
            for other in range(int(many.max())):
                use = np.flatnonzero(other < many)
                mine, theirs = tile[use].astype(np.int32), np.full(len(use), other, np.int32)
                body = np.ascontiguousarray(vectors[rows[use]])
                ends = np.arange(len(use) + 1, dtype=np.int32) * (dims * body.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer(ends), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(use), dims, np.int32)), pa.array(np.full(len(use), b, np.int32)), pa.array(cells[use]),
                        pa.array(np.minimum(mine, theirs)), pa.array(np.maximum(mine, theirs)), pa.array(mine), pa.array(np.full(len(use), home)),
                        pa.array(keys[rows[use]]), pa.array(copies[rows[use]]), packed,
                    ],
                    names=["dims", "block", "cell", "i", "j", "tile", "home", "k", "copies", "vector"],
                )
        release_memory()

    return run


class Forest:
    """Union of linked rows; the smaller row is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def roots(self) -> np.ndarray:
        while (above := self.up[self.up]).tolist() != self.up.tolist():
            self.up = above
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.roots()
        ends = np.unique(np.stack([np.minimum(up[a], up[b]), np.maximum(up[a], up[b])]), axis=1)
        for x, y in ends[:, ends[0] != ends[1]].T.tolist():
            x, y = self._root(x), self._root(y)
            self.up[max(x, y)] = min(x, y)


def _candidates(coords: np.ndarray, budget: float, home: np.ndarray, left: np.ndarray, right: np.ndarray, axis: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right row within the budget, one of them at home at least; each unordered pair once where both sides are one."""
    same = left is right
    coords, reach = coords.astype(np.float32), budget**0.5 * (1 + 1e-4) + 1e-5
    left = left[np.argsort(coords[left, axis], kind="stable")]
    right = left if same else right[np.argsort(coords[right, axis], kind="stable")]
    line, squares = coords[right, axis], (coords * coords).sum(axis=1)
    at = 0
    while at < len(left):
        start = at if same else np.searchsorted(line, coords[left[at], axis] - reach)
        stop = np.searchsorted(line, coords[left[at], axis] + reach, "right")
        strip = max(1, min(len(left) - at, STRIP // max(1, stop - start), 1024))
        stop = np.searchsorted(line, coords[left[at + strip - 1], axis] + reach, "right")
        a, b = left[at : at + strip], right[start:stop]
        near = squares[a][:, None] + squares[b][None, :] - 2 * (coords[a] @ coords[b].T) <= budget * (1 + 1e-4) + 1e-5
        p, q = np.nonzero(near)
        use = home[a[p]] | home[b[q]]
        if same:
            use &= q > p  # both start at the same row
        yield a[p[use]], b[q[use]]
        at += strip


def _joined(least: float, axes: int):
    def run(key, table):
        dims, b, _, i, j = (k.as_py() for k in key)
        size = len(table.column("vector")[0].as_py()) // dims
        flat = b"".join(table.column("vector").to_pylist())
        units = unit(np.frombuffer(flat, {4: np.float32, 8: np.float64}[size]).reshape(-1, dims).astype(float))
        home, tile = table.column("home").to_numpy(), table.column("tile").to_numpy()
        copies, parts, turn = table.column("copies").to_numpy(), blocks(dims, least), rotation(dims)
        part, budget = parts[b]
        coords, links, forest = units @ turn[:, part], np.zeros(len(units), np.int64), Forest(len(units))
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        for p, q in _candidates(coords, budget, home, left, right, min(axes, coords.shape[1] - 1)):
            for at in range(0, len(p), PAIRS):
                x, y = p[at : at + PAIRS], q[at : at + PAIRS]
                linked = _dots(units[x], units[y]) >= least
                x, y = x[linked], y[linked]
                if len(x):
                    apart = (_turned(units[x], turn) - _turned(units[y], turn)) ** 2
                    within = [sum(apart[:, s].T) <= most for s, most in parts[: b + 1]]
                    mine = within[b] & ~np.logical_or.reduce([np.zeros(len(x), bool), *within[:b]])
                    x, y = x[mine], y[mine]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    forest.link(x, y)
        keys, roots, out = table.column("k").to_numpy(), forest.roots(), np.flatnonzero(links)
        return pa.table({"k": keys[out], "root": keys[roots[out]], "links": links[out]})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(id, n_links, component) of every row: how many other rows' vectors have a cosine of ``least`` (above -1) or more with its own, and the
    smallest id reachable over such links, its own included.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing, nor do vectors of different lengths with
    each other. Equal vectors are joined once and count as often as they occur. Rows with one id stay rows of their own; null ids link
    but name no group (a group of null ids alone has a null component). No rows give no rows; other columns are not read.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast("array<float>" if element == "float" else "array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v")))
    distinct = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("k", F.monotonically_increasing_id()), "vectors")
    sent = distinct.select("v", "k", "copies")

    n = distinct.count()
    axes = min(MOST_AXES, max(1, int(np.ceil(np.log2(max(n, 1) / tile)))))
    counts = sent.mapInArrow(_counted(least, axes), "dims int, block int, cell long, n long").groupBy("dims", "block", "cell").agg(F.sum("n").alias("n"))
    # only cells of more than a tile come to the driver: fewer than the grid's cells, and than entries / tile
    tiles = {(r.dims, r.block, r.cell): -(-r.n // tile) for r in counts.filter(F.col("n") > tile).toLocalIterator()}
    entries = sent.mapInArrow(_dealt(least, axes, tiles), ENTRY)
    linked = written(entries.groupBy("dims", "block", "cell", "i", "j").applyInArrow(_joined(least, axes), LINKED), "vector-links")

    groups = components(linked, "k", "root").withColumnRenamed("node", "k")
    totals = linked.groupBy("k").agg(F.sum("links").alias("links"))
    known = distinct.join(totals, "k", "left").join(groups, "k", "left").withColumn("component", F.coalesce("component", "k"))
    names = known.groupBy("component").agg(F.min("least_id").alias("name"))
    known = known.join(names, "component").select(F.col("v").alias("w"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "name")
    return rows.join(known, F.col("v") == F.col("w"), "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("name", "id").alias("component")
    )
