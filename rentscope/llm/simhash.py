"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a bucket are stored vertically: plane j holds bit j of 64 fingerprints per machine word. One fingerprint is
compared with a whole block at once: each plane is XORed with its bit, the differing bits go through carry-save adders into
vertical counters that start so that their last carry means "over the radius", and a block is abandoned once every lane is over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.components import components
from rentscope.llm.words import release_memory, split_words, texts_of, written

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SEED = 42


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle of the A-Z-lowered text, repeats included, in text order."""
    parts = split_words(text.lower() if text else None)
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(parts) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set if it is set in over half of the hashes. No hashes give zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little") if len(hashes) else np.zeros(8, np.uint8)
    return int(set_bits.view(np.uint64)[0])


# ---- bit-sliced comparison ----


def planes_of(fingerprints: np.ndarray) -> np.ndarray:
    """(64, words) array: plane j holds bit j of all fingerprints, 64 lanes to a word; spare lanes are zero."""
    n = len(fingerprints)
    bits = np.unpackbits(np.ascontiguousarray(fingerprints).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _add(counter: list[np.ndarray], over: np.ndarray, carry: np.ndarray, level: int) -> None:
    """Add ``carry`` (weight 2**level) to the vertical counters; what leaves the last counter marks a lane as over."""
    for k in range(level, len(counter)):
        counter[k], carry = counter[k] ^ carry, counter[k] & carry
    np.bitwise_or(over, carry, out=over)


def within(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query index, lane index) of all pairs at ``radius`` or fewer differing bits."""
    levels = max(1, (radius + 1).bit_length())
    start = (1 << levels) - 1 - radius  # the counter overflows at radius + 1
    alive = np.arange(len(queries))
    shape = (len(queries), planes.shape[1])
    over = np.zeros(shape, np.uint64)
    counter = [np.full(shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    tail = np.uint64(0) if lanes % 64 == 0 else FULL << np.uint64(lanes % 64)
    over[:, -1] |= tail
    masks = np.where((queries[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), FULL, np.uint64(0))
    for j in range(0, BITS - 1, 3):
        a, b, c = (planes[k][None, :] ^ masks[alive, k][:, None] for k in (j, j + 1, j + 2))
        half = a ^ b
        _add(counter, over, half ^ c, 0)
        _add(counter, over, (a & b) | (half & c), 1) if levels > 1 else np.bitwise_or(over, (a & b) | (half & c), out=over)
        if j % 12 == 9:
            keep = ~(over == FULL).all(axis=1)
            if not keep.all():
                alive, over, counter = alive[keep], over[keep], [x[keep] for x in counter]
                if not len(alive):
                    return alive, alive
    _add(counter, over, planes[BITS - 1][None, :] ^ masks[alive, BITS - 1][:, None], 0)
    q, w = np.nonzero(over != FULL)
    lane_bits = np.unpackbits((~over[q, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, bit = np.nonzero(lane_bits)
    return alive[q[pair]], w[pair] * 64 + bit


class Forest:
    """Union-find over row positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def links(fingerprints: np.ndarray, sides: np.ndarray, diagonal: bool, radius: int, sets: list | None, similarity: float) -> list:
    """Spanning links of one tile: as many rows as keep its linked fingerprints connected, never all pairs.

    ``sides`` tells the two chunks of a tile apart; off the diagonal only pairs across them are compared. With ``sets``, a
    pair within the radius links only if the exact Jaccard similarity of its shingle sets is high enough; a pair whose ends
    are already connected is not verified again.
    """
    first = np.nonzero(sides == 0)[0]
    second = first if diagonal else np.nonzero(sides == 1)[0]
    if not len(first) or not len(second):
        return []
    planes, forest, out = planes_of(fingerprints[second]), Forest(len(fingerprints)), []
    step = max(1, (1 << 17) // planes.shape[1])
    for at in range(0, len(first), step):
        rows = first[at : at + step]
        q, lane = within(fingerprints[rows], planes, len(second), radius)
        i, j = rows[q], second[lane]
        if diagonal:
            i, j = i[i < j], j[i < j]
        if sets is not None and len(i):
            near = np.argsort(np.bitwise_count(fingerprints[i] ^ fingerprints[j]), kind="stable")
            i, j = i[near], j[near]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(x) == forest.root(y) or (sets is not None and _jaccard(sets[x], sets[y]) < similarity):
                continue
            forest.join(x, y)
            out.append((x, y))
    return out


def _small_links(ids, fps, bucket, radius) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal buckets of at most 64 rows: row i against row i + k, with lanes for pairs."""
    found_a, found_b, k = [], [], 1
    rows = np.arange(len(ids))
    while True:
        rows = rows[rows + k < len(ids)]
        rows = rows[bucket[rows] == bucket[rows + k]]
        if not len(rows):
            break
        q, _ = within(np.zeros(1, np.uint64), planes_of(fps[rows] ^ fps[rows + k]), len(rows), radius)
        lane = _[q == 0]
        found_a.append(ids[rows[lane]])
        found_b.append(ids[rows[lane] + k])
        k += 1
    empty = np.empty(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


EDGES = "a long, b long"


def _edge_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole buckets, as sorted batches bring them; one bucket (bounded by the tiling) is carried over at most."""
    rest = None
    for batch in batches:
        rows = batch.to_pandas()
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        last = rows.iloc[-1] if len(rows) else None
        if last is None:
            continue
        open_run = ((rows["bucket"] == last["bucket"]) & (rows["tile"] == last["tile"])).to_numpy()
        rest, done = rows[open_run], rows[~open_run]
        if len(done):
            yield done
    if rest is not None and len(rest):
        yield rest


def _compare(radius: int, similarity: float | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            bucket, tile = rows["bucket"].to_numpy(), rows["tile"].to_numpy()
            ids, fps = rows["id"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            sides, diagonal = rows["side"].to_numpy(), rows["diagonal"].to_numpy()
            cuts = np.nonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1]))[0] + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(ids)]
            if similarity is None:
                small = (ends - starts <= 64) & diagonal[starts]
                lane = np.repeat(small, ends - starts)
                run_id = np.repeat(np.arange(len(starts)), ends - starts)
                yield _edge_batch(*_small_links(ids[lane], fps[lane], run_id[lane], radius))
                starts, ends = starts[~small], ends[~small]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                sets = None if similarity is None else list(rows["shingles"].iloc[s:e])
                pairs = links(fps[s:e], sides[s:e], bool(diagonal[s]), radius, sets, similarity or 0.0)
                if pairs:
                    x, y = np.array(pairs).T
                    yield _edge_batch(ids[s:e][x], ids[s:e][y])

    return run


def _tiled(rows: DataFrame, weight: str, most: int, join: str | None = None) -> DataFrame:
    """Rows of each bucket, with buckets heavier than ``most`` cut into chunks that meet pairwise as tiles.

    Chunks are dealt by the id's hash. Buckets of one row go. The counts are combined before their shuffle; a hot bucket's
    rows spread over its tiles, so no task holds more than two chunks of one bucket. ``join`` is a join hint, for rows that Spark
    would take for fewer than they are.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).filter("n > 1")
    chunks = F.ceil(F.col("w") / most).cast("int")
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.col("chunks")).cast("int")
    sizes = sizes.select("bucket", chunks.alias("chunks"))
    dealt = rows.join(sizes.hint(join) if join else sizes, "bucket").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    keep = [c for c in rows.columns if c != weight]
    return dealt.select(
        *keep, (lo * F.col("chunks") + hi).alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("side"), (lo == hi).alias("diagonal"),
    )


def _edges(tiles: DataFrame, radius: int, similarity: float | None) -> DataFrame:
    sorted_tiles = tiles.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "id")
    return sorted_tiles.mapInArrow(_compare(radius, similarity), EDGES)


# ---- links at a small radius: exact, by equal blocks of bits ----


def blocks(radius: int, spare: int = 3) -> list[list[int]]:
    """Bit sets of which one at least is equal for any two fingerprints at ``radius`` or fewer differing bits.

    The 64 bits make radius + spare blocks; at least ``spare`` of them are untouched, so every choice of ``spare`` blocks is a key.
    """
    n = radius + spare
    edges = [round(k * BITS / n) for k in range(n + 1)]
    parts = [range(edges[k], edges[k + 1]) for k in range(n)]
    return [[bit for k in chosen for bit in parts[k]] for chosen in combinations(range(n), spare)]


def _key_rows(nodes: DataFrame, radius: int) -> DataFrame:
    masks = [sum(1 << b for b in bits) for bits in blocks(radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))
    return nodes.select("id", "fp", F.explode(keys).alias("bucket"), F.lit(1).alias("one"))


# ---- whole operators ----


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64-bit SimHash of ``width``-word shingles. Null and blank texts have fingerprint zero."""

    def run(batches):
        for texts, ids in texts_of(batches, text_col, id_col):
            fps = np.array([majority_bits(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(text_col).cast("string"), F.col(id_col).cast("long")).mapInArrow(run, "id long, fp long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", most: int = 4096) -> DataFrame:
    """(id, fp, component): documents linked by fingerprints at ``radius`` or fewer differing bits; component is the smallest id.

    Every row comes out once, also with a null id (its own component: null) or null text (fingerprint zero, linked like any
    other). Documents of equal fingerprint meet as one node, so groups of copies add no pairs. An empty table gives none.
    """
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = rows.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"))
    # Spark sizes the key rows as if each node still were one row, and would broadcast all of them from the driver.
    edges = _edges(_tiled(_key_rows(nodes, radius), "one", most, join="merge"), radius, None)
    reached = components(edges).select(F.col("node").alias("id"), F.col("component"))
    classes = nodes.join(reached, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    out = rows.join(classes, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


# ---- links at a large radius: exact similarity within bands ----

ROWS_PER_BAND = 4
BANDS = 16


def _sketches(width: int, id_col: str, text_col: str):
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, BANDS * ROWS_PER_BAND), dtype=np.uint64) | np.uint64(1)

    def bands_of(hashes: np.ndarray) -> list[int]:
        least = np.full(BANDS * ROWS_PER_BAND, FULL, np.uint64)
        for at in range(0, len(hashes), 4096):
            block = hashes[None, at : at + 4096]
            np.minimum(least, ((block ^ (block >> np.uint64(29))) * odd[0][:, None] + odd[1][:, None]).min(axis=1, initial=FULL), out=least)
        return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS_PER_BAND))]

    def run(batches):
        for texts, ids in texts_of(batches, text_col, id_col):
            fps, seqs, bands = [], [], []
            for t in texts:
                parts = split_words(t.lower() if t else None)
                hashes = np.unique(shingle_hashes(t, width))  # sets, as the similarity that the radius bounds
                fps.append(majority_bits(hashes))
                seqs.append(xxhash.xxh3_128_digest(b" ".join(parts)))
                bands.append(bands_of(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(seqs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "fp", "sequence", "bands"],
            )
        release_memory()

    return run


def _shingle_sets(width: int):
    """Distinct shingles as 32-bit values: half the bytes to shuffle, and a chance collision moves a similarity by 1 / size."""

    def run(batches):
        for texts, ids in texts_of(batches, "text", "id"):
            sets = [np.unique(shingle_hashes(t, width).astype(np.uint32)).view(np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], names=["id", "shingles"])
        release_memory()

    return run


def similar_groups(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24, id_col: str = "doc_id", text_col: str = "text", most: int = 4_000_000,
) -> DataFrame:
    """(id, component): documents linked by ``similarity`` or more of their ``width``-word shingle sets (Jaccard).

    At this similarity fingerprints differ by 10 bits in the mean and seldom by over 20, too many for equal blocks to be selective.
    Buckets are therefore bands of minimum shingle hashes (16 of 4; two texts at 0.8 share none in 2 of 10,000 cases); within
    them the bit-sliced comparison abandons what is over the radius and exact similarity decides the rest. Texts with equal words
    are one node. Null and blank texts are equal to each other. Rows with a null id come back with a null component.
    ``most`` bounds the shingles of one chunk of a bucket.
    """
    source = docs.select(F.col(text_col).cast("string"), F.col(id_col).cast("long"))
    rows = written(source.mapInArrow(_sketches(width, id_col, text_col), "id long, fp long, sequence binary, bands array<long>"), "sketches")
    nodes = rows.filter("id IS NOT NULL").groupBy("sequence").agg(F.min("id").alias("id"), F.min_by(F.struct("fp", "bands"), "id").alias("s"))
    keys = nodes.select("id", F.col("s.fp").alias("fp"), F.explode(F.array_distinct("s.bands")).alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    keys = written(keys.join(shared, "bucket"), "bands")
    wanted = source.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).join(keys.select("id").distinct(), "id", "left_semi")
    sets = wanted.mapInArrow(_shingle_sets(width), "id long, shingles array<int>")
    full = keys.join(sets, "id").select("id", "fp", "bucket", "shingles", F.size("shingles").alias("weight"))
    edges = _edges(_tiled(written(full, "sets"), "weight", most), radius, similarity)
    reached = components(edges).select(F.col("node").alias("first"), "component")
    classes = nodes.select("sequence", F.col("id").alias("first")).join(reached, "first", "left")
    classes = classes.select("sequence", F.coalesce("component", "first").alias("component"))
    out = rows.join(classes, "sequence", "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
