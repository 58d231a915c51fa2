"""Merkle manifest of a dataset: every row a leaf, a tree for each group, a tree over the groups' roots, and a proof for each leaf.

A digest is a lowercase hex SHA-256; a node is the digest of its children's digests, joined as text. While a tree has several nodes on a
level, each run of three neighbours (the last may be shorter, even one node) becomes one node of the next level.

Trees are cut into superblocks of ``3 ** levels`` neighbouring leaves. Each superblock is reduced on its own; the superblocks' roots form
trees of the same kind, cut again, until every tree is one superblock. Then leaves and the outer nodes that their superblock needs
are cogrouped, and one task per superblock finishes reduction, proofs and folding. A task holds one superblock at a time, whatever the
size of a group.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentscope.llm.words import written

LEVELS = 7
PATHS = "tree string, pos long, slots array<int>, others array<string>, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of the values one after the other: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def group_key(name: Column) -> Column:
    """Key of a group's tree: null groups come first, the others in the order of their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def _up(level: list[str]) -> list[str]:
    return [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]


def _tower(leaves: list[str], n: int, levels: int) -> list[list[str]]:
    """Levels of nodes from the leaves to the top: a superblock among several climbs exactly ``levels``, a whole tree until one node is left."""
    tower = [leaves]
    while len(tower) <= levels if n > 3**levels else len(tower[-1]) > 1:
        tower.append(_up(tower[-1]))
    return tower


def _path(tower: list[list[str]], at: int) -> tuple[list[int], list[str]]:
    """For each level below the top: the place of the leaf's node in its run, and the digests of the run's other nodes, joined."""
    slots, others = [], []
    for level in tower[:-1]:
        first, slot = at - at % 3, at % 3
        run = level[first : first + 3]
        slots.append(slot)
        others.append("".join(run[:slot] + run[slot + 1 :]))
        at //= 3
    return slots, others


def fold(leaf: str, slots: list[int], others: list[str]) -> str:
    """The root that a leaf and its proof give."""
    for slot, rest in zip(slots, others, strict=True):
        leaf = digest(rest[: 64 * slot] + leaf + rest[64 * slot :])
    return leaf


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with ``pos``, their place in their tree by ``order`` (from 0), and ``n``, the number of the tree's rows.

    Rows are dealt out by ranges and sorted there; only the counts of a tree in each range, not its rows, are put in order. Rows equal in
    everything are interchangeable, and spread by a running number.
    """
    keys = (tree, *order, "_tie")
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    seated = written(dealt.withColumn("_seat", F.monotonically_increasing_id()), "merkle-seats").withColumn("_part", F.shiftright("_seat", 33))
    runs = seated.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_run")).agg(F.min("_seat").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_tree")
    before = F.sum("_n").over(whole.orderBy("_run")) - F.col("_n")
    placed = runs.select("_tree", "_run", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    joined = seated.join(placed, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_run")))
    return joined.withColumn("pos", F.col("_seat") + F.col("_shift")).drop("_seat", "_part", "_tree", "_run", "_shift")


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / 3**levels).cast("long"))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, n, digest) of the superblocks of nodes (tree, pos, n, digest): leaves of the next trees."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n, first = int(rows["n"].iloc[0]), rows.iloc[0]
        top = _tower(rows["digest"].tolist(), n, levels)[-1][0]
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["block"])], "n": [-(-n // 3**levels)], "digest": [top]})

    light = _in_blocks(nodes.select("tree", "pos", "n", "digest"), levels)
    return written(light.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, digest string"), "merkle-tops")


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """PATHS of every node up to its tree's root, by superblocks of superblocks."""
    blocked = _in_blocks(nodes.select("tree", "pos", "n", "digest"), levels)
    most = nodes.agg(F.max("n")).first()[0] or 0
    outer = _paths(_tops(nodes, levels), levels) if most > 3**levels else nodes.sparkSession.createDataFrame([], PATHS)

    def finish(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        tower = _tower(inner["digest"].tolist(), int(inner["n"].iloc[0]), levels)
        slots, others, root = _outer(above, tower[-1][0])
        paths = [_path(tower, i) for i in range(len(inner))]
        return pd.DataFrame({
            "tree": inner["tree"], "pos": inner["pos"], "slots": [p[0] + slots for p in paths], "others": [p[1] + others for p in paths], "root": root,
        })

    return written(_cogrouped(blocked, outer).applyInPandas(finish, PATHS), "merkle-paths")


def _cogrouped(blocked: DataFrame, outer: DataFrame):
    return blocked.groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))


def _outer(above: pd.DataFrame, top: str) -> tuple[list[int], list[str], str]:
    """What lies above a superblock: nothing where it is the whole tree."""
    if not len(above):
        return [], [], top
    row = above.iloc[0]
    return [int(s) for s in row["slots"]], list(row["others"]), row["root"]


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, slots, others, folded_root, verified) of rows (id string, tree string, leaf, seen).

    Order in a tree is that of (``_order``, leaf); ``tree`` is not null and trees are ordered by its UTF-8 bytes. ``slots`` and ``others``
    are the proof, from the leaf's run up to the top of all trees: the place in the run, and the other nodes of it, joined. ``seen`` is the
    leaf's digest as recomputed from the data at hand; it is folded with the proof and compared with the root. Rows equal in
    everything keep one place each. No rows give no rows.
    """
    leaves = numbered(rows, "tree", "_order", "leaf").withColumnRenamed("leaf", "digest")
    blocks = _tops(leaves, levels)
    inside = _paths(blocks, levels)
    subroots = inside.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    subroots = numbered(subroots, "tree", "name")
    across = subroots.select(F.col("pos").alias("_at"), "name").join(_paths(subroots, levels).withColumnRenamed("root", "top"), F.col("_at") == F.col("pos"))
    across = across.select(F.col("name").alias("tree"), F.col("slots").alias("up_slots"), F.col("others").alias("up_others"), "top")
    outer = inside.join(across, "tree").select(
        "tree", "pos", F.concat("slots", "up_slots").alias("slots"), F.concat("others", "up_others").alias("others"), F.col("root").alias("subroot"), F.col("top").alias("root")
    )

    def finish(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        tower = _tower(inner["digest"].tolist(), int(inner["n"].iloc[0]), levels)
        slots, others, root = _outer(above, tower[-1][0])
        paths = [(p[0] + slots, p[1] + others) for p in (_path(tower, i) for i in range(len(inner)))]
        return pd.DataFrame({
            "id": inner["id"], "leaf": inner["digest"], "subroot": above["subroot"].iloc[0], "root": root, "slots": [p[0] for p in paths],
            "others": [p[1] for p in paths], "folded_root": [fold(seen, *p) for seen, p in zip(inner["seen"], paths, strict=True)],
        })

    out = "id string, leaf string, subroot string, root string, slots array<int>, others array<string>, folded_root string"
    final = _cogrouped(_in_blocks(leaves.select("tree", "pos", "n", "id", "digest", "seen"), levels), outer).applyInPandas(finish, out)
    return final.withColumn("verified", F.col("folded_root") == F.col("root"))
