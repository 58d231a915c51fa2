"""Set operations that keep the first of several equal keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(order)).alias("r"))
    return picked.select(*keys, "r.*")


def union_first_wins(lists: Sequence[DataFrame], keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """All lists together; of rows with one key the earliest list wins, then the earliest row."""
    tagged = [df.withColumn("list", F.lit(i)) for i, df in enumerate(lists)]
    both = reduce(DataFrame.unionByName, tagged)
    picked = both.groupBy(*keys).agg(F.min_by(F.struct("list", *values), F.struct("list", order)).alias("r"))
    return picked.select(*keys, "r.*")


def missing_children(stored: DataFrame, fresh: DataFrame, parent: str, child: str) -> DataFrame:
    """Stored children absent from the fresh list of a parent that has one."""
    return stored.join(fresh.select(parent), parent, "left_semi").join(fresh.select(parent, child), [parent, child], "left_anti")
