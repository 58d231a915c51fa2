"""Building blocks that stay correct and bounded when one key holds a large share of the rows.

Every helper either aggregates before it shuffles, limits per task before it shuffles, or splits a
key into segments whose size does not grow with the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentscope.session import ensure_checkpoint_dir


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder: later steps neither recompute nor re-plan what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def instant(as_of) -> Column:
    """A zone-less timestamp literal; Columns pass through."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def before(as_of, **interval) -> Column:
    """``as_of`` minus an interval such as ``days=7``."""
    return instant(as_of) - F.expr(" + ".join(f"interval {n} {unit}" for unit, n in interval.items()))


def exact_avg(col: str | Column) -> Column:
    """Average summed in decimals: the same value whatever the order rows arrive in."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(18,8)")).cast("double") / F.count(c)


def exact_sum(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(18,8)")).cast("double")


def count_if(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("bigint")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: ``values`` of the row with the greatest ``order``; combines before the shuffle."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key.  Spark limits each key inside every map task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def lag_by_segment(df: DataFrame, key: str, segment: Column, order: Sequence[str], value: str, out: str = "previous") -> DataFrame:
    """``lag(value)`` per key, with ``has_previous`` telling a first row from a NULL before it.

    Every key is windowed per segment (say a day); the last value of each segment is carried to the first row of the key's next one
    through a table of one row per key and segment.  ``segment`` must rise with ``order``.
    """
    parted = df.withColumn("_seg", segment)
    held = F.struct(F.col(value).alias("v"))
    local = parted.withColumn("_prev", F.lag(held).over(Window.partitionBy(key, "_seg").orderBy(*order)))
    ends = parted.groupBy(key, "_seg").agg(F.max_by(held, F.struct(*order)).alias("_end"))
    carried = ends.select(
        key, "_seg", F.lag("_end").over(Window.partitionBy(key).orderBy("_seg")).alias("_carry")
    ).where(F.col("_carry").isNotNull())
    joined = local.join(carried, [key, "_seg"], "left")
    return joined.withColumn(out, F.coalesce("_prev", "_carry")["v"]).withColumn(
        "has_previous", F.coalesce("_prev", "_carry").isNotNull()
    ).drop("_seg", "_prev", "_carry")


def _value_bucket(v: Column) -> Column:
    """Rises with ``v``; about a thousand buckets per doubling, so a key has a bounded number."""
    return F.signum(v).cast("bigint") * F.floor(F.log2(F.abs(v) + 1) * 1024)


# Distinct values that one task may put in order.
LEAF = 4096


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], leaf: int = LEAF) -> DataFrame:
    """Exact order statistics per key.

    ``ranks`` maps an output name to a 0-based rank written over the column ``n`` (rows per key).
    Equal values are counted first, and buckets of values narrow each rank to one bucket.  While a wanted bucket holds more than ``leaf``
    distinct values, its range is cut into 1,024 equal parts and the part of the rank goes on, so no task orders more than ``leaf`` values
    of a key or 1,024 sums.  Output: keys, ``n`` and one column per rank.
    """
    keys = list(keys)
    counted = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", _value_bucket(F.col("_v")))
    )
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_distinct"))
        .withColumn("_from", F.sum("_bc").over(running) - F.col("_bc"))
        .withColumn("n", F.sum("_bc").over(by_key))
    )
    wanted = (
        buckets.withColumn(
            "_w", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
                                      for name, rank in ranks.items()]))
        )
        .where((F.col("_w.rank") >= F.col("_from")) & (F.col("_w.rank") < F.col("_from") + F.col("_bc")))
        .select(*keys, "_b", "n", "_distinct", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_from")).alias("_rank"))
    )
    held = _join(counted, wanted.drop("_distinct"), [*keys, "_b"]).drop("_b")
    most = wanted.agg(F.max("_distinct")).first()[0] or 0
    while most > leaf:
        held, most = _narrowed(held, keys)
    inside = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = held.withColumn("_to", F.sum("_c").over(inside)).where(
        (F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c"))
    )
    return hit.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns that may be NULL on both sides."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = all_of([F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, same).drop(*[f"_r_{c}" for c in on])


def _narrowed(held: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """The values in the part of each range that holds its rank, and the greatest number of distinct values left in one."""
    ranges = held.groupBy(*keys, "_name").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    parted = _join(held, ranges, [*keys, "_name"]).withColumn("_part", F.floor(F.coalesce(share, F.lit(0)) * 1024)).drop("_low", "_high")
    sums = parted.groupBy(*keys, "_name", "_part").agg(F.sum("_c").alias("_pc"), F.min("_rank").alias("_r"), F.count(F.lit(1)).alias("_distinct"))
    running = Window.partitionBy(*keys, "_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sums.withColumn("_from", F.sum("_pc").over(running) - F.col("_pc"))
    chosen = cut_lineage(placed.where((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_from") + F.col("_pc"))))
    kept = _join(parted, chosen.select(*keys, "_name", "_part", "_from"), [*keys, "_name", "_part"])
    left = kept.withColumn("_rank", F.col("_rank") - F.col("_from")).drop("_part", "_from")
    return cut_lineage(left), chosen.agg(F.max("_distinct")).first()[0]


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Interpolated quantile per key (keys, ``n``, ``out``), equal to ``percentile(value, q)``."""
    pos = (F.col("n") - 1) * F.lit(float(q))
    stats = order_statistics(df, keys, value, {"_lo": F.floor(pos), "_hi": F.ceil(pos)})
    return stats.withColumn(
        out, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))
    ).drop("_lo", "_hi")


def lookup(df: DataFrame, side: DataFrame, key: str, spread_by: str = "id") -> DataFrame:
    """Left join on ``key`` where many rows may have none.

    Rows without a key match nothing; a salt spreads them instead of sending all of them to one task.
    """
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(4096))).otherwise(0)
    salted = df.withColumn("_salt", salt.cast("int"))
    return salted.join(side.withColumn("_salt", F.lit(0)), [key, "_salt"], "left").drop("_salt")


def running_number(df: DataFrame, buckets: Column | Sequence[Column], order: Sequence[str], out: str) -> DataFrame:
    """1-based position over all rows in the order of (buckets, order), with one task per bucket.

    ``buckets`` go from coarse to fine, each rising with ``order``; the finest should hold a bounded number of rows and each other one a
    bounded number of the next.  Sums of the coarsest alone are put in order in one place, those of a finer one per bucket above it.
    """
    buckets = [buckets] if isinstance(buckets, Column) else list(buckets)
    names = [f"_bk{i}" for i in range(len(buckets))]
    parted = df.withColumns(dict(zip(names, buckets, strict=True)))
    sizes = parted.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    offsets = None
    for depth in range(len(names)):
        level = sizes.groupBy(*names[: depth + 1]).agg(F.sum("_size").alias("_size"))
        above = Window.partitionBy(*names[:depth]) if depth else Window
        running = above.orderBy(names[depth]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = level.select(*names[: depth + 1], (F.sum("_size").over(running) - F.col("_size")).alias("_here"))
        offsets = here.withColumnRenamed("_here", "_off") if offsets is None else here.join(offsets, names[:depth]).select(
            *names[: depth + 1], (F.col("_off") + F.col("_here")).alias("_off")
        )
    local = parted.withColumn("_pos", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return local.join(offsets, names).withColumn(out, F.col("_off") + F.col("_pos")).drop(*names, "_pos", "_off")


def number_by_hash(df: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    """Dense 1-based numbers for rows with a unique ``key``, in order of the key's md5.

    Two prefixes of the md5 are the buckets, 4,096 coarse ones of 4,096 each, so even keys of one parent spread over all of them.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])))
    return running_number(hashed, [F.substring("_h", 1, 3), F.substring("_h", 1, 6)], ["_h", *key], out).drop("_h")
