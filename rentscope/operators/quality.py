"""Cleaning of scraped plans: contaminated names and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.operators.scale import count_if


def value_shares(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Per key: rows counted, the count of the most common value and the number of distinct values."""
    per = rows.groupBy(key, *values).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(key).agg(F.sum("c").alias("priced"), F.max("c").alias("most_common"), F.count(F.lit(1)).alias("values"))


def dominant_price(snapshot: DataFrame, key: str = "apartment_id") -> DataFrame:
    """Keys where more than half of at least four priced rows share one price."""
    shares = value_shares(snapshot.where(F.col("min_price").isNotNull()), key, "min_price")
    return shares.where((F.col("priced") >= 4) & (F.col("most_common") / F.col("priced") > 0.5)).select(key, "priced", "most_common")


def dominant_pair(snapshot: DataFrame) -> DataFrame:
    """The (min, max) pair on more than half of an apartment's fully priced rows, where other pairs exist."""
    full = snapshot.where(F.col("min_price").isNotNull() & F.col("max_price").isNotNull())
    per = full.groupBy("apartment_id", "min_price", "max_price").agg(F.count(F.lit(1)).alias("c"))
    totals = value_shares(full, "apartment_id", "min_price", "max_price").where(F.col("values") > 1)
    return per.join(totals, "apartment_id").where(F.col("c") / F.col("priced") > 0.5).select(
        "apartment_id", "min_price", "max_price"
    )


def null_dominant_pair(snapshot: DataFrame) -> DataFrame:
    hit = dominant_pair(snapshot).withColumn("_hit", F.lit(True))
    joined = snapshot.join(hit, ["apartment_id", "min_price", "max_price"], "left")
    keep = F.col("_hit").isNull()
    return joined.select(*[
        F.when(keep, F.col(c)).alias(c) if c in ("min_price", "max_price") else F.col(c) for c in snapshot.columns
    ])


def drop_dominant_name(batch: DataFrame, key: str = "apartment_id") -> DataFrame:
    """Batches of at least three rows where one name holds more than half are dropped whole."""
    shares = value_shares(batch, key, "name")
    bad = shares.where((F.col("priced") >= 3) & (F.col("most_common") / F.col("priced") > 0.5)).select(key)
    return batch.join(bad, key, "left_anti")


def from_detail_page() -> Column:
    return F.coalesce(F.col("adapter_name").isin(*P.DETAIL_PAGE_ADAPTERS), F.lit(False))


def is_sibling_row() -> Column:
    return ~from_detail_page() & P.looks_like_sibling(F.col("name"))


def bounded(price: str) -> Column:
    return F.when(F.col(price).between(P.RENT_FLOOR, P.RENT_CEILING), F.col(price))


def drop_siblings(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(~is_sibling_row())


def null_below_floor(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumns({c: F.when(~(F.col(c) < P.RENT_FLOOR), F.col(c)) for c in ("min_price", "max_price")})


def null_above_ceiling(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumns({c: F.when(~(F.col(c) > P.RENT_CEILING), F.col(c)) for c in ("min_price", "max_price")})


def null_dominant_price(snapshot: DataFrame) -> DataFrame:
    hit = dominant_price(snapshot).select("apartment_id", F.lit(True).alias("_hit"))
    joined = snapshot.join(hit, "apartment_id", "left")
    keep = F.col("_hit").isNull()
    return joined.select(*[
        F.when(keep, F.col(c)).alias(c) if c in ("min_price", "max_price") else F.col(c) for c in snapshot.columns
    ])


def sanitise(snapshot: DataFrame) -> DataFrame:
    """Sibling names, floor and ceiling, then the dominance test over what is left."""
    return null_dominant_price(null_above_ceiling(null_below_floor(drop_siblings(snapshot))))


def sanitise_summary(snapshot: DataFrame) -> DataFrame:
    """What each rule did, per apartment."""
    kept = ~is_sibling_row()
    counts = snapshot.groupBy("apartment_id").agg(
        count_if(~kept).alias("sibling_dropped"),
        count_if(kept & (F.col("min_price") < P.RENT_FLOOR)).alias("deposit_nulled"),
        count_if(kept & (F.col("min_price") > P.RENT_CEILING)).alias("ceiling_nulled"),
        F.bool_or(from_detail_page()).alias("filter_a_skipped"),
    )
    cleaned = null_above_ceiling(null_below_floor(drop_siblings(snapshot)))
    hit = dominant_price(cleaned).select("apartment_id", F.lit(True).alias("starting_from_triggered"))
    return counts.join(hit, "apartment_id", "left").fillna(False, ["starting_from_triggered"])
