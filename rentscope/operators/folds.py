"""Folds of scraped rows into one row per plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_known(column: str, order: str) -> Column:
    """Value of the first row, in order, that has one."""
    c = F.col(column)
    return F.min_by(c, F.when(c.isNotNull(), F.col(order)))


def price_rank(price: str, order: str) -> Column:
    """Sorts priced rows first, cheapest first, then by arrival."""
    return F.struct(F.col(price).isNull().alias("unpriced"), F.col(price), F.col(order))


def price_envelope(units: DataFrame, key: str, price: str) -> DataFrame:
    """Lowest price, and the highest unless it is the same."""
    return units.groupBy(key).agg(F.min(price).alias("price"), F.nullif(F.max(price), F.min(price)).alias("max_price"))


def representative(rows: DataFrame, keys: Sequence[str], order: str, price: str, values: Sequence[str]) -> DataFrame:
    """The cheapest row of each key (first on ties); the first row when none is priced."""
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), price_rank(price, order)).alias("r"))
    return picked.select(*keys, "r.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: str, price: str, date: str) -> DataFrame:
    """Cheapest price with the date it came with; sqft, beds and baths from the first row that has them."""
    return rows.groupBy(*keys).agg(
        F.min_by(price, price_rank(price, order)).alias("price"), F.min_by(date, price_rank(price, order)).alias(date),
        *[first_known(c, order).alias(c) for c in ("size_sqft", "bedrooms", "bathrooms")],
    )


def cheapest_available(rows: DataFrame, keys: Sequence[str], order: str, price: str, available: str) -> DataFrame:
    """Cheapest available price, available if any row is; beds and baths of the first row, first known sqft."""
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col(available), F.col(price))).alias("price"), F.bool_or(available).alias("is_available"),
        first_known("size_sqft", order).alias("size_sqft"), F.min_by("bedrooms", order).alias("bedrooms"),
        F.min_by("bathrooms", order).alias("bathrooms"),
    )
