"""Row validation: each rule that a row breaks adds its code to a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """Codes of the rules whose condition is true; unknown does not violate."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))


def subscription_rules() -> dict[str, Column]:
    pct = F.col("price_drop_pct")
    return {
        "price_drop_pct_range": (pct < 0) | (pct > 100),
        "target_not_below_baseline": F.col("target_price") >= F.col("baseline_price"),
    }


def apartment_rules() -> dict[str, Column]:
    return {
        "state_length": F.length("state") != 2,
        "zipcode_length": (F.length("zipcode") < 5) | (F.length("zipcode") > 10),
    }


def score_rules(*columns: str) -> dict[str, Column]:
    return {f"{c}_range": (F.col(c) < 0) | (F.col(c) > 100) for c in columns}


def scope_rules() -> dict[str, Column]:
    missing = lambda *cols: F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull()
    return {
        "no_target": missing("apartment_id", "plan_id", "unit_id", "city"),
        "area_disabled": ~missing("city", "zipcode", "min_bedrooms", "max_bedrooms"),
        "no_threshold": missing("target_price", "price_drop_pct"),
    }


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("violations", violations(rules))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
