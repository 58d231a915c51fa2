"""Price-history analytics over the append-only (plan, time, price) fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.operators.scale import before, exact_avg, first_k, instant, lag_by_segment, newest, oldest

# A row's place in its plan's series: time first, then the arrival columns as tie-break.
ORDER = ("recorded_at", "seq", "line")


def since(history: DataFrame, as_of, days: int) -> DataFrame:
    return history.where(F.col("recorded_at") >= before(as_of, days=days))


def latest_prices(history: DataFrame) -> DataFrame:
    return newest(history, ["plan_id"], ORDER, ["price", "recorded_at"])


def earliest_prices(history: DataFrame) -> DataFrame:
    return oldest(history, ["plan_id"], ORDER, ["price", "recorded_at"])


def first_and_last(history: DataFrame) -> DataFrame:
    """First and last price per plan in one aggregation instead of a self join."""
    place = F.struct(*ORDER)
    return history.groupBy("plan_id").agg(
        F.min_by("price", place).alias("previous_price"), F.max_by("price", place).alias("current_price")
    )


def drop_percent(previous, current):
    return F.try_divide((previous - current) * 100, previous)


def top_drops(history: DataFrame, plans: DataFrame, apartments: DataFrame, as_of, days: int = 7, limit: int = 5) -> DataFrame:
    """Available plans whose last price in the window is below the first, largest drop first."""
    moved = first_and_last(since(history, as_of, days)).where(F.col("current_price") < F.col("previous_price"))
    ratio = (F.col("previous_price") - F.col("current_price")) / F.col("previous_price") * 100
    live = plans.where("is_available").select(F.col("id").alias("plan_id"), "apartment_id", F.col("name").alias("plan_name"))
    titles = apartments.select(F.col("id").alias("apartment_id"), F.col("title").alias("apartment_title"))
    return (
        moved.withColumn("ratio", ratio)
        .join(live, "plan_id")
        .join(titles, "apartment_id")
        .orderBy(F.desc("ratio"), "plan_id")
        .limit(limit)
        .select("plan_id", "apartment_id", "apartment_title", "plan_name", "previous_price", "current_price",
                F.round("ratio", 1).alias("drop_pct"))
    )


def price_trends(history: DataFrame, plans: DataFrame, apartments: DataFrame, as_of, days: int = 30, city=None, bedrooms=None):
    """Average price per calendar day of the plans asked for; one aggregation, combined before its shuffle."""
    chosen = plans if bedrooms is None else plans.where(F.col("bedrooms") == bedrooms)
    areas = apartments.where(F.col("city").ilike(f"%{city}%")) if city else apartments
    kept = chosen.select(F.col("id").alias("plan_id"), "apartment_id").join(
        areas.select(F.col("id").alias("apartment_id")), "apartment_id"
    )
    return (
        since(history, as_of, days)
        .select("plan_id", "price", F.to_date("recorded_at").alias("day"))
        .join(kept, "plan_id")
        .groupBy("day")
        .agg(exact_avg("price").alias("avg_price"))
        .orderBy("day")
    )


def last_two(history: DataFrame) -> DataFrame:
    """Newest price and the one before it (NULL when there is none)."""
    two = first_k(history, ["plan_id"], [F.desc(c) for c in ORDER], 2)
    return two.groupBy("plan_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("price"))).alias("price"),
        F.max(F.when(F.col("rn") == 1, F.col("recorded_at"))).alias("recorded_at"),
        F.max(F.when(F.col("rn") == 2, F.col("price"))).alias("previous_price"),
    )


def previous_prices(history: DataFrame) -> DataFrame:
    return last_two(history).select("plan_id", "previous_price")


def price_moves(history: DataFrame) -> DataFrame:
    """Rows whose price differs from the row before it in the plan's series (first rows included)."""
    lagged = lag_by_segment(history, "plan_id", F.to_date("recorded_at"), ORDER, "price")
    return lagged.where(~F.col("price").eqNullSafe(F.col("previous")) | ~F.col("has_previous"))


def carry_forward(history: DataFrame, plans: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """New history rows repeating each plan's newest price at ``as_of``, and plans with it as current price."""
    last = newest(history, ["plan_id"], ORDER, ["price"])
    mine = plans.select(F.col("id").alias("plan_id"))
    rows = last.join(mine, "plan_id", "left_semi").select("plan_id", "price", instant(as_of).alias("recorded_at"))
    synced = (
        plans.join(last.select(F.col("plan_id").alias("id"), F.col("price").alias("_p"), F.lit(True).alias("_has")), "id", "left")
        .withColumn("current_price", F.when(F.col("_has"), F.col("_p")).otherwise(F.col("current_price")))
        .drop("_p", "_has")
    )
    return rows, synced


def newest_with_ties(history: DataFrame) -> DataFrame:
    """All rows at each plan's greatest timestamp: a max joined back, ties kept."""
    top = history.groupBy("plan_id").agg(F.max("recorded_at").alias("recorded_at"))
    return history.join(top, ["plan_id", "recorded_at"])


def thirty_day_low(history: DataFrame, plans: DataFrame, as_of, level: str) -> DataFrame:
    per_plan = since(history, as_of, 30).groupBy("plan_id").agg(F.min("price").alias("low"))
    if level == "plan":
        return per_plan
    owner = plans.select(F.col("id").alias("plan_id"), "apartment_id")
    return per_plan.join(owner, "plan_id").groupBy("apartment_id").agg(F.min("low").alias("low"))


def series(history: DataFrame, plan_id: int) -> DataFrame:
    return history.where(F.col("plan_id") == plan_id).orderBy(*ORDER)


def growth(history: DataFrame, as_of, days: int) -> DataFrame:
    """Rows and distinct plans per day; plans are made distinct by grouping, not by a set per day."""
    recent = history.where(F.col("recorded_at") > before(as_of, days=days))
    per_plan = recent.groupBy(F.to_date("recorded_at").alias("day"), "plan_id").agg(F.count(F.lit(1)).alias("n"))
    return per_plan.groupBy("day").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_plans"))


def growth_totals(daily: DataFrame) -> DataFrame:
    total, days = F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))
    return daily.agg(
        total.alias("total_rows"), days.alias("days_with_data"), F.round(F.try_divide(total, days), 1).alias("rows_per_day")
    )


def last_seen(apartments: DataFrame, plans: DataFrame, history: DataFrame) -> DataFrame:
    """Newest history time of an apartment's plans, else its own last visit."""
    per_plan = history.groupBy("plan_id").agg(F.max("recorded_at").alias("m"))
    owner = plans.select(F.col("id").alias("plan_id"), F.col("apartment_id").alias("id"))
    per_apartment = per_plan.join(owner, "plan_id").groupBy("id").agg(F.max("m").alias("m"))
    return apartments.join(per_apartment, "id", "left").select("id", F.coalesce("m", "last_scraped_at").alias("latest"))


def rekey_to_plans(parent_history: DataFrame, plans: DataFrame) -> DataFrame:
    """Each parent row repeated for every plan of the apartment."""
    return parent_history.join(plans.select("apartment_id", F.col("id").alias("plan_id")), "apartment_id").select(
        "plan_id", "price", "recorded_at"
    )


def rekey_to_apartments(history: DataFrame, plans: DataFrame) -> DataFrame:
    owner = plans.select(F.col("id").alias("plan_id"), "apartment_id")
    return history.join(owner, "plan_id").select("apartment_id", "price", "recorded_at")


def newest_point(history: DataFrame, as_of) -> DataFrame:
    """Newest point of each plan with a drop flag and a Today / Yesterday / date label."""
    days = (F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(F.col("recorded_at").cast("timestamp"))) / 86_400_000_000
    return last_two(history).select(
        "plan_id", "price", "previous_price",
        F.coalesce((F.col("previous_price") != 0) & (F.col("price") < F.col("previous_price")), F.lit(False)).alias("dropped"),
        F.when(days < 1, "Today").when(days < 2, "Yesterday").otherwise(F.date_format("recorded_at", "MMM d")).alias("label"),
    )


