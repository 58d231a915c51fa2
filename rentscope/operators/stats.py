"""Market statistics over apartments and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.operators.listings import plan_envelope, primary_plans
from rentscope.operators.scale import count_if, exact_avg, exact_quantile


def cities(apartments: DataFrame) -> DataFrame:
    shown = apartments.where(F.col("is_available") & P.not_contains_ci(F.col("title"), "senior"))
    return shown.select("city").distinct().orderBy("city")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _in_city(plans: DataFrame, apartments: DataFrame, city) -> DataFrame:
    if not city:
        return plans
    hits = apartments.where(P.contains_ci(F.col("city"), city)).select(F.col("id").alias("apartment_id"))
    return plans.join(hits, "apartment_id", "left_semi")


def average_by_bedrooms(plans: DataFrame, apartments: DataFrame, column: str, out: str, city=None) -> DataFrame:
    return _in_city(plans, apartments, city).groupBy("bedrooms").agg(exact_avg(column).alias(out)).orderBy("bedrooms")


def _asked(plans: DataFrame, apartments: DataFrame) -> DataFrame:
    where = apartments.select(F.col("id").alias("apartment_id"), "city", F.col("is_available").alias("listed"))
    return plans.where(F.col("is_available") & F.col("price").isNotNull()).join(where, "apartment_id")


def median_by_city_beds(plans: DataFrame, apartments: DataFrame) -> DataFrame:
    """Exact median and count of asking prices per (city, bedrooms)."""
    asked = _asked(plans, apartments).withColumn("city", F.lower("city"))
    return exact_quantile(asked, ["city", "bedrooms"], "price", 0.5, "median").withColumnRenamed("n", "plan_count")


def median_of_midpoints(summary: DataFrame) -> DataFrame:
    """Median of the middle of each price range; 0 when no listing has both ends."""
    mid = summary.where(F.col("min_price").isNotNull() & F.col("max_price").isNotNull()).select(
        ((F.col("min_price") + F.col("max_price")) / 2).alias("mid")
    )
    return exact_quantile(mid, [], "mid", 0.5, "m").agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("median"))


def market_position(plans: DataFrame, apartments: DataFrame) -> DataFrame:
    """Each apartment's primary plan against its city's median for the same beds (listed apartments only)."""
    medians = exact_quantile(
        _asked(plans, apartments).where("listed"), ["city", "bedrooms"], "price", 0.5, "city_median"
    ).withColumnRenamed("n", "city_plan_count")
    mine = primary_plans(plans).join(apartments.select(F.col("id").alias("apartment_id"), "city"), "apartment_id")
    joined = mine.join(medians, ["city", "bedrooms"], "left")
    return joined.select(
        "apartment_id", "city", "bedrooms", "price", "city_median",
        F.coalesce("city_plan_count", F.lit(0)).alias("city_plan_count"),
        fraction_vs_median(F.col("price"), F.col("city_median")).alias("pct_vs_median"),
    )


def fraction_vs_median(price, median):
    return F.when(median > 0, F.round((price - median) / median, 4))


def plan_quality(plans: DataFrame) -> DataFrame:
    sized = F.col("area_sqft").isNotNull() & (F.col("area_sqft") > 0)
    clean = F.col("name").isNotNull() & ~F.col("name").isin(*P.UNCLEAN_NAMES)
    pct = lambda cond: F.round(F.try_divide(F.count_if(cond) * 100.0, F.count(F.lit(1))), 1)
    return plans.agg(
        F.count(F.lit(1)).alias("total_plans"), count_if(sized).alias("with_sqft"), pct(sized).alias("sqft_pct"),
        count_if(clean).alias("clean_name"), pct(clean).alias("clean_name_pct"),
        F.count("current_price").alias("priced"), F.count("external_url").alias("with_url"),
        F.count("floor_level").alias("with_floor"),
    )


def suspicious_names(plans: DataFrame) -> DataFrame:
    return count_by(plans.where(F.lower("name").isin(*P.SUSPICIOUS_NAMES)), "name").orderBy(F.desc("n"), "name")


def zero_area_report(plans: DataFrame, apartments: DataFrame) -> DataFrame:
    """Counts are taken per apartment before the titles are joined."""
    per = plans.groupBy(F.col("apartment_id").alias("id")).agg(
        F.count_if(F.col("area_sqft") == 0).alias("zero_sqft"), F.count_if(F.col("area_sqft") > 0).alias("good_sqft"),
        F.count(F.lit(1)).alias("total"),
    ).where(F.col("zero_sqft") > 0)
    return per.join(apartments.select("id", "title", "city"), "id").select("title", "city", "zero_sqft", "good_sqft", "total")


def coverage_by_apartment(plans: DataFrame, apartments: DataFrame) -> DataFrame:
    """Plans, priced, sized and cleanly named plans per apartment, plus one TOTAL row."""
    bad = F.lower("name").isin(*P.COVERAGE_BAD_NAMES)
    per = plans.groupBy(F.col("apartment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_plans"), F.count_if(F.coalesce(F.col("current_price"), F.lit(0)) != 0).alias("priced"),
        F.count_if(F.col("area_sqft") > 0).alias("with_sqft"), F.count_if(F.col("name").isNotNull() & ~bad).alias("clean_name"),
    )
    measures = ["n_plans", "priced", "with_sqft", "clean_name"]
    rows = apartments.select("id", "title", "city").join(per, "id", "left").fillna(0, measures)
    return rows.rollup(F.struct("id", "title", "city").alias("k")).agg(*[F.sum(m).alias(m) for m in measures]).select(
        F.coalesce("k.title", F.lit("TOTAL")).alias("title"), F.coalesce("k.city", F.lit("")).alias("city"), *measures
    )


def reclassification_check(apartments: DataFrame) -> DataFrame:
    kind = F.col("data_source_type")
    return apartments.where("is_available").agg(
        count_if(kind == "legal_block").alias("legal_block"), count_if(kind == "unscrapeable").alias("unscrapeable_visible"),
        count_if((kind == "brand_site") | kind.isNull()).alias("scrapeable"),
    )


def min_max_by_apartment(plans: DataFrame) -> DataFrame:
    return plans.groupBy("apartment_id").agg(*plan_envelope())


def rollup_from_plans(snapshot: DataFrame) -> DataFrame:
    """Apartment row from its scraped plans: cheapest available price and beds, smallest bath count."""
    live = availability_flag(F.col("availability"))
    price = F.min(F.when(live & (F.col("min_price") != 0), F.col("min_price")))
    return snapshot.groupBy("apartment_id").agg(
        price.alias("current_price"), F.coalesce(F.min(F.when(live, F.col("bedrooms"))), F.lit(1.0)).alias("bedrooms"),
        F.coalesce(F.min("bathrooms"), F.lit(1.0)).alias("bathrooms"), price.isNotNull().alias("is_available"),
    )


def availability_flag(text):
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~low.contains("waitlist") & ~low.contains("unavailable")


def batch_yield(apartments: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans, priced and sized plans of a batch with whole percents, and how many listings gave any."""
    per = coverage_by_apartment(plans, apartments).where(F.col("title") != "TOTAL")
    pct = lambda c: F.coalesce(F.floor(F.try_divide(F.sum(c) * 100, F.sum("n_plans"))), F.lit(0))
    return per.agg(
        count_if(F.col("n_plans") > 0).alias("with_plans"), F.count(F.lit(1)).alias("listings"),
        F.sum("n_plans").alias("plans"), F.sum("priced").alias("priced"), pct("priced").alias("priced_pct"),
        F.sum("with_sqft").alias("with_sqft"), pct("with_sqft").alias("sqft_pct"),
    )
