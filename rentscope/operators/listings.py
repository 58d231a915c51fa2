"""Listing search, filtering, ranking and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.operators.scale import all_of, any_of, instant

SORTS = ("price_asc", "price_desc", "updated_desc", "name_asc")
# Stand-ins for a missing price, so that unpriced listings come last either way.
NO_PRICE_ASC, NO_PRICE_DESC = 999_999_999, 0


def plan_conditions(
    min_bedrooms=None, max_bedrooms=None, min_price=None, max_price=None, min_sqft=None, max_sqft=None,
    available_before=None,
) -> list[Column]:
    tests = []
    for name, low, high in (
        ("bedrooms", min_bedrooms, max_bedrooms), ("price", min_price, max_price), ("area_sqft", min_sqft, max_sqft)
    ):
        if low is not None or high is not None:
            tests.append(P.in_range(F.col(name), low, high))
    if available_before is not None:
        tests.append(available_by(F.col("available_from"), available_before))
    return tests


def available_by(ts: Column, bound) -> Column:
    return ts.isNotNull() & (ts <= instant(bound))


def filter_listings(
    apartments: DataFrame, plans: DataFrame, *, city=None, zipcode=None, property_type=None, is_available=None,
    pets_allowed=None, has_parking=None, include_unscrapeable=False, **plan_options,
) -> DataFrame:
    """Conjunction of the options given; plan options keep apartments with at least one such plan."""
    tests = [P.not_contains_ci(F.col("title"), "senior")]
    if city:
        tests.append(P.contains_ci(F.col("city"), city))
    if zipcode:
        tests.append(F.col("zipcode") == zipcode)
    if pets_allowed is not None:
        tests.append(P.is_bool(F.col("pets_allowed"), pets_allowed))
    if has_parking is not None:
        tests.append(P.is_bool(F.col("has_parking"), has_parking))
    if property_type:
        tests.append(F.col("property_type") == property_type)
    if is_available is not None:
        tests.append(F.col("is_available") == is_available)
    if not include_unscrapeable:
        tests.append(P.not_value_or_null(F.col("data_source_type"), "unscrapeable"))
    out = apartments.where(all_of(tests))
    conditions = plan_conditions(**plan_options)
    if conditions:
        out = having_plan(out, plans, all_of(conditions))
    return out


def having_plan(apartments: DataFrame, plans: DataFrame, condition: Column) -> DataFrame:
    hits = plans.where(condition).select(F.col("apartment_id").alias("id"))
    return apartments.join(hits, "id", "left_semi")


def search(
    apartments: DataFrame, plans: DataFrame, text: str, min_bedrooms=None, max_bedrooms=None, min_price=None,
    max_price=None,
) -> DataFrame:
    """Free text over five columns.  Plan bounds apply only when one of them is non-zero."""
    fields = ("title", "description", "city", "zipcode", "address")
    found = apartments.where(any_of([F.coalesce(P.contains_ci(F.col(c), text), F.lit(False)) for c in fields]))
    if any([min_bedrooms, max_bedrooms, min_price, max_price]):
        found = having_plan(
            found, plans, all_of(plan_conditions(min_bedrooms, max_bedrooms, min_price, max_price))
        )
    return found.distinct()


def min_price_by_apartment(plans: DataFrame, column: str = "price") -> DataFrame:
    usable = plans.where(F.col("is_available") & F.col(column).isNotNull())
    return usable.groupBy("apartment_id").agg(F.min(column).alias("min_price"))


def with_min_price(apartments: DataFrame, plans: DataFrame) -> DataFrame:
    prices = min_price_by_apartment(plans).withColumnRenamed("apartment_id", "id")
    return apartments.join(prices, "id", "left")


def sort_listings(apartments: DataFrame, plans: DataFrame, sort: str = "price_asc") -> DataFrame:
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    if sort == "updated_desc":
        return apartments.orderBy(F.desc("updated_at"), "id")
    if sort == "name_asc":
        return apartments.orderBy("title", "id")
    priced = with_min_price(apartments, plans)
    if sort == "price_asc":
        return priced.orderBy(F.coalesce("min_price", F.lit(NO_PRICE_ASC)), "id")
    return priced.orderBy(F.coalesce("min_price", F.lit(NO_PRICE_DESC)).desc(), "id")


def page(ordered: DataFrame, skip: int, limit: int) -> DataFrame:
    return ordered.offset(skip).limit(limit)


def priced_plans(plans: DataFrame, apartments: DataFrame) -> DataFrame:
    """Available priced plans with their apartment's title, city and state."""
    names = apartments.select(F.col("id").alias("apartment_id"), F.col("title").alias("apartment_title"), "city", "state")
    return plans.where(F.col("is_available") & F.col("price").isNotNull()).join(names, "apartment_id")


def cheapest(plans: DataFrame, apartments: DataFrame, city=None, bedrooms=None, limit: int = 5) -> DataFrame:
    found = priced_plans(plans, apartments)
    if city:
        found = found.where(P.equals_ci(F.col("city"), city))
    if bedrooms is not None:
        found = found.where(F.col("bedrooms") == bedrooms)
    return found.orderBy("price", "id").limit(limit).select(
        F.col("id").alias("plan_id"), "apartment_id", "apartment_title", F.col("name").alias("plan_name"), "price",
        "bedrooms", "area_sqft",
    )


def cheapest_one_bed(plans: DataFrame, apartments: DataFrame, city: str) -> DataFrame:
    """Cheapest one-bed plan of the city, or of all cities when the city has none: one pass."""
    found = priced_plans(plans, apartments).where(F.col("bedrooms") == 1.0)
    elsewhere = F.coalesce((~P.equals_ci(F.col("city"), city)).cast("int"), F.lit(1))
    return found.orderBy(elsewhere, "price", "id").limit(1).select(
        F.col("id").alias("plan_id"), "price", F.col("name").alias("plan_name"), "apartment_title", "city"
    )


def primary_plans(plans: DataFrame) -> DataFrame:
    """Cheapest available priced plan of each apartment."""
    usable = plans.where(F.col("is_available") & F.col("price").isNotNull())
    best = usable.groupBy("apartment_id").agg(
        F.min_by(F.struct("id", "bedrooms", "price"), F.struct("price", "id")).alias("p")
    )
    return best.select(
        "apartment_id", F.col("p.id").alias("plan_id"), F.col("p.bedrooms").alias("bedrooms"),
        F.col("p.price").alias("price"),
    )


def similar(apartments: DataFrame, plans: DataFrame, apartment_id: int, limit: int | None = 5) -> DataFrame:
    """Other apartments of the city with a plan of like size within a quarter of the target's price.

    The counts are multiplied by the number of matching plans, as a double join would give them; they
    are computed from two per-apartment aggregates, so no pairs of plans are formed.
    """
    target = (
        primary_plans(plans.where(F.col("apartment_id") == apartment_id))
        .join(apartments.where(F.col("id") == apartment_id).select(F.col("id").alias("apartment_id"), "city"),
              "apartment_id")
        .select(F.col("city"), F.col("bedrooms").alias("t_beds"), F.col("price").alias("t_price"))
    )
    near = apartments.where((F.col("id") != apartment_id) & F.col("is_available")).join(target, "city")
    matches = (
        plans.where("is_available")
        .join(near.select(F.col("id").alias("apartment_id"), "t_beds", "t_price"), "apartment_id")
        .where((F.col("bedrooms") == F.col("t_beds"))
               & F.col("price").between(F.col("t_price") * 0.75, F.col("t_price") * 1.25))
        .groupBy("apartment_id")
        .agg(F.count(F.lit(1)).alias("n_match"), F.min(F.abs(F.col("price") - F.col("t_price"))).alias("price_diff"))
    )
    everything = plans.groupBy("apartment_id").agg(*plan_envelope(), F.count("id").alias("n_all"),
                                                   F.count_if("is_available").alias("n_avail"))
    out = near.join(matches.withColumnRenamed("apartment_id", "id"), "id").join(
        everything.withColumnRenamed("apartment_id", "id"), "id"
    )
    ordered = out.select(
        "id", "title", "city", "state", "address", "source_url", "latitude", "longitude", "min_price", "max_price",
        "min_beds", "max_beds", (F.col("n_match") * F.col("n_all")).alias("plan_count"),
        (F.col("n_match") * F.col("n_avail")).alias("available_count"), "price_diff",
    ).orderBy("price_diff", "id")
    return ordered if limit is None else ordered.limit(limit)


def plan_envelope() -> list[Column]:
    return [F.min("price").alias("min_price"), F.max("price").alias("max_price"),
            F.min("bedrooms").alias("min_beds"), F.max("bedrooms").alias("max_beds")]


def apartment_summary(apartments: DataFrame, plans: DataFrame) -> DataFrame:
    """Counts, range of positive prices over all plans and range of beds; no plan counts as zero."""
    positive = F.when(F.col("price") > 0, F.col("price"))
    per = plans.groupBy(F.col("apartment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("plan_count"), F.count_if("is_available").alias("available_count"),
        F.min(positive).alias("min_price"), F.max(positive).alias("max_price"),
        F.min("bedrooms").alias("min_beds"), F.max("bedrooms").alias("max_beds"),
        F.coalesce(F.bool_or(F.col("name").rlike(P.INCOME_PLAN)), F.lit(False)).alias("income_plan"),
    )
    zero = {"plan_count": 0, "available_count": 0, "min_beds": 0.0, "max_beds": 0.0, "income_plan": False}
    joined = apartments.join(per, "id", "left").fillna(zero, list(zero))
    return joined.withColumn(
        "income_restricted", F.coalesce(F.col("title").rlike(P.INCOME_TITLE), F.lit(False)) | F.col("income_plan")
    ).drop("income_plan")


def client_filter(
    summary: DataFrame, plans: DataFrame, text=None, cities=None, min_price=None, max_price=None, bedrooms=None
) -> DataFrame:
    """Title text, set of cities, overlap of the price range, any plan with one of the bed counts."""
    tests = []
    if text:
        tests.append(F.lower("title").contains(text.lower()))
    if cities:
        tests.append(F.col("city").isin(*cities))
    if min_price:
        tests.append(F.col("max_price") >= min_price)
    if max_price:
        tests.append(F.col("min_price") <= max_price)
    out = summary.where(all_of(tests))
    return having_plan(out, plans, F.col("bedrooms").isin(*bedrooms)) if bedrooms else out


def price_range_for_beds(summary: DataFrame, plans: DataFrame, bedrooms) -> DataFrame:
    """Price range of the available plans with the chosen bed counts, else the full range."""
    chosen = plans.where(F.col("is_available") & F.col("bedrooms").isin(*bedrooms) & F.col("price").isNotNull())
    per = chosen.groupBy(F.col("apartment_id").alias("id")).agg(
        F.min("price").alias("beds_min"), F.max("price").alias("beds_max")
    )
    return summary.join(per, "id", "left").select(
        "id", F.coalesce("beds_min", "min_price").alias("min_price"), F.coalesce("beds_max", "max_price").alias("max_price")
    )


def plan_groups(plans: DataFrame) -> DataFrame:
    """Plans under their (beds, baths, rounded sqft) group; groups and options cheapest first, unpriced last.

    Rows come out in display order through a distributed sort; no group is collected.
    """
    keys = ["apartment_id", "bedrooms", "bathrooms", "sqft_key"]
    keyed = plans.withColumn("sqft_key", F.floor(F.col("area_sqft") + 0.5))
    groups = keyed.groupBy(*keys).agg(
        F.min("price").alias("group_price"), F.count(F.lit(1)).alias("n_options"),
        F.min_by("name", "id").alias("group_name"),
    ).withColumnsRenamed({k: f"g_{k}" for k in keys})
    on = all_of([F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys])
    joined = keyed.join(groups, on).select(
        *keys, "group_price", "n_options", "group_name", F.col("id").alias("plan_id"), "price"
    )
    return joined.orderBy(
        "apartment_id", F.asc_nulls_last("group_price"), F.asc_nulls_last("bedrooms"), F.asc_nulls_last("bathrooms"),
        F.asc_nulls_last("sqft_key"), F.asc_nulls_last("price"), "plan_id",
    )


def price_rows(plans: DataFrame, units: DataFrame) -> DataFrame:
    """One row per available unit of a plan, else one for the plan itself; unpriced rows last.

    Plans with and without units are joined apart: an inner join can be split where one plan has very
    many units, the outer form of it could not.
    """
    open_units = units.where("is_available").select(
        "plan_id", F.concat(F.lit("u-"), F.col("id")).alias("row_key"), "price", "available_from"
    )
    links = plans.select(F.col("id").alias("plan_id"), "external_url")
    by_unit = open_units.join(links, "plan_id").select("row_key", "plan_id", "price", "available_from", "external_url")
    by_plan = plans.join(open_units.select(F.col("plan_id").alias("id")).distinct(), "id", "left_anti").select(
        F.concat(F.lit("p-"), F.col("id")).alias("row_key"), F.col("id").alias("plan_id"),
        F.coalesce("current_price", "price").alias("price"), "available_from", "external_url",
    )
    return by_unit.unionByName(by_plan).orderBy(F.asc_nulls_last("price"), "row_key")


def explode_listings(apartments: DataFrame, plans: DataFrame, history: DataFrame) -> DataFrame:
    """One listing point per history row of each available positively priced plan.

    A plan without history gets one point at its own price, dated by the apartment's update.
    """
    shown = plans.where(F.col("is_available") & (F.col("price") > 0)).select(
        F.col("id").alias("plan_id"), "apartment_id", F.col("name").alias("plan_name"),
        F.col("price").alias("plan_price"),
    ).join(apartments.select(F.col("id").alias("apartment_id"), "title", "updated_at"), "apartment_id")
    columns = ["apartment_id", "plan_id", "title", "plan_name", "price", "recorded_at"]
    told = history.select("plan_id", "price", "recorded_at").join(shown, "plan_id").select(*columns)
    silent = shown.join(history.select("plan_id").distinct(), "plan_id", "left_anti").withColumnsRenamed(
        {"plan_price": "price", "updated_at": "recorded_at"}
    )
    return told.unionByName(silent.select(*columns))


def favourites(favs: DataFrame, apartments: DataFrame, user_id: int) -> DataFrame:
    """A user's favourite apartments, newest first."""
    mine = favs.where(F.col("user_id") == user_id).select(F.col("apartment_id").alias("id"), "created_at", "fav_id")
    return apartments.join(mine, "id").orderBy(F.desc("created_at"), F.desc("fav_id"))
