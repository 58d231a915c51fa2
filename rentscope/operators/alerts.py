"""Price-alert evaluation: latest and previous price per rule, triggers, messages and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import labels as T
from rentscope.functions.messages import one_decimal
from rentscope.operators.history import last_two, thirty_day_low
from rentscope.operators.listings import min_price_by_apartment
from rentscope.operators.scale import before, instant, lookup

DEBOUNCE_HOURS = 24


def level() -> Column:
    """What a rule watches; the narrowest target wins."""
    return (
        F.when(F.col("unit_id").isNotNull(), "unit").when(F.col("plan_id").isNotNull(), "plan")
        .when(F.col("apartment_id").isNotNull(), "apartment").otherwise("area")
    )


def area_averages(plans: DataFrame, apartments: DataFrame, priced_only: bool = False) -> DataFrame:
    """Sum and count of available plans per (city, zipcode, bedrooms) and with city, zipcode or both left open.

    This small cube stands in for the plans wherever a rule leaves part of the area open, so that a rule
    meets one row per bed count instead of every plan it covers.
    """
    live = plans.where("is_available")
    if priced_only:
        live = live.where(F.col("price").isNotNull())
    where = apartments.select(F.col("id").alias("apartment_id"), F.lower("city").alias("city"), "zipcode")
    base = live.join(where, "apartment_id").groupBy("city", "zipcode", "bedrooms").agg(
        F.sum(F.col("price").cast("decimal(18,8)")).alias("s"), F.count("price").alias("n"), F.count(F.lit(1)).alias("plans")
    )
    opened = F.explode(F.array(*[
        F.struct(F.lit(c and z).alias("_"), F.lit(c).alias("open_city"), F.lit(z).alias("open_zip"))
        for c in (False, True) for z in (False, True)
    ]))
    wide = base.withColumn("o", opened).select(
        F.when(F.col("o.open_city"), "*").otherwise(F.concat(F.lit("="), "city")).alias("city_key"),
        F.when(F.col("o.open_zip"), "*").otherwise(F.concat(F.lit("="), "zipcode")).alias("zip_key"),
        "bedrooms", "s", "n", "plans",
    )
    return wide.groupBy("city_key", "zip_key", "bedrooms").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("plans").alias("plans")
    )


def area_prices(rules: DataFrame, plans: DataFrame, apartments: DataFrame, priced_only: bool = False) -> DataFrame:
    """(id, price, plans): average price of the plans each area rule covers; an open bound matches any."""
    key = lambda c, lower: F.when(
        F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit("="), F.lower(c) if lower else F.col(c))
    ).otherwise("*")
    keyed = rules.select("id", key("city", True).alias("city_key"), key("zipcode", False).alias("zip_key"),
                         "min_bedrooms", "max_bedrooms")
    # Rules with the same scope share one lookup, so many open rules do not repeat the same range test.
    scope = ["city_key", "zip_key", "min_bedrooms", "max_bedrooms"]
    scopes = keyed.select(*scope).distinct()
    covered = (F.col("min_bedrooms").isNull() | (F.col("bedrooms") >= F.col("min_bedrooms"))) & (
        F.col("max_bedrooms").isNull() | (F.col("bedrooms") <= F.col("max_bedrooms"))
    )
    found = (
        scopes.join(area_averages(plans, apartments, priced_only), ["city_key", "zip_key"])
        .where(covered)
        .groupBy(*scope)
        .agg((F.sum("s").cast("double") / F.nullif(F.sum("n"), F.lit(0))).alias("price"), F.sum("plans").alias("plans"))
        .withColumnsRenamed({c: f"s_{c}" for c in scope})
    )
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in scope]
    return keyed.join(found, same[0] & same[1] & same[2] & same[3], "left").select("id", "price", "plans")


def rule_prices(rules: DataFrame, units: DataFrame, plans: DataFrame, apartments: DataFrame, history: DataFrame) -> DataFrame:
    """Rules with ``latest_price`` and ``previous_price``.

    Unit rules read the unit's price while it is available, plan rules the two newest history rows,
    apartment rules the cheapest current price, area rules the average over the plans they cover.
    """
    tagged = rules.withColumn("level", level())
    unit_prices = units.where("is_available").select(F.col("id").alias("unit_id"), F.col("price").alias("p_unit"))
    watched = tagged.where(F.col("level") == "plan").select("plan_id")
    plan_prices = last_two(history.join(watched.distinct(), "plan_id", "left_semi")).select(
        "plan_id", F.col("price").alias("p_plan"), F.col("previous_price").alias("prev_plan")
    )
    apartment_prices = min_price_by_apartment(plans, "current_price").withColumnRenamed("min_price", "p_apt")
    area = area_prices(tagged.where(F.col("level") == "area"), plans, apartments).select("id", F.col("price").alias("p_area"))
    joined = lookup(lookup(lookup(tagged, unit_prices, "unit_id"), plan_prices, "plan_id"), apartment_prices, "apartment_id").join(
        area, "id", "left"
    )
    of_level = lambda name: F.col("level") == name
    return joined.withColumns({
        "latest_price": F.when(of_level("unit"), F.col("p_unit")).when(of_level("plan"), F.col("p_plan"))
        .when(of_level("apartment"), F.col("p_apt")).otherwise(F.col("p_area")),
        "previous_price": F.when(of_level("plan"), F.col("prev_plan")).otherwise(F.col("baseline_price")),
    }).drop("p_unit", "p_plan", "prev_plan", "p_apt", "p_area")


def crossed_target() -> Column:
    """Below the target now, and not below it before (or no earlier price)."""
    prev = F.col("previous_price")
    return F.coalesce(
        (F.col("latest_price") < F.col("target_price")) & (prev.isNull() | (prev >= F.col("target_price"))), F.lit(False)
    )


def cumulative_drop() -> Column:
    return F.try_divide(F.col("baseline_price") - F.col("latest_price"), F.col("baseline_price")) * 100


def dropped_enough() -> Column:
    return F.coalesce(cumulative_drop() >= F.col("price_drop_pct"), F.lit(False))


def usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(c, 0), 0))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def trigger(priced: DataFrame) -> DataFrame:
    """Adds ``triggered``, ``trigger_type`` and ``reason``; the target rule is looked at first."""
    target, pct = crossed_target(), dropped_enough()
    on_date = F.coalesce(F.concat(F.lit(" ("), short_date(F.col("baseline_recorded_at")), F.lit(")")), F.lit(""))
    reason = F.when(
        target, F.concat(F.lit("price "), usd(F.col("latest_price")), F.lit(" dropped below target "), usd(F.col("target_price")))
    ).when(
        pct, F.concat(F.lit("price dropped "), one_decimal(cumulative_drop()), F.lit("% — was "),
                      usd(F.col("baseline_price")), F.lit(" when you subscribed"), on_date, F.lit(", now "), usd(F.col("latest_price"))),
    ).otherwise("")
    known = F.col("latest_price").isNotNull()
    return priced.withColumns({
        "triggered": known & (target | pct),
        "trigger_type": F.when(known & target, "target_price").when(known & pct, "price_drop_pct"),
        "reason": F.when(known, reason).otherwise(""),
    })


def debounced(as_of) -> Column:
    """Notified less than a day ago; a time without zone is read as UTC."""
    last = F.col("last_notified_at")
    return F.coalesce(last > before(as_of, hours=DEBOUNCE_HOURS), F.lit(False))


def evaluate(rules, units, plans, apartments, history, as_of) -> DataFrame:
    """All active rules in one pass, with ``fired`` telling which notify now."""
    active = rules.where("is_active")
    checked = trigger(rule_prices(active, units, plans, apartments, history))
    return checked.withColumn("debounced", debounced(as_of)).withColumn("fired", F.col("triggered") & ~F.col("debounced"))


def advance(rules: DataFrame, evaluated: DataFrame, as_of) -> DataFrame:
    """Rule state after a run: fired rules pause, are stamped and counted."""
    fired = evaluated.where("fired").select("id", F.lit(True).alias("_f"))
    joined = rules.join(fired, "id", "left")
    hit = F.coalesce("_f", F.lit(False))
    return joined.withColumns({
        "is_active": F.col("is_active") & ~hit,
        "last_notified_at": F.when(hit, instant(as_of)).otherwise(F.col("last_notified_at")),
        "trigger_count": F.when(hit, F.coalesce("trigger_count", F.lit(0)) + 1).otherwise(F.col("trigger_count")),
    }).drop("_f")


def fan_out(evaluated: DataFrame) -> DataFrame:
    """One event per enabled channel of each fired rule."""
    channels = F.array_compact(F.array(
        F.when(F.col("notify_email"), F.lit("email")),
        F.when(F.col("notify_telegram") & (F.coalesce("telegram_chat_id", F.lit("")) != ""), F.lit("telegram")),
    ))
    return evaluated.where("fired").select(
        F.col("id").alias("subscription_id"), "user_id", F.explode(channels).alias("channel"), "trigger_type",
        F.col("latest_price").alias("trigger_price"), "baseline_price", "reason",
    )


def disable_blocked(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Chat is switched off for rules with an event the recipient refused for good."""
    blocked = events.where((F.col("channel") == "telegram") & F.col("blocked")).select(
        F.col("subscription_id").alias("id"), F.lit(True).alias("_b")
    ).distinct()
    return rules.join(blocked, "id", "left").withColumn(
        "notify_telegram", F.col("notify_telegram") & F.col("_b").isNull()
    ).drop("_b")


def targets(rules: DataFrame, units: DataFrame, plans: DataFrame, apartments: DataFrame) -> DataFrame:
    """Unit, plan and apartment behind each rule: unit first, then the rule's apartment, then its plan's."""
    u = units.select(F.col("id").alias("unit_id"), "unit_number", F.col("plan_id").alias("u_plan"))
    p = plans.select(
        F.col("id").alias("eff_plan_id"), F.col("apartment_id").alias("p_apartment"), F.col("name").alias("plan_name"),
        "bedrooms", "bathrooms", "area_sqft",
    )
    a = apartments.select(F.col("id").alias("eff_apartment_id"), "title", F.col("city").alias("a_city"), "state", "source_url")
    by_unit = F.col("unit_id").isNotNull()
    with_unit = lookup(rules, u, "unit_id").withColumn("eff_plan_id", F.when(by_unit, F.col("u_plan")).otherwise(F.col("plan_id")))
    with_plan = lookup(with_unit, p, "eff_plan_id").withColumn(
        "eff_apartment_id", F.when(by_unit, F.col("p_apartment")).otherwise(F.coalesce("apartment_id", "p_apartment"))
    )
    return lookup(with_plan, a, "eff_apartment_id").drop("u_plan", "p_apartment")


def context(evaluated: DataFrame, units, plans, apartments, history, as_of, base_url: str = "https://app.example.com") -> DataFrame:
    """Everything a message shows: titles, spec, place, drop from the baseline and the 30-day low."""
    known = targets(evaluated, units, plans, apartments)
    low_plan = thirty_day_low(history, plans, as_of, "plan").withColumnsRenamed({"low": "low_plan"})
    low_apt = thirty_day_low(history, plans, as_of, "apartment").withColumnsRenamed({"low": "low_apt"})
    lows = lookup(lookup(known, low_plan, "plan_id"), low_apt, "apartment_id")
    unit_rule = F.col("unit_id").isNotNull()
    return lows.withColumns({
        "apartment_title": F.coalesce("title", F.lit("your tracked property")),
        "drop_pct": F.when(F.col("baseline_price") != 0, cumulative_drop()),
        "was_date": short_date(F.col("baseline_recorded_at")),
        "plan_spec": T.plan_spec(F.col("bedrooms"), F.col("bathrooms"), F.col("area_sqft")),
        "city_state": F.when((F.col("a_city") != "") & (F.col("state") != ""), F.concat_ws(", ", "a_city", "state")),
        "url_internal": F.concat(F.lit(f"{base_url}/apartments/"), F.col("eff_apartment_id")),
        "url_external": F.nullif("source_url", F.lit("")),
        "thirty_day_low": F.when(unit_rule, None).when(F.col("plan_id").isNotNull(), F.col("low_plan")).otherwise(F.col("low_apt")),
    }).drop("low_plan", "low_apt", "title")


def enriched_rules(rules: DataFrame, plans: DataFrame, apartments: DataFrame, history: DataFrame) -> DataFrame:
    """Rules with their apartment, plan and latest price for display."""
    p = plans.select(F.col("id").alias("plan_id"), F.col("apartment_id").alias("p_apartment"), F.col("name").alias("plan_name"),
                     T.plan_spec_short(F.col("bedrooms"), F.col("bathrooms"), F.col("area_sqft")).alias("plan_spec"))
    a = apartments.select(F.col("id").alias("eff_apartment_id"), F.col("title").alias("apartment_title"), F.col("city").alias("apartment_city"))
    latest = last_two(history).select("plan_id", F.col("price").alias("by_plan"))
    cheapest = min_price_by_apartment(plans).withColumnRenamed("min_price", "by_apartment")
    with_plan = lookup(rules, p, "plan_id").withColumn("eff_apartment_id", F.coalesce("apartment_id", "p_apartment"))
    return (
        lookup(lookup(lookup(with_plan, a, "eff_apartment_id"), latest, "plan_id"), cheapest, "apartment_id")
        .withColumn("latest_price", F.when(F.col("plan_id").isNotNull(), F.col("by_plan")).otherwise(F.col("by_apartment")))
        .drop("p_apartment", "by_plan", "by_apartment")
    )


def infer_baseline(rules: DataFrame, units, plans, apartments, history) -> DataFrame:
    """(id, baseline): unit price, newest history else plan price, cheapest price, or area average."""
    tagged = rules.withColumn("level", level())
    u = units.where("is_available").select(F.col("id").alias("unit_id"), F.col("price").alias("p_unit"))
    h = last_two(history).select("plan_id", F.col("price").alias("p_hist"))
    p = plans.select(F.col("id").alias("plan_id"), F.col("price").alias("p_plan"))
    a = min_price_by_apartment(plans).withColumnRenamed("min_price", "p_apt")
    area = area_prices(tagged.where(F.col("level") == "area"), plans, apartments, True).select("id", F.col("price").alias("p_area"))
    by_plan = lookup(lookup(tagged, u, "unit_id"), h.join(p, "plan_id", "full_outer"), "plan_id")
    joined = lookup(by_plan, a, "apartment_id").join(area, "id", "left")
    of = lambda name: F.col("level") == name
    return joined.select(
        "id", "level",
        F.when(of("unit"), F.col("p_unit")).when(of("plan"), F.coalesce("p_hist", "p_plan"))
        .when(of("apartment"), F.col("p_apt")).otherwise(F.col("p_area")).alias("baseline"),
    )


def refresh_rearmed(rules: DataFrame, previously_active: DataFrame, units, plans, apartments, history, as_of) -> DataFrame:
    """Rules switched on again start from today's price; their debounce is cleared."""
    was = previously_active.select("id", F.col("is_active").alias("_was"))
    priced = rule_prices(rules, units, plans, apartments, history).select("id", F.col("latest_price").alias("_now"))
    joined = rules.join(was, "id").join(priced, "id", "left")
    rearmed = F.col("is_active") & ~F.col("_was")
    moved = rearmed & F.col("_now").isNotNull()
    return joined.withColumns({
        "baseline_price": F.when(moved, F.col("_now")).otherwise(F.col("baseline_price")),
        "baseline_recorded_at": F.when(moved, instant(as_of)).otherwise(F.col("baseline_recorded_at")),
        "last_notified_at": F.when(~rearmed, F.col("last_notified_at")),
    }).drop("_was", "_now")
