"""Run, cost and notification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.functions import urls as U
from rentscope.operators.scale import (
    before, count_if, exact_avg, exact_quantile, exact_sum, newest, order_statistics,
)

# Statuses of a notification, in funnel order.
STATUSES = ("sent", "failed", "delivered", "opened", "clicked", "bounced", "unsubscribed")
# Outcomes that delivered data, for the per-apartment report.
DELIVERED = ("success", "cache_hit", "platform_direct", "platform_direct_static", "platform_direct_rendered", "content_unchanged")
FAILED = ("validated_fail", "hard_fail", "skipped_negative_cache")


def cost_percentiles(runs: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of positive costs: element floor(n*q) of the sorted list; one row, 0 when empty."""
    positive = runs.where(F.col("cost_usd") > 0)
    stats = order_statistics(
        positive, [], "cost_usd", {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * F.lit(0.95))}
    )
    return stats.agg(F.coalesce(F.max("p50"), F.lit(0.0)).alias("p50"), F.coalesce(F.max("p95"), F.lit(0.0)).alias("p95"))


def failures_by_domain(runs: DataFrame, limit: int | None = None) -> DataFrame:
    failed = runs.where(F.col("outcome").isin("hard_fail", "validated_fail"))
    ranked = failed.groupBy(U.authority(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain")
    return ranked if limit is None else ranked.limit(limit)


def run_stats(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """One row: total, outcomes as text, cache-hit and short-circuit share, total cost; zeros when empty."""
    recent = runs.where(F.col("run_at") >= before(as_of, days=days))
    per = recent.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cost_usd").cast("decimal(18,8)")).alias("c"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    share = lambda name: F.coalesce(
        F.round(F.try_divide(F.sum(F.when(F.col("outcome") == name, F.col("n")).otherwise(0)) * 100.0, F.sum("n")), 1), F.lit(0.0)
    )
    counts = F.transform(
        F.array_sort(F.collect_list(F.struct("outcome", "n"))), lambda x: F.concat(x["outcome"], F.lit(":"), x["n"])
    )
    return per.agg(
        total.alias("total_scrapes"), F.array_join(counts, " ").alias("by_outcome"), share("cache_hit").alias("cache_hit_pct"),
        share("content_unchanged").alias("short_circuit_pct"),
        F.round(F.coalesce(F.sum("c").cast("double"), F.lit(0.0)), 4).alias("total_cost_usd"),
    )


def outcome_map(runs: DataFrame) -> DataFrame:
    """Outcome counts as one map column."""
    per = runs.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("by_outcome"))


def daily_digest(runs: DataFrame, as_of) -> DataFrame:
    """Last 24 hours: total, four bucketed counts with whole percents, positive cost and its percentiles."""
    recent = runs.where(F.col("run_at") >= before(as_of, hours=24))
    o = F.col("outcome")
    buckets = {
        "success": o.isin("success", "platform_direct_static", "platform_direct_rendered"),
        "unchanged": o == "content_unchanged", "skipped": o.isin("skipped_negative_cache", "cache_hit"),
        "failed": o.isin("hard_fail", "validated_fail"),
    }
    n = F.count(F.lit(1))
    columns = [n.alias("total")]
    for name, cond in buckets.items():
        columns += [count_if(cond).alias(f"n_{name}"),
                    F.coalesce(F.floor(F.try_divide(F.count_if(cond) * 100, n)), F.lit(0)).alias(f"pct_{name}")]
    cost = F.coalesce(exact_sum(F.when(F.col("cost_usd") > 0, F.col("cost_usd"))), F.lit(0.0))
    head = recent.agg(*columns, F.round(cost, 2).alias("total_cost"))
    # Two one-row tables side by side.
    one = F.lit(1).alias("_one")
    return head.select("*", one).join(cost_percentiles(recent).select("*", one), "_one").drop("_one")


def run_outcomes(runs: DataFrame, as_of, days: int) -> DataFrame:
    recent = runs.where(F.col("run_at") > before(as_of, days=days))
    return recent.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("runs"), F.round(exact_avg("cost_usd"), 4).alias("avg_cost_usd"),
        F.round(exact_avg("elapsed_sec"), 1).alias("avg_elapsed_sec"),
    ).orderBy(F.desc("runs"), "outcome")


def runs_by_adapter(runs: DataFrame, as_of, days: int) -> DataFrame:
    recent = runs.where((F.col("run_at") > before(as_of, days=days)) & F.col("outcome").isin(*P.DIRECT_OUTCOMES))
    return recent.groupBy(F.coalesce("adapter_name", F.lit("(unknown)")).alias("adapter")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(exact_avg("elapsed_sec"), 1).alias("avg_elapsed_sec")
    ).orderBy(F.desc("runs"), "adapter")


def notification_counts(events: DataFrame, as_of, days: int) -> DataFrame:
    recent = events.where(F.col("sent_at") > before(as_of, days=days))
    return recent.groupBy("channel", "status").agg(F.count(F.lit(1)).alias("events")).orderBy("channel", F.desc("events"), "status")


def notification_funnel(events: DataFrame, as_of, days: int) -> DataFrame:
    """Status counts per channel with delivery, open, click and bounce rates."""
    recent = events.where(F.col("sent_at") >= before(as_of, days=days))
    wide = recent.groupBy("channel").pivot("status", list(STATUSES)).count().fillna(0, list(STATUSES))
    attempted = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    opened = F.col("opened") + F.col("clicked")
    delivered = F.col("delivered") + opened + F.col("unsubscribed")
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return wide.select(
        "channel", *STATUSES, rate(delivered, attempted - F.col("failed")).alias("delivery_rate"),
        rate(opened, delivered).alias("open_rate"), rate(F.col("clicked"), opened).alias("click_rate"),
        rate(F.col("bounced"), attempted).alias("bounce_rate"),
    )


def cost_by_source(costs: DataFrame, as_of, days: int) -> DataFrame:
    recent = costs.where(F.col("ts") > before(as_of, days=days))
    return recent.rollup("source").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 4).alias("total_usd")).select(
        F.coalesce("source", F.lit("TOTAL")).alias("source"), "calls", F.col("total_usd").cast("double").alias("total_usd")
    )


def cost_by_day(costs: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return costs.rollup(day.alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), count_if(F.col("source") == "scraper").alias("scraper"),
        count_if(F.col("source") == "google_maps").alias("google_maps"),
        F.sum("cost_usd").cast("double").alias("cost"),
    ).withColumn("day", F.coalesce("day", F.lit("TOTAL")))


def cost_by_source_outcomes(costs: DataFrame) -> DataFrame:
    """Cost and calls per source with outcome counts, plus a TOTAL row without outcomes."""
    per = costs.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("c"))
    entries = F.array_sort(F.collect_list(F.struct("outcome", "n")))
    text = F.array_join(F.transform(entries, lambda x: F.concat(x["outcome"], F.lit(":"), x["n"])), "  ")
    return per.rollup("source").agg(
        F.sum("n").alias("calls"), F.sum("c").cast("double").alias("cost"), F.grouping("source").alias("g"), text.alias("t")
    ).select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "calls", "cost",
        F.when(F.col("g") == 1, "").otherwise(F.col("t")).alias("outcomes"),
    )


def hint_distribution(registry: DataFrame) -> DataFrame:
    hinted = registry.where(F.col("is_active") & F.col("last_successful_adapter").isNotNull())
    return hinted.groupBy(F.col("last_successful_adapter").alias("adapter")).agg(
        F.count(F.lit(1)).alias("n"), F.max("last_adapter_success_at").alias("last_success")
    ).withColumn("polluted", F.col("adapter") == "universal_dom")


def rendered_latency(runs: DataFrame, as_of, days: int = 3) -> DataFrame:
    """Rendered fetches per (outcome, adapter) with at least three runs: mean, interpolated p95, slow flag."""
    recent = runs.where(
        (F.col("run_at") > before(as_of, days=days)) & F.col("outcome").isin("platform_direct_rendered", "not_apartment", "no_data")
    )
    keys = ["outcome", "adapter_name"]
    means = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(exact_avg("elapsed_sec"), 1).alias("avg_s")).where("n >= 3")
    tails = exact_quantile(recent, keys, "elapsed_sec", 0.95, "p").drop("n")
    on = (means["outcome"] == tails["outcome"]) & means["adapter_name"].eqNullSafe(tails["adapter_name"])
    return means.join(tails, on).select(
        means["outcome"], means["adapter_name"], "n", "avg_s", F.round("p", 1).alias("p95_s"), (F.col("avg_s") > 13).alias("slow")
    )


def outcome_shares(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Share of each outcome; the window runs over the grouped rows only."""
    recent = runs.where(F.col("run_at") > before(as_of, hours=hours))
    per = recent.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.round(exact_avg("elapsed_sec"), 1).alias("avg_s"), F.round(exact_avg("cost_usd"), 4).alias("avg_cost")
    )
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def coverage(runs: DataFrame) -> dict[str, DataFrame]:
    """Outcome shares, direct runs per adapter, and zero-cost / paid totals with the estimated saving."""
    per = runs.groupBy("outcome", "adapter_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cost_usd", F.lit(0)).cast("decimal(18,8)")).alias("c")
    )
    everything = Window.partitionBy()
    outcomes = per.groupBy("outcome").agg(F.sum("n").alias("n")).withColumn(
        "pct", F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 1)
    )
    direct = F.col("outcome").isin(*P.DIRECT_OUTCOMES)
    adapters = (
        per.groupBy(F.when(direct, F.coalesce("adapter_name", F.lit("(unknown)"))).alias("adapter")).agg(F.sum("n").alias("runs"))
        .withColumn("_all", F.sum("runs").over(everything))
        .where(F.col("adapter").isNotNull())
        .select("adapter", "runs", F.round(F.col("runs") * 100.0 / F.sum("runs").over(everything), 1).alias("pct_of_direct"),
                F.round(F.col("runs") * 100.0 / F.col("_all"), 1).alias("pct_of_all"))
    )
    paid = F.col("outcome").isin("success", "cache_hit")
    weigh = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    totals = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"), weigh(direct).alias("direct_runs"), weigh(paid).alias("paid_runs"),
        (weigh(F.col("outcome") == "content_unchanged") + weigh(direct)).alias("zero_cost_runs"),
        F.round(F.try_divide(F.sum(F.when(paid, F.col("c"))).cast("double"), weigh(paid)), 6).alias("avg_paid_cost"),
        F.round(F.try_divide(F.sum(F.when(paid, F.col("c"))).cast("double"), weigh(paid)) * weigh(direct), 4).alias("estimated_saving"),
    )
    return {"outcomes": outcomes, "adapters": adapters, "totals": totals}


def newest_run(runs: DataFrame, apartments: DataFrame) -> DataFrame:
    """Newest run of each apartment with its title, cut to 30 characters when longer than 32, and a status."""
    last = newest(runs.where(F.col("apartment_id").isNotNull()), ["apartment_id"], ["run_at", "id"], ["run_at", "outcome", "adapter_name"])
    titles = apartments.select(F.col("id").alias("apartment_id"), "title", "city")
    status = F.when(F.col("outcome").isin(*DELIVERED), "ok").when(F.col("outcome").isin(*FAILED), "failed").otherwise("other")
    return last.join(titles, "apartment_id", "left").select(
        "apartment_id", F.coalesce(short_title(F.col("title")), F.concat(F.lit("[apt "), F.col("apartment_id"), F.lit("]"))).alias("title"), "city", "outcome", "run_at", status.alias("status")
    )


def short_title(title):
    return F.when(F.length(title) > 32, F.concat(F.substring(title, 1, 30), F.lit(".."))).otherwise(title)


def without_run(apartments: DataFrame, runs: DataFrame, as_of, days: int) -> DataFrame:
    seen = runs.where((F.col("run_at") >= before(as_of, days=days)) & F.col("apartment_id").isNotNull()).select(
        F.col("apartment_id").alias("id")
    )
    return apartments.where("is_available").join(seen, "id", "left_anti")
