"""Which listings a refresh may visit, and what a finished visit counts as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import urls as U
from rentscope.operators.scale import instant

# Hosts never visited.
BANNED_HOSTS = (
    "craigslist.org", "www.craigslist.org", "zillow.com", "www.zillow.com", "apartments.com", "www.apartments.com",
    "realtor.com", "www.realtor.com",
)


def banned(url: Column) -> Column:
    return U.authority(url).isin(*BANNED_HOSTS)


def gate(candidates: DataFrame, registry: DataFrame, suppression: DataFrame, as_of) -> DataFrame:
    """Ordered decision per candidate, and the address to visit when it may go."""
    r = registry.where("is_active").select(
        "domain", "robots_txt_allows", F.col("data_source_type").alias("site_type"), "corporate_parent_url", F.lit(True).alias("_r")
    )
    s = suppression.where(F.col("retry_after") > instant(as_of)).select(F.col("url").alias("source_url"), F.lit(True).alias("_s"))
    joined = candidates.withColumn("domain", U.authority(F.col("source_url"))).join(r, "domain", "left").join(s, "source_url", "left")
    decision = (
        F.when(F.col("_r").isNull(), "unregistered")
        .when(~F.col("robots_txt_allows"), "robots_denied")
        .when(F.col("site_type") == "unscrapeable", "skipped_unscrapeable")
        .when(F.col("_s"), "skipped_negative_cache")
        .otherwise("go")
    )
    target = F.coalesce(F.nullif("corporate_parent_url", F.lit("")), F.col("source_url"))
    return joined.withColumn("decision", decision).withColumn("visit_url", F.when(F.col("decision") == "go", target)).drop(
        "_r", "_s", "robots_txt_allows", "site_type", "corporate_parent_url"
    )


def classify_outcome(unchanged: Column, failed: Column, plan_count: Column, reported: Column) -> Column:
    """Outcome of a finished visit: unchanged page, crash, plans found (by which path) or none."""
    kept = ("platform_direct", "platform_direct_static", "platform_direct_rendered", "cache_hit")
    return (
        F.when(unchanged, "content_unchanged").when(failed, "hard_fail")
        .when(plan_count > 0, F.when(reported.isin(*kept), reported).otherwise("success"))
        .otherwise("validated_fail")
    )
