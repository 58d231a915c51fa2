"""The daily refresh as one job over all listings: gate, change test, extraction, merge, run log and suppression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.functions import pagetext as X
from rentscope.operators import backoff
from rentscope.operators import gating as G
from rentscope.operators import history as H
from rentscope.operators import matching as M
from rentscope.operators import merge
from rentscope.operators import pages as E
from rentscope.operators.scale import cut_lineage, instant
from rentscope.sources.writers import RUN_DEFAULTS, with_defaults

# Fixed value: how a visit that reads a page without a browser reports itself.
READ_DIRECTLY = "platform_direct_static"


def due(listings: DataFrame) -> DataFrame:
    """Listings that a refresh looks at: with an address, available, and of a site of their own."""
    return listings.where(F.col("source_url").isNotNull() & F.col("is_available") & (F.col("data_source_type") == "brand_site"))


@dataclass(frozen=True)
class Visits:
    """What a day's visits found, before anything is merged.

    ``read`` has one row per visited listing: the address read (its own, or that of its site's parent where that has a page), the page, the digest
    of a page read where it was looked for, and whether the digest is the stored one.  ``snapshot`` has the plans of the changed pages.
    ``runs`` is the run log: a row for each visit and each listing skipped as unscrapeable or suppressed.
    """

    read: DataFrame
    snapshot: DataFrame
    runs: DataFrame


def visit(
    listings: DataFrame, registry: DataFrame, suppression: DataFrame, pages: DataFrame, as_of, extractors: Sequence[E.Extractor] | None = None
) -> Visits:
    """Gate the listings, look up their pages (url, html; a page without html could not be fetched), and extract the changed ones.

    Listings of unregistered sites and of those that forbid robots leave no trace.  Where the page of a site's parent is missing, the listing's own is
    read instead, without a digest.  A visit without any page fails hard; one that finds no plan fails validation.
    """
    gated = G.gate(due(listings), registry, suppression, as_of)
    hints = registry.where("is_active").select("domain", F.col("last_successful_adapter").alias("hint"))
    go = gated.where("decision = 'go'").join(hints, "domain", "left").select("id", "source_url", "visit_url", "last_content_hash", "hint")
    html = pages.where(F.col("html").isNotNull()).select("url", "html")
    there = go.join(html.withColumnRenamed("html", "there"), F.col("visit_url") == F.col("url"), "left").drop("url")
    lost = F.col("there").isNull() & (F.col("visit_url") != F.col("source_url"))
    both = there.withColumn("_own", F.when(lost, F.col("source_url"))).join(html, F.col("_own") == F.col("url"), "left").drop("url", "_own")
    digest = F.when(F.col("there").isNotNull(), X.content_hash(F.col("there")))
    read = cut_lineage(both.select(
        "id", "source_url", F.when(lost, F.col("source_url")).otherwise(F.col("visit_url")).alias("read_url"), F.coalesce("there", "html").alias("html"),
        "hint", digest.alias("new_hash"), F.coalesce(F.col("last_content_hash") == digest, F.lit(False)).alias("unchanged"),
    ))

    changed = read.where(~F.col("unchanged") & F.col("html").isNotNull())
    units = cut_lineage(E.extract_all(changed.select(F.col("id").alias("page_id"), F.col("read_url").alias("url"), "html", "hint"), extractors, "hint"))
    found = units.groupBy("page_id").agg(F.first("platform").alias("adapter_name"), F.count(F.lit(1)).alias("n"))
    extra = units.select("page_id", "pos", "floor_level", F.col("platform").alias("adapter_name"))
    snapshot = E.typed_plans(units).join(extra, ["page_id", "pos"]).withColumnRenamed("page_id", "apartment_id").withColumns(
        {"external_url": F.lit(None).cast("string"), "facing": F.lit(None).cast("string")}
    )

    outcome = G.classify_outcome(F.col("unchanged"), F.col("html").isNull(), F.coalesce("n", F.lit(0)), F.lit(READ_DIRECTLY))
    visited = read.join(found, F.col("id") == F.col("page_id"), "left").select(
        "id", F.col("source_url").alias("url"), F.when(F.col("read_url") != F.col("source_url"), F.col("read_url")).alias("effective_url"),
        outcome.alias("outcome"), F.col("unchanged").alias("content_hash_short_circuit"), "adapter_name",
    )
    skipped = gated.where(F.col("decision").startswith("skipped_")).select("id", F.col("source_url").alias("url"), F.col("decision").alias("outcome"))
    logged = visited.unionByName(skipped, allowMissingColumns=True).withColumnRenamed("id", "apartment_id").withColumn("run_at", instant(as_of))
    return Visits(read, cut_lineage(snapshot), cut_lineage(with_defaults(logged, RUN_DEFAULTS)))


def suppression_after(suppression: DataFrame, runs: DataFrame) -> DataFrame:
    """Success clears an address, failure suppresses it, longer each time."""
    return backoff.merge(suppression, runs.select("url", "run_at", "outcome", F.col("apartment_id").alias("id")))


def listings_after(listings: DataFrame, visits: Visits, as_of) -> DataFrame:
    """Listings whose page is unchanged, or was read where it was looked for and had plans, know its digest and when they were read."""
    done = visits.runs.where(F.col("outcome").isin("content_unchanged", READ_DIRECTLY)).select(F.col("apartment_id").alias("id"))
    fresh = visits.read.where(F.col("new_hash").isNotNull()).join(done, "id", "left_semi").select("id", "new_hash")
    joined = listings.join(fresh, "id", "left")
    hit = F.col("new_hash").isNotNull()
    return joined.withColumns({
        "last_content_hash": F.coalesce("new_hash", "last_content_hash"),
        "last_scraped_at": F.when(hit, instant(as_of)).otherwise(F.col("last_scraped_at")),
    }).select(*listings.columns)


def daily_refresh(
    listings: DataFrame, registry: DataFrame, suppression: DataFrame, pages: DataFrame, plans: DataFrame, units: DataFrame, rules: DataFrame,
    history: DataFrame, as_of, hosts=M.RENAMING_HOSTS, extractors: Sequence[E.Extractor] | None = None,
) -> dict[str, DataFrame]:
    """All tables after a day: listings, plans, units, rules, registry and suppression as they are then, and the day's runs, history rows and notices.

    Unchanged listings repeat the newest price of each of their plans; the plans of changed ones go through the snapshot merge.
    """
    seen = visit(listings, registry, suppression, pages, as_of, extractors)
    same = seen.read.where("unchanged").select(F.col("id").alias("apartment_id"))
    still = plans.join(same, "apartment_id", "left_semi").select(F.col("id").alias("plan_id"))
    carried, synced = H.carry_forward(history.join(still, "plan_id", "left_semi"), plans, as_of)
    known = cut_lineage(listings_after(listings, seen, as_of))
    merged = merge.apply_snapshot(known, cut_lineage(synced), units, rules, seen.snapshot, as_of, hosts)
    runs = seen.runs.withColumn("id", F.col("apartment_id"))
    return {
        **merged, "history": merged["history"].unionByName(carried), "runs": seen.runs, "suppression": suppression_after(suppression, seen.runs),
        "registry": merge.update_hints(registry, runs),
    }
