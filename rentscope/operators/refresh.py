"""The snapshot merge over stored tables: what a snapshot touches is read, merged and written, nothing else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.operators import matching as M
from rentscope.operators.merge import apply_snapshot
from rentscope.operators.scale import cut_lineage, lookup
from rentscope.sources.buckets import BucketTable, highest
from rentscope.sources.writers import append_fact


@dataclass(frozen=True)
class Store:
    """Listings, plans, units and rules in buckets of their listing, and the facts that runs append."""

    listings: BucketTable
    plans: BucketTable
    units: BucketTable
    rules: BucketTable
    facts: str


def new_store(
    path: str, apartments: DataFrame, plans: DataFrame, units: DataFrame, rules: DataFrame, buckets: int = 1024
) -> Store:
    """Write the tables as run 0.  Units and rules get their ``listing``; rules on an area, and what has no known plan, have none."""
    listed = lambda df, key: with_listing(df, plans, key)
    tables = {
        "listings": (apartments, "id"), "plans": (plans, "apartment_id"), "units": (listed(units, "plan_id"), "listing"),
        "rules": (rules_with_listing(rules, units, plans), "listing"),
    }
    made = {}
    for name, (rows, key) in tables.items():
        stats = {} if name == "rules" else {"top": F.max("id")}
        made[name] = BucketTable(f"{path}/{name}", key, rows.schema, buckets, stats)
        made[name].replace(rows, 0)
    return Store(**made, facts=f"{path}/facts")


def with_listing(rows: DataFrame, plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """Rows with the listing of their plan."""
    side = plans.select(F.col("id").alias(key), F.col("apartment_id").alias("listing"))
    return lookup(rows, side, key).select(*rows.columns, "listing")


def rules_with_listing(rules: DataFrame, units: DataFrame, plans: DataFrame) -> DataFrame:
    """Rules with the listing they watch: that of their unit, else their plan, else their own; none for an area."""
    of_unit = units.select(F.col("id").alias("unit_id"), F.col("plan_id").alias("_plan"))
    watched = lookup(rules, of_unit, "unit_id").withColumn("_plan", F.when(F.col("unit_id").isNotNull(), F.col("_plan")).otherwise(F.col("plan_id")))
    named = with_listing(watched, plans, "_plan")
    own = F.when(F.col("unit_id").isNull() & F.col("plan_id").isNull(), F.col("apartment_id")).otherwise(F.col("listing"))
    return named.withColumn("listing", own).select(*rules.columns, "listing")


def refresh(
    spark: SparkSession, store: Store, snapshot: DataFrame, as_of, run: int, hosts=M.RENAMING_HOSTS, scraped: DataFrame | None = None
) -> dict[str, set[int]]:
    """Apply a snapshot as run ``run`` (1, 2, ...) and return the buckets written of each table.

    Each table's buckets that hold a listing of the snapshot (or of ``scraped``) are read as they were before the run, merged and written anew; new ids
    follow the greatest one of the whole table, which manifests know.  History rows and notices are facts of the run.  A run that is
    repeated writes the same rows to the same folders.  A snapshot without rows writes no bucket.
    """
    snapshot = cut_lineage(snapshot)
    keys = snapshot.select(F.col("apartment_id").alias("listing"))
    if scraped is not None:
        keys = keys.unionByName(scraped.select(F.col("id").alias("listing")))
    keys = cut_lineage(keys.distinct())
    parts = {n: getattr(store, n) for n in ("listings", "plans", "units", "rules")}
    touched = {n: t.touched(keys, "listing") for n, t in parts.items()}
    old = {n: t.read(spark, touched[n], before=run) for n, t in parts.items()}
    tops = {
        n: spark.createDataFrame([(highest(parts[n].manifest(spark, run), "top"),)], "id long") for n in ("plans", "units")
    }
    out = apply_snapshot(
        old["listings"], old["plans"], old["units"].drop("listing"), old["rules"].drop("listing"), snapshot, as_of, hosts, scraped, tops
    )
    plans = cut_lineage(out["plans"])
    rules = old["rules"].drop("is_active").join(out["rules"].select("id", "is_active"), "id")
    append_fact(out["history"], f"{store.facts}/history", {}, run=run)
    append_fact(out["notices"], f"{store.facts}/notices", {}, run=run)
    after = {"listings": out["apartments"], "plans": plans, "units": with_listing(out["units"], plans), "rules": rules}
    for name, rows in after.items():
        parts[name].replace(rows, run, touched[name])
    return touched
