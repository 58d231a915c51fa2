"""Sinks: append-only facts, JSON lines, summary documents and nested listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.operators.scale import instant

# Defaults of the run log and the cost log.
RUN_DEFAULTS = {
    "path_cache_hit": False, "content_hash_short_circuit": False, "input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0, "elapsed_sec": 0.0,
}
COST_DEFAULTS = {"input_tok": 0, "output_tok": 0, "api_calls": 0, "cache_hits": 0, "cost_usd": 0.0}


def jsonl_rows(rows: DataFrame, as_of) -> DataFrame:
    """Log lines with their time and the token total."""
    tokens = F.coalesce("input_tok", F.lit(0)) + F.coalesce("output_tok", F.lit(0))
    return rows.withColumns({"ts": instant(as_of), "total_tok": tokens})


def append_jsonl(rows: DataFrame, path: str, as_of) -> None:
    jsonl_rows(rows, as_of).write.mode("append").json(path)


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    return rows.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()
    })


def append_fact(rows: DataFrame, path: str, defaults: dict, partition_by: str | None = None, run: int | None = None) -> None:
    """Append rows with defaulted columns.  Rows of a numbered ``run`` have a folder of their own, ``run=N``: a job that is repeated
    replaces what it wrote, and ``readers.read_fact`` takes a run's rows once its writer has finished."""
    writer = with_defaults(rows, defaults).write.mode("append" if run is None else "overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path if run is None else f"{path}/run={run}")


def summary_totals(found: DataFrame, cost_per_city: float) -> DataFrame:
    """One row: listings, cost and a city to count map.  Only counts per city travel to it."""
    cities = found.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("city", "n"))))
    return cities.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.round(F.count(F.lit(1)) * cost_per_city, 4).alias("cost_usd"),
        counts.alias("city_counts"),
    )


def write_document(found: DataFrame, path: str, cost_per_city: float) -> None:
    """The totals as one JSON document; the listings beside it as JSON lines, one per listing.

    The listings are not nested into the document, since that would put all of them into one row.
    """
    summary_totals(found, cost_per_city).write.mode("overwrite").json(f"{path}/summary")
    found.write.mode("overwrite").json(f"{path}/apartments")


def nested_listing(apartments: DataFrame, plans: DataFrame, units: DataFrame, history: DataFrame) -> DataFrame:
    """Listing documents as rows of one shape whatever their size: a header row of each listing, then one row for each active plan, for
    each of its units and for each of its history points.

    ``kind`` tells them apart; ``plan_id`` and ``item`` (unit id or history sequence) name the place in the document.  Nothing is gathered.
    """
    live = plans.where("is_available").select("apartment_id", F.col("id").alias("plan_id"), "name", "price")
    of = live.join(apartments.select(F.col("id").alias("apartment_id")), "apartment_id", "left_semi")
    parents = of.select("apartment_id", "plan_id")
    headers = apartments.select(F.col("id").alias("apartment_id"), F.lit("listing").alias("kind"), "title", "city")
    unit_rows = units.select("plan_id", F.col("id").alias("item"), "unit_number", "price").join(parents, "plan_id")
    point_rows = history.select("plan_id", F.col("seq").alias("item"), "line", "price", "recorded_at").join(parents, "plan_id")
    parts = [headers, of.withColumn("kind", F.lit("plan")), unit_rows.withColumn("kind", F.lit("unit")), point_rows.withColumn("kind", F.lit("point"))]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select("apartment_id", "kind", "plan_id", "item", "line", "title", "city", "name", "unit_number", "price", "recorded_at")


def write_nested(rows: DataFrame, path: str) -> None:
    """The rows of ``nested_listing`` as JSON lines; what a kind doesn't have is left out of its lines."""
    rows.write.mode("overwrite").json(path)
