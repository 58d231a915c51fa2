"""Readers for tables, JSON documents and raw pages, all with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.operators.scale import before
from rentscope.schemas import DISCOVERY, PLACE, PLACE_PAYLOAD, SEED, STEP_CACHE, TABLES, WEBHOOK_EVENT
from rentscope.sources.buckets import committed


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_table_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """The same table from a database, read in ``parts`` ranges of its key; the driver must be on the class path."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options
    )
    return reader.load().to(spark.createDataFrame([], TABLES[name]).schema)


def place_map(documents: DataFrame, json: str) -> DataFrame:
    """JSON objects keyed by place id as rows; places without a web address are left out."""
    entries = F.from_json(json, f"map<string,{PLACE}>")
    rows = documents.select(F.explode(entries).alias("place_id", "p")).select("place_id", "p.*")
    return rows.where(F.col("source_url").startswith("http"))


def read_place_map(spark: SparkSession, path: str) -> DataFrame:
    return place_map(spark.read.text(path, wholetext=True), "value")


def seed_list(entries: DataFrame, name_contains: str | None = None) -> DataFrame:
    if not name_contains:
        return entries
    return entries.where(F.lower("name").contains(name_contains.lower()))


def read_seed_list(spark: SparkSession, path: str, name_contains: str | None = None) -> DataFrame:
    return seed_list(spark.read.schema(SEED).option("multiLine", True).json(path), name_contains)


def discovery(documents: DataFrame, json: str) -> DataFrame:
    """Listings of wrapped documents {total, city_counts, apartments[]}."""
    return documents.select(F.explode(F.from_json(json, DISCOVERY)["apartments"]).alias("a")).select("a.*")


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    return discovery(spark.read.text(path, wholetext=True), "value")


def fresh_steps(entries: DataFrame, as_of, ttl_days: int = 30) -> DataFrame:
    """Cached step lists not older than the limit; an entry without a time counts as from the year 2000."""
    when = F.coalesce(F.col("last_success").try_cast("timestamp"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return entries.where(when.cast("timestamp_ntz") >= before(as_of, days=ttl_days))


def read_step_cache(spark: SparkSession, path: str, as_of, ttl_days: int = 30) -> DataFrame:
    return fresh_steps(spark.read.schema(STEP_CACHE).option("multiLine", True).json(path), as_of, ttl_days)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw text files, one page each, with the file they came from."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def webhook_batch(requests: DataFrame, json: str, order: str) -> DataFrame:
    """Events of JSON arrays in arrival order (request, place in the array)."""
    events = F.from_json(json, f"array<{WEBHOOK_EVENT}>")
    return requests.select(F.col(order).alias("request"), F.posexplode(events).alias("place", "e")).select("request", "place", "e.*")


def read_webhook_stream(spark: SparkSession, path: str) -> DataFrame:
    """Arriving files, each a JSON array of provider events."""
    files = spark.readStream.text(path, wholetext=True)
    return webhook_batch(files.withColumn("arrived", F.col("_metadata.file_modification_time")), "value", "arrived")


def place_rows(documents: DataFrame, json: str) -> DataFrame:
    """Raw place payloads as listing rows: title falls back to the address, ids carry a prefix."""
    from rentscope.functions.labels import split_address

    p = documents.withColumn("p", F.from_json(json, PLACE_PAYLOAD))
    address = F.coalesce("p.formattedAddress", F.lit(""))
    parts = split_address(address)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    name: Column = F.coalesce(text("p.displayName.text"), text("p.name"))
    return p.select(
        F.concat(F.lit("google_"), "p.name").alias("external_id"), F.coalesce("p.name", F.lit("")).alias("place_resource_name"),
        F.coalesce(name, address).alias("title"), F.coalesce(name, F.lit("")).alias("business_name"),
        F.concat(F.lit("Apartment complex located in "), parts["city"], F.lit(", "), parts["state"]).alias("description"),
        address.alias("address"), *[c.alias(n) for n, c in parts.items()], F.col("p.location.latitude").alias("latitude"),
        F.col("p.location.longitude").alias("longitude"), F.lit("apartment").alias("property_type"),
        F.coalesce("p.websiteUri", F.lit("")).alias("source_url"), F.coalesce("p.nationalPhoneNumber", F.lit("")).alias("phone"),
        F.col("p.rating").alias("rating"), F.col("p.userRatingCount").alias("user_rating_count"),
    )


def raw_place_rows(documents: DataFrame, json: str) -> DataFrame:
    """Payloads kept whole beside the columns often asked for."""
    p = documents.withColumn("p", F.from_json(json, PLACE_PAYLOAD))
    return p.where(F.coalesce("p.name", F.lit("")) != "").select(
        F.col("p.name").alias("place_resource_name"), F.element_at(F.split("p.name", "/"), -1).alias("place_id"),
        F.col("p.displayName.text").alias("display_name"), F.col("p.formattedAddress").alias("formatted_address"),
        F.col("p.websiteUri").alias("website_uri"), F.col("p.nationalPhoneNumber").alias("national_phone_number"),
        F.col("p.rating").alias("rating"), F.col("p.userRatingCount").alias("user_rating_count"),
        F.col("p.location.latitude").alias("latitude"), F.col("p.location.longitude").alias("longitude"), F.col(json).alias("raw_json"),
    )


def read_fact(spark: SparkSession, path: str, schema: str, runs: Iterable[int] | None = None) -> DataFrame:
    """Rows that finished runs appended to a fact, with their ``run``; of the given runs only, if any are."""
    done = [r for r in committed(spark, path, "run") if runs is None or r in set(runs)]
    if not done:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("long"))
    rows = spark.read.schema(f"{schema}, run long").option("basePath", path)
    return rows.parquet(*[f"{path}/run={r}" for r in done])
