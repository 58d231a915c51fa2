"""Suppression of addresses that keep failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import predicates as P

# Days of suppression after the first, second and any later failure in a row.
BACKOFF_DAYS = (7, 14, 30)


def retry_after(last_failed: Column, attempts: Column) -> Column:
    days = F.element_at(F.array(*[F.lit(d) for d in BACKOFF_DAYS]), F.least(attempts.cast("int"), F.lit(len(BACKOFF_DAYS))))
    return last_failed + F.make_dt_interval(days=days)


def last_success(log: DataFrame) -> DataFrame:
    ok = log.where(F.col("outcome").isin(*P.SUCCESS_OUTCOMES))
    return ok.groupBy("url").agg(F.max(F.struct("run_at", "id")).alias("_ok"))


def trailing_failures(log: DataFrame) -> DataFrame:
    """Failures of each address after its last success.

    Two aggregations with a join instead of a running window, so a busy address is never gathered.
    """
    failed = log.where(F.col("outcome").isin(*P.FAILURE_OUTCOMES))
    after = failed.join(last_success(log), "url", "left").where(
        F.col("_ok").isNull() | (F.struct("run_at", "id") > F.col("_ok"))
    )
    return after.groupBy("url").agg(
        F.min("run_at").alias("first_failed_at"), F.max("run_at").alias("last_failed_at"),
        F.max_by("outcome", F.struct("run_at", "id")).alias("last_reason"), F.count(F.lit(1)).alias("attempt_count"),
    )


def replay(log: DataFrame) -> DataFrame:
    """Suppression state that follows from a log alone."""
    return trailing_failures(log).withColumn("retry_after", retry_after(F.col("last_failed_at"), F.col("attempt_count")))


def merge(state: DataFrame, log: DataFrame) -> DataFrame:
    """Stored state plus a newer log: success clears, a first failure inserts, further ones lengthen."""
    fresh = trailing_failures(log).select(
        "url", F.col("first_failed_at").alias("_first"), F.col("last_failed_at").alias("_last"),
        F.col("last_reason").alias("_reason"), F.col("attempt_count").alias("_n"),
    )
    cleared = last_success(log).select("url", F.lit(True).alias("_cleared"))
    kept = state.join(cleared, "url", "left_anti")
    both = kept.join(fresh, "url", "full_outer")
    attempts = F.coalesce("attempt_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select(
        "url", F.coalesce("first_failed_at", "_first").alias("first_failed_at"),
        F.coalesce("_last", "last_failed_at").alias("last_failed_at"), F.coalesce("_reason", "last_reason").alias("last_reason"),
        attempts.cast("bigint").alias("attempt_count"),
        F.when(F.col("_n").isNull(), F.col("retry_after")).otherwise(retry_after(F.col("_last"), attempts)).alias("retry_after"),
    )
