"""Delivery feedback: provider events advance the status of sent notifications."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rentscope.sources.buckets import committed

# Provider event to status, and the rank a status may not fall below.
EVENT_STATUS = {
    "bounce": "bounced", "blocked": "bounced", "deferred": "failed", "delivered": "delivered", "open": "opened", "click": "clicked",
    "unsubscribe": "unsubscribed", "group_unsubscribe": "unsubscribed", "spamreport": "bounced",
}
STATUS_RANK = {"sent": 0, "failed": 0, "delivered": 1, "opened": 2, "clicked": 3, "bounced": 4, "unsubscribed": 4}


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def strongest(events: DataFrame, order: list[str]) -> DataFrame:
    """(external_id, new_status, new_rank): the last event of the highest rank per message.

    Applying events one by one, replacing on equal or higher rank, ends in this same status.
    """
    status = _lookup(EVENT_STATUS, F.col("event"))
    message = F.split_part("sg_message_id", F.lit("."), F.lit(1))
    known = events.withColumns({"new_status": status, "external_id": message}).where(
        F.col("new_status").isNotNull() & (F.coalesce("sg_message_id", F.lit("")) != "")
    ).withColumn("new_rank", _lookup(STATUS_RANK, F.col("new_status")))
    return known.groupBy("external_id").agg(
        F.max_by("new_status", F.struct("new_rank", *order)).alias("new_status"), F.max("new_rank").alias("new_rank")
    )


def advance_status(events: DataFrame, notifications: DataFrame, order: list[str]) -> DataFrame:
    """Notifications after the events; only mail rows move and no status moves down in rank."""
    news = strongest(events, order)
    joined = notifications.join(news, "external_id", "left")
    stored = F.coalesce(_lookup(STATUS_RANK, F.col("status")), F.lit(0))
    moves = (F.col("channel") == "email") & (F.col("new_rank") >= stored)
    return joined.withColumn("status", F.when(moves, F.col("new_status")).otherwise(F.col("status"))).drop("new_status", "new_rank")


def current_status(notifications: DataFrame, updates: DataFrame) -> DataFrame:
    """Notifications with the newest update of each message (``batch`` orders the updates)."""
    last = updates.groupBy("external_id").agg(F.max_by("status", "batch").alias("_s"))
    return notifications.join(last, "external_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def levels(batches: int) -> list[tuple[int, int]]:
    """(last batch, number of batches) of the folders that hold the first ``batches`` batches: one for each binary digit, shortest first."""
    out = []
    while batches:
        span = batches & -batches
        out.append((batches - 1, span))
        batches -= span
    return out


def _folder(path: str, last: int, span: int) -> str:
    return f"{path}/last={last}/span={span}"


UPDATE = "external_id string, status string, batch bigint"


def read_updates(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The newest update of each message in the first ``batches`` batches, from as many folders as their number has binary ones."""
    folders = [_folder(path, *f) for f in levels(batches)]
    rows = spark.read.schema(UPDATE).parquet(*folders) if folders else spark.createDataFrame([], UPDATE)
    return rows.groupBy("external_id").agg(F.max_by("status", "batch").alias("status"), F.max("batch").alias("batch"))


def batches_written(spark: SparkSession, path: str) -> int:
    """How many batches have been written: a batch's marker is the last thing it writes."""
    return max(committed(spark, f"{path}/done", "batch"), default=-1) + 1


def status_batch(events: DataFrame, notifications: DataFrame, path: str, batch_id: int, order: list[str]) -> None:
    """Write the status changes of batch ``batch_id`` (0, 1, ...), folded with as many earlier batches as its level takes.

    Like the digits of a counter, folders of 1, 2, 4 ... batches merge when the next of their length would appear, so a batch reads a number of
    folders that is logarithmic in the number of batches, and each update is written again a logarithmic number of times.  Folders that were
    merged stay, so a batch that is repeated reads and writes the same.
    """
    spark = events.sparkSession
    named = strongest(events, order).select("external_id")
    earlier = read_updates(spark, path, batch_id)
    before = current_status(notifications.join(named, "external_id", "left_semi"), earlier.join(named, "external_id", "left_semi"))
    after = advance_status(events, before.withColumn("_old", F.col("status")), order)
    changed = after.where(F.col("status") != F.col("_old")).select("external_id", "status", F.lit(batch_id).cast("long").alias("batch")).distinct()
    last, span = levels(batch_id + 1)[0]
    merged = [_folder(path, *f) for f in levels(batch_id) if f[1] < span]
    rows = changed.unionByName(spark.read.schema(UPDATE).parquet(*merged)) if merged else changed
    newest = rows.groupBy("external_id").agg(F.max_by("status", "batch").alias("status"), F.max("batch").alias("batch"))
    newest.write.mode("overwrite").parquet(_folder(path, last, span))
    spark.range(0).write.mode("overwrite").parquet(f"{path}/done/batch={batch_id}")


def start_status_stream(events: DataFrame, notifications: DataFrame, updates_path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """``status_batch`` on every batch; read the changes with ``read_updates`` and apply them with ``current_status``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        status_batch(batch, notifications, updates_path, batch_id, order)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
