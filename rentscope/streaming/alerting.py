"""Alerts over arriving history rows, with the rule state kept between batches."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rentscope.operators import alerts as A
from rentscope.operators.history import ORDER
from rentscope.operators.scale import cut_lineage, first_k, instant
from rentscope.sources.buckets import BucketTable, highest
from rentscope.sources.writers import append_fact

#: Before any row: nothing can fire, and nothing has been looked at.
START = dt.datetime(1970, 1, 1)


def newest_two(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The two newest rows per plan are all that the rules need of the past."""
    cols = ["plan_id", "price", *ORDER]
    both = state.select(*cols).unionByName(batch.select(*cols))
    return first_k(both, ["plan_id"], [F.desc(c) for c in ORDER], 2).drop("rn")


@dataclass(frozen=True)
class AlertState:
    """The two newest history rows of each plan and the rules, in buckets of the plan, and the events of each run.

    A rule's plan is the one it watches by history; rules on units, listings and areas have none and share the bucket of no plan.
    """

    history: BucketTable
    rules: BucketTable
    events: str


def _rule_stats(moment: dt.datetime | None) -> dict:
    """Active rules without a plan, and the next moment at which a rule that was notified may notify again.

    Without a ``moment`` every rule is yet to be looked at.
    """
    again = F.col("last_notified_at") + F.expr(f"INTERVAL {A.DEBOUNCE_HOURS} HOURS")
    active = F.col("is_active")
    due = F.when(active, instant(str(START))) if moment is None else F.when(active & (again > instant(str(moment))), again)
    return {"wide": F.count_if(active & F.col("watched").isNull()), "due": F.min(due)}


def prepare_alert_state(path: str, rules: DataFrame, history: DataFrame, buckets: int = 1024) -> AlertState:
    """The state under ``path``, made of these rules and history rows where there is none yet."""
    watched = F.when(A.level() == "plan", F.col("plan_id"))
    first, rows = rules.withColumn("watched", watched), newest_two(history, history.limit(0))
    state = AlertState(
        BucketTable(f"{path}/history", "plan_id", rows.schema, buckets, {"newest": F.max("recorded_at")}),
        BucketTable(f"{path}/rules", "watched", first.schema, buckets), f"{path}/events",
    )
    if not state.rules.manifest(rules.sparkSession):
        state.history.replace(rows, 0)
        state.rules.replace(first, 0, stats=_rule_stats(None))
    return state


def current_rules(spark: SparkSession, state: AlertState) -> DataFrame:
    return state.rules.read(spark).drop("watched")


def alert_batch(
    state: AlertState, batch: DataFrame, run: int, units: DataFrame, plans: DataFrame, apartments: DataFrame, as_of=None
) -> set[int]:
    """Take history rows in and evaluate the rules they can move; returns the buckets looked at.

    These are the buckets of the batch's plans, those in which a rule's debounce has ended since, and, while there are active rules on units, listings
    or areas, the one that holds those.  Only they are read and written, as they were before ``run``; a repeated run writes the
    same rows.  The moment of a run is that of the newest history row so far; a fixed ``as_of`` replaces it.
    """
    spark = batch.sparkSession
    batch = cut_lineage(batch)
    stored, ruled = state.history.manifest(spark, run), state.rules.manifest(spark, run)
    known = [t for t in (highest(stored, "newest"), batch.agg(F.max("recorded_at")).first()[0]) if t is not None]
    moment = dt.datetime.fromisoformat(str(as_of)) if as_of is not None else max(known, default=START)
    fed = state.history.touched(batch, "plan_id")
    looked = fed | {b for b, r in ruled.items() if r["wide"] or (r["due"] is not None and r["due"] <= moment)}
    if not looked:
        return looked
    state.history.replace(newest_two(state.history.read(spark, fed, before=run), batch), run, fed)
    rules = state.rules.read(spark, looked, before=run)
    if not any(ruled[b]["wide"] for b in looked & ruled.keys()):  # plan rules read history alone
        units, plans, apartments = units.limit(0), plans.limit(0), apartments.limit(0)
    checked = cut_lineage(A.evaluate(rules, units, plans, apartments, state.history.read(spark, looked, before=run + 1), str(moment)))
    append_fact(A.fan_out(checked), state.events, {}, run=run)
    state.rules.replace(A.advance(rules, checked, str(moment)), run, looked, _rule_stats(moment))
    return looked


def start_alert_stream(
    history: DataFrame, state: AlertState, checkpoint: str, units: DataFrame, plans: DataFrame, apartments: DataFrame, as_of=None
) -> StreamingQuery:
    """``alert_batch`` on every batch N, as run N + 1; events are read with ``readers.read_fact``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        alert_batch(state, batch, batch_id + 1, units, plans, apartments, as_of)

    return history.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
