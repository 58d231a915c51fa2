"""Streaming rules: their batch forms, and the streams over the driver's tables."""

from pyspark.sql import functions as F

from rentscope.operators import alerts as A
from rentscope.plans.filters import AS_OF
from rentscope.plans.registry import query
from rentscope.session import shared_folder
from rentscope.streaming.alerting import alert_batch, current_rules, newest_two, prepare_alert_state
from rentscope.streaming.status import advance_status, current_status, read_updates, status_batch

_RANK = "CASE {x} WHEN 'delivered' THEN 1 WHEN 'opened' THEN 2 WHEN 'clicked' THEN 3 WHEN 'bounced' THEN 4 WHEN 'unsubscribed' THEN 4 ELSE 0 END"


_STATUS_AFTER = f"""
WITH e AS (SELECT w.seq, split_part(w.sg_message_id, '.', 1) AS external_id, CASE w.event WHEN 'bounce' THEN 'bounced' WHEN 'blocked' THEN 'bounced'
  WHEN 'deferred' THEN 'failed' WHEN 'delivered' THEN 'delivered' WHEN 'open' THEN 'opened' WHEN 'click' THEN 'clicked' WHEN 'unsubscribe' THEN 'unsubscribed'
  WHEN 'group_unsubscribe' THEN 'unsubscribed' WHEN 'spamreport' THEN 'bounced' END AS st FROM webhook_events w WHERE coalesce(w.sg_message_id, '') <> ''),
k AS (SELECT x.* FROM (SELECT e.*, {_RANK.format(x='e.st')} AS rk, row_number() OVER (PARTITION BY e.external_id ORDER BY {_RANK.format(x='e.st')} DESC, e.seq DESC)
  AS rn FROM e WHERE e.st IS NOT NULL) x WHERE x.rn = 1)
SELECT n.id, n.channel, CASE WHEN n.channel = 'email' AND k.rk >= {_RANK.format(x='n.status')} THEN k.st ELSE n.status END AS status
FROM notifications n LEFT JOIN k ON k.external_id = n.external_id
"""


@query("r01_advance_status", _STATUS_AFTER)
def r01(t):
    return advance_status(t.webhook_events, t.notifications, ["seq"]).select("id", "channel", "status")


@query("r01_status_batches", _STATUS_AFTER)
def r01_batches(t):
    """The events in five batches, as the stream takes them."""
    path, n = shared_folder(t.spark, "status"), t.webhook_events.agg(F.max("seq")).first()[0] or 0
    for i in range(5):
        part = t.webhook_events.where((F.col("seq") * 5 > n * i) & (F.col("seq") * 5 <= n * (i + 1)) | ((F.col("seq") <= 0) & F.lit(i == 0)))
        status_batch(part, t.notifications, path, i, ["seq"])
    return current_status(t.notifications, read_updates(t.spark, path, 5)).select("id", "channel", "status")


@query("r02_alerts_after_batch", """
WITH h AS (SELECT x.*, row_number() OVER (PARTITION BY x.plan_id ORDER BY x.recorded_at DESC, x.seq DESC, x.line DESC) AS rn FROM price_history x)
SELECT s.id, max(CASE WHEN h.rn = 1 THEN h.price END) AS latest_price, max(CASE WHEN h.rn = 2 THEN h.price END) AS previous_price
FROM subscriptions s LEFT JOIN h ON h.plan_id = s.plan_id AND h.rn <= 2 WHERE s.is_active AND s.unit_id IS NULL AND s.plan_id IS NOT NULL GROUP BY s.id
""")
def r02(t):
    cut = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    old = newest_two(t.price_history.where(F.col("recorded_at") < cut), t.price_history.limit(0))
    state = newest_two(old, t.price_history.where(F.col("recorded_at") >= cut))
    rules = t.subscriptions.where(A.level() == "plan")
    return A.evaluate(rules, t.units, t.plans, t.apartments, state, AS_OF).select("id", "latest_price", "previous_price")


_FIRES = ("({p} IS NOT NULL AND (({p} < s.target_price AND ({q} IS NULL OR {q} >= s.target_price)) "
          "OR coalesce((s.baseline_price - {p}) * 100 / nullif(s.baseline_price, 0) >= s.price_drop_pct, false)))")


@query("r02_rules_after_batches", f"""
WITH h AS (SELECT x.plan_id, x.price, x.recorded_at < @ts'2001-01-01 00:00:00' AS old, row_number() OVER (PARTITION BY x.plan_id ORDER BY x.recorded_at DESC, x.seq DESC,
    x.line DESC) AS rn, row_number() OVER (PARTITION BY x.plan_id, x.recorded_at < @ts'2001-01-01 00:00:00' ORDER BY x.recorded_at DESC, x.seq DESC, x.line DESC) AS ro
  FROM price_history x),
k AS (SELECT h.plan_id, max(CASE WHEN h.old AND h.ro = 1 THEN h.price END) AS p1, max(CASE WHEN h.old AND h.ro = 2 THEN h.price END) AS q1,
    max(CASE WHEN h.rn = 1 THEN h.price END) AS p2, max(CASE WHEN h.rn = 2 THEN h.price END) AS q2 FROM h GROUP BY 1),
f AS (SELECT s.id, s.is_active, s.trigger_count, s.is_active AND NOT coalesce(s.last_notified_at > @ts'2001-11-04 00:00:00', false)
    AND (coalesce({_FIRES.format(p='k.p1', q='k.q1')}, false) OR coalesce({_FIRES.format(p='k.p2', q='k.q2')}, false)) AS fired
  FROM subscriptions s LEFT JOIN k ON k.plan_id = s.plan_id WHERE s.unit_id IS NULL AND s.plan_id IS NOT NULL)
SELECT f.id, f.is_active AND NOT f.fired AS is_active, CASE WHEN f.fired THEN coalesce(f.trigger_count, 0) + 1 ELSE f.trigger_count END AS trigger_count FROM f
""")
def r02_rules(t):
    """Plan rules after two batches of the history, with state and rules in buckets."""
    cut = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    rules = t.subscriptions.where(A.level() == "plan")
    state = prepare_alert_state(shared_folder(t.spark, "alerts"), rules, t.price_history.limit(0), buckets=32)
    for run, part in enumerate((F.col("recorded_at") < cut, F.col("recorded_at") >= cut), 1):
        alert_batch(state, t.price_history.where(part), run, t.units, t.plans, t.apartments, AS_OF)
    return current_rules(t.spark, state).select("id", "is_active", "trigger_count")
