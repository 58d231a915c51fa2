"""Window functions and set operations."""

from pyspark.sql import functions as F

from rentscope.operators import backoff
from rentscope.operators import folds
from rentscope.operators import history as H
from rentscope.operators import observability as B
from rentscope.operators import setops as X
from rentscope.operators.scale import running_number
from rentscope.plans.filters import AS_OF
from rentscope.plans.registry import query

_RANKED = """SELECT h.plan_id, h.price, h.recorded_at, row_number() OVER (PARTITION BY h.plan_id
  ORDER BY h.recorded_at {d}, h.seq {d}, h.line {d}) AS rn FROM price_history h WHERE h.recorded_at >= @ts'2001-08-07 00:00:00'"""


@query("w01_latest_in_window", f"SELECT r.plan_id, r.price, r.recorded_at FROM ({_RANKED.format(d='DESC')}) r WHERE r.rn = 1")
def w01(t):
    return H.latest_prices(H.since(t.price_history, AS_OF, 90))


@query("w02_earliest_in_window", f"SELECT r.plan_id, r.price, r.recorded_at FROM ({_RANKED.format(d='ASC')}) r WHERE r.rn = 1")
def w02(t):
    return H.earliest_prices(H.since(t.price_history, AS_OF, 90))


@query("w03_outcome_shares", """
SELECT r.outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct, round(@avg(r.elapsed_sec), 1) AS avg_s,
  round(@avg(r.cost_usd), 4) AS avg_cost FROM runs r WHERE r.run_at > @ts'2024-01-28 00:00:00' GROUP BY r.outcome
""")
def w03(t):
    return B.outcome_shares(t.runs, "2024-01-29 00:00:00", 24)


@query("w04_previous_price", """
SELECT r.plan_id, max(CASE WHEN r.rn = 2 THEN r.price END) AS previous_price FROM (SELECT h.plan_id, h.price, row_number() OVER
  (PARTITION BY h.plan_id ORDER BY h.recorded_at DESC, h.seq DESC, h.line DESC) AS rn FROM price_history h) r GROUP BY r.plan_id
""")
def w04(t):
    return H.previous_prices(t.price_history)


@query("w05_newest_run", """
SELECT r.apartment_id, CASE WHEN length(a.title) > 32 THEN substring(a.title, 1, 30) || '..' ELSE a.title END AS title, a.city,
  r.outcome, r.run_at, CASE WHEN r.outcome IN ('success','cache_hit','platform_direct','platform_direct_static',
    'platform_direct_rendered','content_unchanged') THEN 'ok'
    WHEN r.outcome IN ('validated_fail','hard_fail','skipped_negative_cache') THEN 'failed' ELSE 'other' END AS status
FROM (SELECT x.*, row_number() OVER (PARTITION BY x.apartment_id ORDER BY x.run_at DESC, x.id DESC) AS rn FROM runs x
  WHERE x.apartment_id IS NOT NULL) r JOIN apartments a ON a.id = r.apartment_id WHERE r.rn = 1
""")
def w05(t):
    return B.newest_run(t.runs, t.apartments)


@query("w06_representative_row", """
SELECT r.apartment_id, r.name, r.pos, r.min_price, r.size_sqft FROM (SELECT s.*, row_number() OVER (PARTITION BY s.apartment_id, s.name
  ORDER BY s.min_price NULLS LAST, s.pos) AS rn FROM snapshot s) r WHERE r.rn = 1
""")
def w06(t):
    return folds.representative(t.snapshot, ["apartment_id", "name"], "pos", "min_price", ["pos", "min_price", "size_sqft"])


@query("w07_carry_forward", """
SELECT r.plan_id, r.price, @ts'2001-11-05 00:00:00' AS recorded_at FROM (SELECT h.plan_id, h.price, row_number() OVER
  (PARTITION BY h.plan_id ORDER BY h.recorded_at DESC, h.seq DESC, h.line DESC) AS rn FROM price_history h) r
JOIN plans p ON p.id = r.plan_id WHERE r.rn = 1
""")
def w07(t):
    return H.carry_forward(t.price_history, t.plans, AS_OF)[0]


@query("w07_synced_prices", """
SELECT p.id, CASE WHEN r.plan_id IS NOT NULL THEN r.price ELSE p.current_price END AS current_price FROM plans p LEFT JOIN
(SELECT h.plan_id, h.price, row_number() OVER (PARTITION BY h.plan_id ORDER BY h.recorded_at DESC, h.seq DESC, h.line DESC) AS rn
  FROM price_history h) r ON r.plan_id = p.id AND r.rn = 1
""")
def w07_sync(t):
    return H.carry_forward(t.price_history, t.plans, AS_OF)[1].select("id", "current_price")


@query("w08_first_seen", """
SELECT r.external_id, r.seq, r.title FROM (SELECT c.*, row_number() OVER (PARTITION BY c.external_id ORDER BY c.seq) AS rn
  FROM candidates c) r WHERE r.rn = 1
""")
def w08(t):
    return X.first_seen(t.candidates, ["external_id"], "seq", ["seq", "title"]).orderBy("seq")


@query("w09_price_changes", """
SELECT r.plan_id, r.price, r.recorded_at, r.previous FROM (SELECT h.plan_id, h.price, h.recorded_at,
  lag(h.price) OVER (PARTITION BY h.plan_id ORDER BY h.recorded_at, h.seq, h.line) AS previous FROM price_history h) r
WHERE r.previous IS NULL OR r.price <> r.previous
""")
def w09(t):
    return H.price_moves(t.price_history).select("plan_id", "price", "recorded_at", "previous")


@query("w10_chunks", """
SELECT r.id, cast(floor((r.rn - 1) / 50) AS bigint) AS chunk, cast(floor((r.rn - 1) / 50) AS bigint) * 30 AS delay_sec
FROM (SELECT p.id, row_number() OVER (ORDER BY p.id) AS rn FROM plans p WHERE p.is_available) r
""")
def w10(t):
    rows = running_number(t.plans.where("is_available").select("id"), [F.floor(F.col("id") / n) for n in (100_000_000, 10_000)], ["id"], "rn")
    chunk = F.floor((F.col("rn") - 1) / 50)
    return rows.select("id", chunk.alias("chunk"), (chunk * 30).alias("delay_sec"))


@query("w11_backoff_state", """
WITH l AS (SELECT r.url, r.run_at, r.id, CASE WHEN r.outcome IN ('success','content_unchanged','cache_hit','platform_direct') THEN 1
    WHEN r.outcome IN ('validated_fail','hard_fail') THEN 0 END AS ok FROM runs r),
s AS (SELECT x.*, sum(x.ok) OVER (PARTITION BY x.url ORDER BY x.run_at DESC, x.id DESC) AS later FROM l x WHERE x.ok IS NOT NULL),
f AS (SELECT s.url, min(s.run_at) AS first_failed_at, max(s.run_at) AS last_failed_at, count(*) AS attempt_count
  FROM s WHERE s.later = 0 GROUP BY s.url)
SELECT f.url, f.first_failed_at, f.last_failed_at, f.attempt_count,
  f.last_failed_at + CASE WHEN f.attempt_count = 1 THEN interval '7' day WHEN f.attempt_count = 2 THEN interval '14' day
    ELSE interval '30' day END AS retry_after FROM f
""")
def w11(t):
    return backoff.replay(t.runs).select("url", "first_failed_at", "last_failed_at", "attempt_count", "retry_after")


@query("w12_newest_point", """
SELECT r.plan_id, max(CASE WHEN r.rn = 1 THEN r.price END) AS price, max(CASE WHEN r.rn = 2 THEN r.price END) AS previous_price,
  coalesce(max(CASE WHEN r.rn = 2 THEN r.price END) <> 0 AND
    max(CASE WHEN r.rn = 1 THEN r.price END) < max(CASE WHEN r.rn = 2 THEN r.price END), false) AS dropped,
  CASE WHEN max(r.recorded_at) > @ts'2001-11-04 00:00:00' THEN 'Today' WHEN max(r.recorded_at) > @ts'2001-11-03 00:00:00'
    THEN 'Yesterday' ELSE strftime(max(r.recorded_at), '%b %-d') END AS label
FROM (SELECT h.*, row_number() OVER (PARTITION BY h.plan_id ORDER BY h.recorded_at DESC, h.seq DESC, h.line DESC) AS rn
  FROM price_history h) r GROUP BY r.plan_id
""")
def w12(t):
    return H.newest_point(t.price_history, AS_OF)


@query("x01_union_first_list_wins", """
WITH u AS (SELECT 0 AS list, c.seq, c.external_id, c.title FROM candidates c WHERE c.rating >= 4.5
  UNION ALL SELECT 1, c.seq, c.external_id, c.title FROM candidates c WHERE c.user_rating_count >= 50
  UNION ALL SELECT 2, a.id, a.external_id, a.title FROM apartments a)
SELECT r.external_id, r.list, r.seq, r.title FROM (SELECT u.*, row_number() OVER (PARTITION BY u.external_id ORDER BY u.list, u.seq) AS rn
  FROM u) r WHERE r.rn = 1
""")
def x01(t):
    c = t.candidates
    lists = [c.where("rating >= 4.5"), c.where("user_rating_count >= 50"), t.apartments.withColumnRenamed("id", "seq")]
    return X.union_first_wins([d.select("seq", "external_id", "title") for d in lists], ["external_id"], "seq", ["seq", "title"])


@query("x02_distinct_rows", "SELECT DISTINCT a.city, a.state, a.property_type FROM apartments a")
def x02(t):
    return t.apartments.select("city", "state", "property_type").distinct()


@query("x03_without_recent_run", """
SELECT a.id, a.title FROM apartments a WHERE a.is_available AND a.id NOT IN (SELECT r.apartment_id FROM runs r
  WHERE r.apartment_id IS NOT NULL AND r.run_at >= @ts'2024-01-30 20:00:00')
""")
def x03(t):
    return B.without_run(t.apartments, t.runs, "2024-01-31 20:00:00", 1).select("id", "title")


@query("x04_children_missing_from_snapshot", """
SELECT p.id, p.apartment_id FROM plans p WHERE p.is_available
  AND EXISTS (SELECT 1 FROM snapshot s WHERE s.apartment_id = p.apartment_id)
  AND NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.apartment_id = p.apartment_id AND s.name = p.name)
""")
def x04(t):
    return X.missing_children(t.plans.where("is_available"), t.snapshot, "apartment_id", "name").select("id", "apartment_id")
