"""The daily refresh: one query for each table that it changes or appends to."""

from pyspark.sql import functions as F

from rentscope.functions import pagetext as X
from rentscope.operators import daily as D
from rentscope.plans.dataquality import SANITISED
from rentscope.plans.filters import AS_OF
from rentscope.plans.merges import _FOLDED_PLANS, _NEWPLANS, _PLAN_COLUMNS, _match_sql
from rentscope.plans.registry import query

# Where each listing ends. A page of its own is unchanged for every fourth listing; what pages hold follows from the fixture's ids.
_FLOW = """dl AS (SELECT d.id, d.source_url, r.domain, r.corporate_parent_url AS parent, CASE WHEN r.domain IS NULL THEN 'unregistered'
    WHEN r.robots_txt_allows = false THEN 'robots_denied' WHEN r.data_source_type = 'unscrapeable' THEN 'skipped_unscrapeable'
    WHEN f.url IS NOT NULL THEN 'skipped_negative_cache' ELSE 'go' END AS decision
  FROM daily_listings d LEFT JOIN daily_registry r ON r.domain = split_part(d.source_url, '/', 3) AND r.is_active
  LEFT JOIN daily_suppression f ON f.url = d.source_url AND f.retry_after > @ts'2001-11-05 00:00:00'
  WHERE d.is_available AND d.data_source_type = 'brand_site'),
vs AS (SELECT dl.id, dl.source_url, dl.parent IS NOT NULL AND dl.parent LIKE '%8' AS redirected, dl.parent,
    CASE WHEN dl.parent LIKE '%8' THEN 'units' WHEN dl.id % 7 = 6 THEN 'none' WHEN dl.id % 5 = 0 THEN 'empty' ELSE 'units' END AS page,
    dl.parent IS NULL AND dl.id % 7 <> 6 AS digested FROM dl WHERE dl.decision = 'go'),
oc AS (SELECT vs.*, CASE WHEN vs.digested AND vs.id % 4 = 0 THEN 'content_unchanged' WHEN vs.page = 'none' THEN 'hard_fail' WHEN vs.page = 'empty' THEN 'validated_fail'
    ELSE 'platform_direct_static' END AS outcome FROM vs),
ru AS (SELECT oc.id AS apartment_id, oc.source_url AS url, CASE WHEN oc.redirected THEN oc.parent END AS effective_url, oc.outcome, oc.outcome = 'content_unchanged' AS short,
    CASE WHEN oc.outcome = 'platform_direct_static' THEN 'avalonbay' END AS adapter_name FROM oc
  UNION ALL SELECT dl.id, dl.source_url, NULL, dl.decision, false, NULL FROM dl WHERE dl.decision LIKE 'skipped%')"""
_ROWS = """kk AS (SELECT oc.id AS apartment_id, CASE WHEN oc.redirected THEN 4711 ELSE oc.id END AS k FROM oc WHERE oc.outcome = 'platform_direct_static'),
ds AS (SELECT kk.apartment_id, u.pos, CASE u.pos WHEN 0 THEN 'A' || cast(kk.k % 3 AS string) ELSE 'New' || cast(kk.k AS string) END AS name, cast(u.pos + 1 AS string) AS unit_number,
  cast(u.pos + 1 AS double) AS bedrooms, cast(u.pos + 1 AS double) AS bathrooms, cast(CASE u.pos WHEN 0 THEN 500 ELSE 900 END + kk.k % 300 AS double) AS size_sqft,
  cast(CASE u.pos WHEN 0 THEN 1800 ELSE 2500 END + kk.k % 50 AS double) AS min_price, cast(CASE u.pos WHEN 0 THEN 1800 ELSE 2500 END + kk.k % 50 AS double) AS max_price,
  cast(NULL AS varchar) AS external_url, cast(NULL AS int) AS floor_level, cast(NULL AS varchar) AS facing, 'avalonbay' AS adapter_name
  FROM kk CROSS JOIN (SELECT unnest([0, 1]) AS pos) u)"""
_PLACED = f"""{_FLOW}, {_ROWS}, {SANITISED.replace('FROM snapshot s', 'FROM ds s')}, named AS (SELECT p.* FROM plans p), {_match_sql('san')}, {_NEWPLANS},
pl AS (SELECT s.*, coalesce(mt.plan_id, np.id) AS plan_id FROM san s JOIN mt ON mt.apartment_id = s.apartment_id
  AND mt.pos = s.pos LEFT JOIN np ON np.apartment_id = mt.apartment_id AND np.pos = mt.made_by WHERE mt.tier IS NOT NULL)"""


def _listings(t):
    """The fixture's listings; every fourth has the digest of its own page."""
    own = t.daily_pages.select(F.col("url").alias("source_url"), X.content_hash(F.col("html")).alias("_h"))
    stored = F.when(F.col("id") % 4 == 0, F.col("_h")).when(F.col("id") % 4 == 1, "stale")
    return t.daily_listings.join(own, "source_url", "left").withColumn("last_content_hash", stored).drop("_h")


def _visits(t):
    return D.visit(_listings(t), t.daily_registry, t.daily_suppression, t.daily_pages, AS_OF)


def _refreshed(t):
    return D.daily_refresh(
        _listings(t), t.daily_registry, t.daily_suppression, t.daily_pages, t.plans, t.units, t.subscriptions, t.price_history, AS_OF
    )


@query("m07_daily_runs", f"WITH {_FLOW} SELECT ru.apartment_id, ru.url, ru.effective_url, ru.outcome, ru.short AS content_hash_short_circuit, ru.adapter_name FROM ru")
def daily_runs(t):
    return _visits(t).runs.select("apartment_id", "url", "effective_url", "outcome", "content_hash_short_circuit", "adapter_name")


@query("m07_daily_listings", f"""
WITH {_FLOW} SELECT d.id, CASE WHEN oc.digested AND oc.outcome IN ('content_unchanged', 'platform_direct_static') OR oc.redirected THEN @ts'2001-11-05 00:00:00'
  ELSE d.last_scraped_at END AS last_scraped_at FROM daily_listings d LEFT JOIN oc ON oc.id = d.id
""")
def daily_listings(t):
    return D.listings_after(_listings(t), _visits(t), AS_OF).select("id", "last_scraped_at")


@query("m07_daily_suppression", f"""
WITH {_FLOW}, cl AS (SELECT ru.url FROM ru WHERE ru.outcome = 'content_unchanged'), fl AS (SELECT ru.url, ru.outcome FROM ru WHERE ru.outcome IN ('hard_fail', 'validated_fail'))
SELECT coalesce(s.url, fl.url) AS url, coalesce(s.attempt_count, 0) + CASE WHEN fl.url IS NULL THEN 0 ELSE 1 END AS attempt_count, coalesce(fl.outcome, s.last_reason) AS last_reason,
  CASE WHEN fl.url IS NULL THEN s.retry_after ELSE @ts'2001-11-05 00:00:00' + CASE coalesce(s.attempt_count, 0) WHEN 0 THEN interval '7' day WHEN 1 THEN interval '14' day
    ELSE interval '30' day END END AS retry_after
FROM (SELECT x.* FROM daily_suppression x WHERE x.url NOT IN (SELECT cl.url FROM cl)) s FULL JOIN fl ON fl.url = s.url
""")
def daily_suppression(t):
    return D.suppression_after(t.daily_suppression, _visits(t).runs).select("url", "attempt_count", "last_reason", "retry_after")


@query("m07_daily_plans", f"WITH RECURSIVE {_PLACED}, {_FOLDED_PLANS}")
def daily_plans(t):
    return _refreshed(t)["plans"].select(*_PLAN_COLUMNS)


@query("m07_daily_history", f"""
WITH RECURSIVE {_PLACED} SELECT pl.plan_id, min(pl.min_price) AS price, @ts'2001-11-05 00:00:00' AS recorded_at FROM pl GROUP BY pl.plan_id HAVING min(pl.min_price) IS NOT NULL
UNION ALL SELECT h.plan_id, h.price, @ts'2001-11-05 00:00:00' FROM (SELECT x.*, row_number() OVER (PARTITION BY x.plan_id ORDER BY x.recorded_at DESC, x.seq DESC, x.line DESC) AS rn
  FROM price_history x) h JOIN plans p ON p.id = h.plan_id JOIN oc ON oc.id = p.apartment_id WHERE h.rn = 1 AND oc.outcome = 'content_unchanged'
""")
def daily_history(t):
    return _refreshed(t)["history"]


@query("m07_daily_hints", f"""
WITH {_FLOW}, ok AS (SELECT DISTINCT split_part(ru.url, '/', 3) AS domain FROM ru WHERE ru.outcome = 'platform_direct_static')
SELECT r.domain, CASE WHEN ok.domain IS NOT NULL THEN 'avalonbay' ELSE r.last_successful_adapter END AS last_successful_adapter,
  CASE WHEN ok.domain IS NOT NULL AND coalesce(r.last_successful_adapter, '') <> 'avalonbay' THEN @ts'2001-11-05 00:00:00' ELSE r.last_adapter_success_at END AS last_adapter_success_at
FROM daily_registry r LEFT JOIN ok ON ok.domain = r.domain
""")
def daily_hints(t):
    runs = _visits(t).runs.withColumn("id", F.col("apartment_id"))
    return D.merge.update_hints(t.daily_registry, runs).select("domain", "last_successful_adapter", "last_adapter_success_at")
