"""Aggregations."""

from pyspark.sql import functions as F

from rentscope.operators import folds
from rentscope.operators import history as H
from rentscope.operators import listings as L
from rentscope.operators import matching as M
from rentscope.operators import observability as B
from rentscope.operators import quality as Q
from rentscope.operators import stats as S
from rentscope.operators.scale import count_if
from rentscope.plans.filters import AS_OF, EVENTS_AS_OF
from rentscope.plans.registry import query


@query("a01_cities", """
SELECT a.city FROM apartments a WHERE a.is_available AND a.title NOT ILIKE '%senior%' GROUP BY a.city ORDER BY a.city
""")
def a01(t):
    return S.cities(t.apartments)


@query("a02_apartments_by_city", "SELECT a.city, count(*) AS n FROM apartments a GROUP BY a.city")
def a02(t):
    return S.count_by(t.apartments, "city")


@query("a03_apartments_by_type", "SELECT a.property_type, count(*) AS n FROM apartments a GROUP BY a.property_type")
def a03(t):
    return S.count_by(t.apartments, "property_type")


@query("a04_average_price_by_bedrooms", """
SELECT p.bedrooms, @avg(p.price) AS avg_price FROM plans p JOIN apartments a ON a.id = p.apartment_id
WHERE a.city ILIKE '%nation_1%' GROUP BY p.bedrooms
""")
def a04(t):
    return S.average_by_bedrooms(t.plans, t.apartments, "price", "avg_price", "nation_1")


@query("a05_plans_by_bedrooms", "SELECT p.bedrooms, count(*) AS n FROM plans p GROUP BY p.bedrooms")
def a05(t):
    return S.count_by(t.plans, "bedrooms")


@query("a06_average_area_by_bedrooms", "SELECT p.bedrooms, @avg(p.area_sqft) AS avg_area FROM plans p GROUP BY p.bedrooms")
def a06(t):
    return S.average_by_bedrooms(t.plans, t.apartments, "area_sqft", "avg_area")


@query("a07_price_trends", """
SELECT strftime(h.recorded_at, '%Y-%m-%d') AS day, @avg(h.price) AS avg_price FROM price_history h
JOIN plans p ON p.id = h.plan_id JOIN apartments a ON a.id = p.apartment_id
WHERE h.recorded_at >= @ts'2001-08-07 00:00:00' AND a.city ILIKE '%nation%' AND p.bedrooms = 2 GROUP BY 1
""")
def a07(t):
    return H.price_trends(t.price_history, t.plans, t.apartments, AS_OF, 90, "nation", 2).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


@query("a08_median_by_city_beds", """
SELECT lower(a.city) AS city, p.bedrooms, count(*) AS plan_count, quantile_cont(p.price, 0.5) AS median FROM plans p
JOIN apartments a ON a.id = p.apartment_id WHERE p.is_available AND p.price IS NOT NULL GROUP BY 1, 2
""")
def a08(t):
    return S.median_by_city_beds(t.plans, t.apartments)


@query("a09_median_of_midpoints", """
SELECT coalesce(quantile_cont((s.lo + s.hi) / 2, 0.5), 0) AS median FROM (SELECT p.apartment_id,
  min(CASE WHEN p.price > 0 THEN p.price END) AS lo, max(CASE WHEN p.price > 0 THEN p.price END) AS hi
  FROM plans p GROUP BY p.apartment_id) s WHERE s.lo IS NOT NULL AND s.hi IS NOT NULL
""")
def a09(t):
    return S.median_of_midpoints(L.apartment_summary(t.apartments, t.plans))


@query("a10_min_price_by_apartment", """
SELECT p.apartment_id, min(p.price) AS min_price FROM plans p WHERE p.is_available AND p.price IS NOT NULL GROUP BY p.apartment_id
""")
def a10(t):
    return L.min_price_by_apartment(t.plans)


@query("a11_run_stats", """
WITH r AS (SELECT * FROM runs x WHERE x.run_at >= @ts'2024-01-24 00:00:00'),
g AS (SELECT r.outcome, count(*) AS n FROM r GROUP BY r.outcome)
SELECT (SELECT count(*) FROM r) AS total_scrapes,
  (SELECT string_agg(g.outcome || ':' || cast(g.n AS string), ' ' ORDER BY g.outcome) FROM g) AS by_outcome,
  (SELECT round(100.0 * sum(CASE WHEN r.outcome = 'cache_hit' THEN 1 ELSE 0 END) / count(*), 1) FROM r) AS cache_hit_pct,
  (SELECT round(100.0 * sum(CASE WHEN r.outcome = 'content_unchanged' THEN 1 ELSE 0 END) / count(*), 1) FROM r)
    AS short_circuit_pct,
  (SELECT round(cast(sum(cast(r.cost_usd AS decimal(18, 8))) AS double), 4) FROM r) AS total_cost_usd
""")
def a11(t):
    return B.run_stats(t.runs, EVENTS_AS_OF, 7)


@query("a11_run_outcome_map")
def a11_map(t):
    return B.outcome_map(t.runs)


@query("a12_nearest_rank_costs", """
WITH c AS (SELECT r.cost_usd, row_number() OVER (ORDER BY r.cost_usd) - 1 AS i, count(*) OVER () AS n FROM runs r WHERE r.cost_usd > 0)
SELECT max(CASE WHEN c.i = cast(floor(c.n / 2) AS bigint) THEN c.cost_usd END) AS p50,
  max(CASE WHEN c.i = cast(floor(c.n * 0.95) AS bigint) THEN c.cost_usd END) AS p95 FROM c
""")
def a12(t):
    return B.cost_percentiles(t.runs)


@query("a13_failures_by_domain", """
SELECT lower(regexp_extract(r.url, '^[a-z]+://([^/?#]*)', 1)) AS domain, count(*) AS n FROM runs r
WHERE r.outcome IN ('hard_fail', 'validated_fail') GROUP BY 1
""")
def a13(t):
    return B.failures_by_domain(t.runs)


@query("a13_top_failing_domains", """
SELECT lower(regexp_extract(r.url, '^[a-z]+://([^/?#]*)', 1)) AS domain, count(*) AS n FROM runs r
WHERE r.outcome IN ('hard_fail', 'validated_fail') GROUP BY 1 ORDER BY n DESC, domain LIMIT 5
""")
def a13_top(t):
    return B.failures_by_domain(t.runs, 5)


@query("a14_daily_digest", """
WITH r AS (SELECT * FROM runs x WHERE x.run_at >= @ts'2024-01-28 00:00:00'),
k AS (SELECT count(*) AS total, count_if(r.outcome IN ('success','platform_direct_static','platform_direct_rendered')) AS n_success,
  count_if(r.outcome = 'content_unchanged') AS n_unchanged, count_if(r.outcome IN ('skipped_negative_cache','cache_hit')) AS n_skipped,
  count_if(r.outcome IN ('hard_fail','validated_fail')) AS n_failed,
  round(cast(sum(CASE WHEN r.cost_usd > 0 THEN cast(r.cost_usd AS decimal(18, 8)) END) AS double), 2) AS total_cost FROM r),
c AS (SELECT r.cost_usd, row_number() OVER (ORDER BY r.cost_usd) - 1 AS i, count(*) OVER () AS n FROM r WHERE r.cost_usd > 0)
SELECT k.total, k.n_success, 100 * k.n_success // k.total AS pct_success, k.n_unchanged, 100 * k.n_unchanged // k.total AS pct_unchanged,
  k.n_skipped, 100 * k.n_skipped // k.total AS pct_skipped, k.n_failed, 100 * k.n_failed // k.total AS pct_failed, k.total_cost,
  (SELECT max(CASE WHEN c.i = cast(floor(c.n / 2) AS bigint) THEN c.cost_usd END) FROM c) AS p50,
  (SELECT max(CASE WHEN c.i = cast(floor(c.n * 0.95) AS bigint) THEN c.cost_usd END) FROM c) AS p95 FROM k
""")
def a14(t):
    return B.daily_digest(t.runs, "2024-01-29 00:00:00")


_CLEAN = "p.name NOT IN ('Unit','Favorite','Tour','Tour Now','Available Now','View Details','Select','Share','Save','')"


@query("a15_plan_quality", f"""
SELECT count(*) AS total_plans, count_if(p.area_sqft > 0) AS with_sqft,
  round(100.0 * count_if(p.area_sqft > 0) / nullif(count(*), 0), 1) AS sqft_pct, count_if({_CLEAN}) AS clean_name,
  round(100.0 * count_if({_CLEAN}) / nullif(count(*), 0), 1) AS clean_name_pct, count(p.current_price) AS priced,
  count(p.external_url) AS with_url, count(p.floor_level) AS with_floor FROM plans p
""")
def a15(t):
    return S.plan_quality(t.plans)


@query("a16_run_outcomes", """
SELECT r.outcome, count(*) AS runs, round(@avg(r.cost_usd), 4) AS avg_cost_usd, round(@avg(r.elapsed_sec), 1) AS avg_elapsed_sec
FROM runs r WHERE r.run_at > @ts'2024-01-17 00:00:00' GROUP BY r.outcome
""")
def a16(t):
    return B.run_outcomes(t.runs, EVENTS_AS_OF, 14)


@query("a17_runs_by_adapter", """
SELECT coalesce(r.adapter_name, '(unknown)') AS adapter, count(*) AS runs, round(@avg(r.elapsed_sec), 1) AS avg_elapsed_sec
FROM runs r WHERE r.run_at > @ts'2024-01-17 00:00:00'
  AND r.outcome IN ('platform_direct','platform_direct_static','platform_direct_rendered') GROUP BY 1
""")
def a17(t):
    return B.runs_by_adapter(t.runs, EVENTS_AS_OF, 14)


@query("a18_history_growth", """
SELECT strftime(h.recorded_at, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT h.plan_id) AS distinct_plans
FROM price_history h WHERE h.recorded_at > @ts'2000-11-05 00:00:00' GROUP BY 1
""")
def a18(t):
    return H.growth(t.price_history, AS_OF, 365).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a18_history_growth_totals", """
SELECT count(*) AS total_rows, count(DISTINCT cast(h.recorded_at AS date)) AS days_with_data,
  round(count(*) / count(DISTINCT cast(h.recorded_at AS date)), 1) AS rows_per_day
FROM price_history h WHERE h.recorded_at > @ts'2000-11-05 00:00:00'
""")
def a18_totals(t):
    return H.growth_totals(H.growth(t.price_history, AS_OF, 365))


@query("a19_notification_counts", """
SELECT n.channel, n.status, count(*) AS events FROM notifications n WHERE n.sent_at > @ts'2024-01-17 00:00:00' GROUP BY 1, 2
""")
def a19(t):
    return B.notification_counts(t.notifications, EVENTS_AS_OF, 14)


@query("a20_notification_funnel", """
WITH c AS (SELECT n.channel, count_if(n.status = 'sent') AS sent, count_if(n.status = 'failed') AS failed,
  count_if(n.status = 'delivered') AS delivered, count_if(n.status = 'opened') AS opened, count_if(n.status = 'clicked') AS clicked,
  count_if(n.status = 'bounced') AS bounced, count_if(n.status = 'unsubscribed') AS unsubscribed
  FROM notifications n WHERE n.sent_at >= @ts'2024-01-24 00:00:00' GROUP BY n.channel)
SELECT c.*, round((delivered + opened + clicked + unsubscribed)
    / nullif(sent + delivered + opened + clicked + bounced + unsubscribed, 0), 4) AS delivery_rate,
  round((opened + clicked) / nullif(delivered + opened + clicked + unsubscribed, 0), 4) AS open_rate,
  round(clicked / nullif(opened + clicked, 0), 4) AS click_rate,
  round(bounced / nullif(sent + failed + delivered + opened + clicked + bounced + unsubscribed, 0), 4) AS bounce_rate FROM c
""")
def a20(t):
    return B.notification_funnel(t.notifications, EVENTS_AS_OF, 7)


@query("a21_cost_by_source", """
SELECT coalesce(c.source, 'TOTAL') AS source, count(*) AS calls, cast(round(sum(c.cost_usd), 4) AS double) AS total_usd
FROM costs c WHERE c.ts > @ts'2024-01-17 00:00:00' GROUP BY ROLLUP (c.source)
""")
def a21(t):
    return B.cost_by_source(t.costs, EVENTS_AS_OF, 14)


@query("a22_cost_by_day", """
SELECT coalesce(d.day, 'TOTAL') AS day, count(*) AS calls, count_if(d.source = 'scraper') AS scraper,
  count_if(d.source = 'google_maps') AS google_maps, cast(sum(d.cost_usd) AS double) AS cost
FROM (SELECT strftime(c.ts, '%Y-%m-%d') AS day, c.* FROM costs c) d GROUP BY ROLLUP (d.day)
""")
def a22(t):
    return B.cost_by_day(t.costs)


@query("a23_cost_by_source_outcomes", """
WITH g AS (SELECT c.source, c.outcome, count(*) AS n, sum(c.cost_usd) AS s FROM costs c GROUP BY c.source, c.outcome)
SELECT g.source, cast(sum(g.n) AS bigint) AS calls, cast(sum(g.s) AS double) AS cost,
  string_agg(g.outcome || ':' || cast(g.n AS string), '  ' ORDER BY g.outcome) AS outcomes FROM g GROUP BY g.source
UNION ALL SELECT 'TOTAL', cast(sum(g.n) AS bigint), cast(sum(g.s) AS double), '' FROM g
""")
def a23(t):
    return B.cost_by_source_outcomes(t.costs)


@query("a24_suspicious_names", """
SELECT p.name, count(*) AS n FROM plans p WHERE lower(p.name) IN ('favorite','tour','tour now','view details','available',
  'available now','select','share','save','unit','schedule tour','apply now','contact','compare','hide','show more','schedule',
  'inquire','see details') GROUP BY p.name
""")
def a24(t):
    return S.suspicious_names(t.plans)


@query("a25_hint_distribution", """
SELECT r.last_successful_adapter AS adapter, count(*) AS n, max(r.last_adapter_success_at) AS last_success,
  r.last_successful_adapter = 'universal_dom' AS polluted FROM registry r
WHERE r.is_active AND r.last_successful_adapter IS NOT NULL GROUP BY r.last_successful_adapter
""")
def a25(t):
    return B.hint_distribution(t.registry)


@query("a26_rendered_latency", """
SELECT r.outcome, r.adapter_name, count(*) AS n, round(@avg(r.elapsed_sec), 1) AS avg_s,
  round(quantile_cont(r.elapsed_sec, 0.95), 1) AS p95_s, round(@avg(r.elapsed_sec), 1) > 13 AS slow
FROM runs r WHERE r.run_at > @ts'2024-01-28 00:00:00' AND r.outcome IN ('platform_direct_rendered','not_apartment','no_data')
GROUP BY 1, 2 HAVING count(*) >= 3
""")
def a26(t):
    return B.rendered_latency(t.runs, EVENTS_AS_OF, 3)


@query("a27_zero_area_report", """
SELECT a.title, a.city, count_if(p.area_sqft = 0) AS zero_sqft, count_if(p.area_sqft > 0) AS good_sqft, count(*) AS total
FROM plans p JOIN apartments a ON a.id = p.apartment_id GROUP BY a.id, a.title, a.city HAVING count_if(p.area_sqft = 0) > 0
""")
def a27(t):
    return S.zero_area_report(t.plans, t.apartments)


@query("a28_coverage_outcomes", """
SELECT r.outcome, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM runs x), 1) AS pct FROM runs r GROUP BY r.outcome
""")
def a28(t):
    return B.coverage(t.runs)["outcomes"]


@query("a28_coverage_adapters", """
WITH d AS (SELECT coalesce(r.adapter_name, '(unknown)') AS adapter FROM runs r
  WHERE r.outcome IN ('platform_direct','platform_direct_static','platform_direct_rendered'))
SELECT d.adapter, count(*) AS runs, round(100.0 * count(*) / (SELECT count(*) FROM d), 1) AS pct_of_direct,
  round(100.0 * count(*) / (SELECT count(*) FROM runs x), 1) AS pct_of_all FROM d GROUP BY d.adapter
""")
def a28_adapters(t):
    return B.coverage(t.runs)["adapters"]


@query("a28_coverage_totals", """
WITH k AS (SELECT count(*) AS total_runs,
  count_if(r.outcome IN ('platform_direct','platform_direct_static','platform_direct_rendered')) AS direct_runs,
  count_if(r.outcome IN ('success','cache_hit')) AS paid_runs, count_if(r.outcome = 'content_unchanged') AS unchanged,
  cast(sum(CASE WHEN r.outcome IN ('success','cache_hit') THEN cast(r.cost_usd AS decimal(18, 8)) END) AS double) AS c FROM runs r)
SELECT k.total_runs, k.direct_runs, k.paid_runs, k.unchanged + k.direct_runs AS zero_cost_runs,
  round(k.c / k.paid_runs, 6) AS avg_paid_cost, round(k.c / k.paid_runs * k.direct_runs, 4) AS estimated_saving FROM k
""")
def a28_totals(t):
    return B.coverage(t.runs)["totals"]


_COVER = """SELECT a.title, a.city, count(p.id) AS n_plans, count_if(coalesce(p.current_price, 0) <> 0) AS priced,
  count_if(p.area_sqft > 0) AS with_sqft, count_if(p.name IS NOT NULL AND lower(p.name) NOT IN
  ('unit','favorite','tour','tour now','view details','available','available now','select','share','save','')) AS clean_name
FROM apartments a LEFT JOIN plans p ON p.apartment_id = a.id"""


@query("a29_coverage_by_apartment", f"""
{_COVER} GROUP BY a.id, a.title, a.city
UNION ALL SELECT 'TOTAL', '', cast(sum(n_plans) AS bigint), cast(sum(priced) AS bigint), cast(sum(with_sqft) AS bigint),
  cast(sum(clean_name) AS bigint) FROM ({_COVER} GROUP BY a.id, a.title, a.city) z
""")
def a29(t):
    return S.coverage_by_apartment(t.plans, t.apartments)


@query("a30_plan_envelope", """
SELECT p.apartment_id, min(p.price) AS min_price, max(p.price) AS max_price, min(p.bedrooms) AS min_beds, max(p.bedrooms) AS max_beds,
  count(p.id) AS plan_count, count_if(p.is_available) AS available_count, min(abs(p.price - 2000)) AS price_diff
FROM plans p GROUP BY p.apartment_id
""")
def a30(t):
    return t.plans.groupBy("apartment_id").agg(
        *L.plan_envelope(), F.count("id").alias("plan_count"), count_if(F.col("is_available")).alias("available_count"),
        F.min(F.abs(F.col("price") - 2000)).alias("price_diff"),
    )


@query("a31_thirty_day_low_plan", """
SELECT h.plan_id, min(h.price) AS low FROM price_history h WHERE h.recorded_at >= @ts'2001-10-06 00:00:00' GROUP BY h.plan_id
""")
def a31(t):
    return H.thirty_day_low(t.price_history, t.plans, AS_OF, "plan")


@query("a31_thirty_day_low_apartment", """
SELECT p.apartment_id, min(h.price) AS low FROM price_history h JOIN plans p ON p.id = h.plan_id
WHERE h.recorded_at >= @ts'2001-10-06 00:00:00' GROUP BY p.apartment_id
""")
def a31_apartment(t):
    return H.thirty_day_low(t.price_history, t.plans, AS_OF, "apartment")


@query("a32_plan_price_envelope", """
SELECT u.plan_id, min(u.price) AS price, nullif(max(u.price), min(u.price)) AS max_price FROM units u GROUP BY u.plan_id
""")
def a32(t):
    return folds.price_envelope(t.units, "plan_id", "price")


@query("a33_dominant_price", """
WITH c AS (SELECT s.apartment_id, s.min_price, count(*) AS n FROM snapshot s WHERE s.min_price IS NOT NULL GROUP BY 1, 2)
SELECT c.apartment_id, cast(sum(c.n) AS bigint) AS priced, max(c.n) AS most_common FROM c GROUP BY c.apartment_id
HAVING sum(c.n) >= 4 AND max(c.n) / sum(c.n) > 0.5
""")
def a33(t):
    return Q.dominant_price(t.snapshot)


@query("a34_dominant_price_pair", """
WITH c AS (SELECT s.apartment_id, s.min_price, s.max_price, count(*) AS n FROM snapshot s
  WHERE s.min_price IS NOT NULL AND s.max_price IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT c.apartment_id, sum(c.n) AS total, count(*) AS pairs FROM c GROUP BY 1),
z AS (SELECT s.apartment_id, count(*) AS plans FROM snapshot s GROUP BY 1)
SELECT c.apartment_id, c.min_price, c.max_price FROM c JOIN k ON k.apartment_id = c.apartment_id
JOIN z ON z.apartment_id = c.apartment_id WHERE c.n / k.total > 0.5 AND k.pairs > 1 AND z.plans >= 2
""")
def a34(t):
    return Q.dominant_pair(t.snapshot)


@query("a35_dominant_name_batches", """
SELECT s.apartment_id, s.pos, s.name FROM snapshot s WHERE s.apartment_id NOT IN (
  SELECT c.apartment_id FROM (SELECT x.apartment_id, x.name, count(*) AS n FROM snapshot x GROUP BY 1, 2) c
  GROUP BY c.apartment_id HAVING sum(c.n) >= 3 AND max(c.n) / sum(c.n) > 0.5)
""")
def a35(t):
    return Q.drop_dominant_name(t.snapshot).select("apartment_id", "pos", "name")


@query("a36_first_wins_fold", """
WITH g AS (SELECT s.*, row_number() OVER (PARTITION BY s.apartment_id, s.name ORDER BY s.min_price NULLS LAST, s.pos) AS rn FROM snapshot s)
SELECT g.apartment_id, g.name, max(CASE WHEN g.rn = 1 THEN g.min_price END) AS price,
  max(CASE WHEN g.rn = 1 THEN g.availability END) AS availability,
  arg_min(g.size_sqft, g.pos) FILTER (WHERE g.size_sqft IS NOT NULL) AS size_sqft,
  arg_min(g.bedrooms, g.pos) FILTER (WHERE g.bedrooms IS NOT NULL) AS bedrooms,
  arg_min(g.bathrooms, g.pos) FILTER (WHERE g.bathrooms IS NOT NULL) AS bathrooms
FROM g GROUP BY g.apartment_id, g.name
""")
def a36(t):
    return folds.first_wins(t.snapshot, ["apartment_id", "name"], "pos", "min_price", "availability")


@query("a37_available_fold", """
SELECT s.apartment_id, s.name, min(CASE WHEN lower(coalesce(s.availability, '')) NOT LIKE '%waitlist%' AND
    lower(coalesce(s.availability, '')) NOT LIKE '%unavailable%' THEN s.min_price END) AS price,
  bool_or(lower(coalesce(s.availability, '')) NOT LIKE '%waitlist%' AND lower(coalesce(s.availability, '')) NOT LIKE '%unavailable%')
    AS is_available,
  arg_min(s.size_sqft, s.pos) FILTER (WHERE s.size_sqft IS NOT NULL) AS size_sqft,
  max(CASE WHEN s.pos = m.p THEN s.bedrooms END) AS bedrooms, max(CASE WHEN s.pos = m.p THEN s.bathrooms END) AS bathrooms
FROM snapshot s JOIN (SELECT x.apartment_id, x.name, min(x.pos) AS p FROM snapshot x GROUP BY 1, 2) m
  ON m.apartment_id = s.apartment_id AND m.name = s.name GROUP BY s.apartment_id, s.name
""")
def a37(t):
    flagged = t.snapshot.withColumn("avail", S.availability_flag(F.col("availability")))
    return folds.cheapest_available(flagged, ["apartment_id", "name"], "pos", "min_price", "avail")


@query("a38_apartment_summary", """
SELECT a.id, count(p.id) AS plan_count, count_if(p.is_available) AS available_count,
  min(CASE WHEN p.price > 0 THEN p.price END) AS min_price, max(CASE WHEN p.price > 0 THEN p.price END) AS max_price,
  coalesce(min(p.bedrooms), 0) AS min_beds, coalesce(max(p.bedrooms), 0) AS max_beds
FROM apartments a LEFT JOIN plans p ON p.apartment_id = a.id GROUP BY a.id
""")
def a38(t):
    return L.apartment_summary(t.apartments, t.plans).select(
        "id", "plan_count", "available_count", "min_price", "max_price", "min_beds", "max_beds"
    )


@query("a39_last_seen", """
SELECT a.id, coalesce(max(h.recorded_at), max(a.last_scraped_at)) AS latest FROM apartments a
LEFT JOIN plans p ON p.apartment_id = a.id LEFT JOIN price_history h ON h.plan_id = p.id GROUP BY a.id
""")
def a39(t):
    return H.last_seen(t.apartments, t.plans, t.price_history)


@query("a40_top_discovery_cities", """
SELECT c.city, count(*) AS n FROM candidates c GROUP BY c.city ORDER BY n DESC, c.city LIMIT 10
""")
def a40(t):
    return S.count_by(t.candidates, "city").orderBy(F.desc("n"), "city").limit(10)


@query("a41_batch_summary", """
SELECT CASE WHEN r.outcome IN ('success','cache_hit','platform_direct','platform_direct_static','platform_direct_rendered',
  'content_unchanged') THEN 'success' ELSE 'failed' END AS result, r.outcome, count(*) AS n FROM runs r GROUP BY 1, 2
""")
def a41(t):
    result = F.when(F.col("outcome").isin(*B.DELIVERED), "success").otherwise("failed")
    return t.runs.groupBy(result.alias("result"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("a42_batch_yield", f"""
WITH z AS ({_COVER} GROUP BY a.id, a.title, a.city)
SELECT count_if(z.n_plans > 0) AS with_plans, count(*) AS listings, cast(sum(z.n_plans) AS bigint) AS plans,
  cast(sum(z.priced) AS bigint) AS priced, cast(100 * sum(z.priced) // sum(z.n_plans) AS bigint) AS priced_pct,
  cast(sum(z.with_sqft) AS bigint) AS with_sqft, cast(100 * sum(z.with_sqft) // sum(z.n_plans) AS bigint) AS sqft_pct FROM z
""")
def a42(t):
    return S.batch_yield(t.apartments, t.plans)


@query("a43_reclassification_check", """
SELECT count_if(a.data_source_type = 'legal_block') AS legal_block, count_if(a.data_source_type = 'unscrapeable')
  AS unscrapeable_visible, count_if(a.data_source_type = 'brand_site' OR a.data_source_type IS NULL) AS scrapeable
FROM apartments a WHERE a.is_available
""")
def a43(t):
    return S.reclassification_check(t.apartments)


@query("a44_rollup_from_plans", """
WITH s AS (SELECT x.*, lower(coalesce(x.availability, '')) NOT LIKE '%waitlist%' AND lower(coalesce(x.availability, ''))
  NOT LIKE '%unavailable%' AS live FROM snapshot x)
SELECT s.apartment_id, min(CASE WHEN s.live AND s.min_price <> 0 THEN s.min_price END) AS current_price,
  coalesce(min(CASE WHEN s.live THEN s.bedrooms END), 1) AS bedrooms, coalesce(min(s.bathrooms), 1) AS bathrooms,
  min(CASE WHEN s.live AND s.min_price <> 0 THEN s.min_price END) IS NOT NULL AS is_available FROM s GROUP BY s.apartment_id
""")
def a44(t):
    return S.rollup_from_plans(t.snapshot)


@query("a45_price_range_for_beds", """
SELECT a.id, coalesce(min(CASE WHEN p.is_available AND p.bedrooms IN (1, 4) THEN p.price END),
    min(CASE WHEN p.price > 0 THEN p.price END)) AS min_price,
  coalesce(max(CASE WHEN p.is_available AND p.bedrooms IN (1, 4) THEN p.price END), max(CASE WHEN p.price > 0 THEN p.price END))
    AS max_price FROM apartments a LEFT JOIN plans p ON p.apartment_id = a.id GROUP BY a.id
""")
def a45(t):
    return L.price_range_for_beds(L.apartment_summary(t.apartments, t.plans), t.plans, [1, 4])


@query("a46_market_position", """
WITH pr AS (SELECT p.*, row_number() OVER (PARTITION BY p.apartment_id ORDER BY p.price, p.id) AS rn FROM plans p
  WHERE p.is_available AND p.price IS NOT NULL),
m AS (SELECT a.city, p.bedrooms, count(*) AS n, quantile_cont(p.price, 0.5) AS med FROM plans p JOIN apartments a
  ON a.id = p.apartment_id WHERE p.is_available AND a.is_available AND p.price IS NOT NULL GROUP BY 1, 2)
SELECT pr.apartment_id, a.city, pr.bedrooms, pr.price, m.med AS city_median, coalesce(m.n, 0) AS city_plan_count,
  CASE WHEN m.med > 0 THEN round((pr.price - m.med) / m.med, 4) END AS pct_vs_median
FROM pr JOIN apartments a ON a.id = pr.apartment_id LEFT JOIN m ON m.city = a.city AND m.bedrooms = pr.bedrooms WHERE pr.rn = 1
""")
def a46(t):
    return S.market_position(t.plans, t.apartments)


@query("a47_total_plans", """
SELECT count(*) AS total_plans FROM plans p JOIN apartments a ON a.id = p.apartment_id WHERE a.title NOT ILIKE '%senior%'
""")
def a47(t):
    listed = L.filter_listings(t.apartments, t.plans, include_unscrapeable=True)
    return L.apartment_summary(listed, t.plans).agg(F.sum("plan_count").alias("total_plans"))


@query("a49_net_new_by_city", """
SELECT c.city, count(*) AS n FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM apartments a WHERE rtrim(trim(coalesce(a.source_url, '')), '/')
      = rtrim(trim(coalesce(c.source_url, '')), '/') AND rtrim(trim(coalesce(a.source_url, '')), '/') <> '')
  AND NOT EXISTS (SELECT 1 FROM apartments a WHERE a.external_id = c.external_id) GROUP BY c.city
""")
def a49(t):
    return S.count_by(M.not_known(t.candidates, t.apartments), "city")
