"""Sorts, limits and top-k."""

from pyspark.sql import functions as F

from rentscope.operators import history as H
from rentscope.operators import listings as L
from rentscope.plans.filters import AS_OF
from rentscope.plans.registry import query


@query("o01_top_drops", """
WITH w AS (SELECT h.plan_id, h.price,
  row_number() OVER (PARTITION BY h.plan_id ORDER BY h.recorded_at DESC, h.seq DESC, h.line DESC) AS d,
  row_number() OVER (PARTITION BY h.plan_id ORDER BY h.recorded_at, h.seq, h.line) AS u
  FROM price_history h WHERE h.recorded_at >= @ts'2001-08-07 00:00:00')
SELECT x.plan_id, p.apartment_id, a.title AS apartment_title, p.name AS plan_name, y.price AS previous_price, x.price AS current_price,
  round((y.price - x.price) / y.price * 100, 1) AS drop_pct
FROM w x JOIN w y ON x.plan_id = y.plan_id JOIN plans p ON p.id = x.plan_id JOIN apartments a ON a.id = p.apartment_id
WHERE x.d = 1 AND y.u = 1 AND x.price < y.price AND p.is_available
ORDER BY (y.price - x.price) / y.price * 100 DESC, x.plan_id LIMIT 20
""")
def o01(t):
    return H.top_drops(t.price_history, t.plans, t.apartments, AS_OF, days=90, limit=20)


@query("o02_cheapest", """
SELECT p.id AS plan_id, p.apartment_id, a.title AS apartment_title, p.name AS plan_name, p.price, p.bedrooms, p.area_sqft
FROM plans p JOIN apartments a ON a.id = p.apartment_id WHERE p.is_available AND p.price IS NOT NULL AND p.bedrooms = 2
ORDER BY p.price, p.id LIMIT 10
""")
def o02(t):
    return L.cheapest(t.plans, t.apartments, bedrooms=2, limit=10)


_PRICED = """SELECT a.id, m.min_price FROM apartments a LEFT JOIN (SELECT p.apartment_id, min(p.price) AS min_price FROM plans p
  WHERE p.is_available AND p.price IS NOT NULL GROUP BY 1) m ON m.apartment_id = a.id"""


@query("o03_price_ascending", f"{_PRICED} ORDER BY coalesce(m.min_price, 999999999), a.id")
def o03(t):
    return L.sort_listings(t.apartments, t.plans, "price_asc").select("id", "min_price")


@query("o03_price_descending", f"{_PRICED} ORDER BY coalesce(m.min_price, 0) DESC, a.id")
def o03_desc(t):
    return L.sort_listings(t.apartments, t.plans, "price_desc").select("id", "min_price")


@query("o04_newest_updated", "SELECT a.id, a.updated_at FROM apartments a ORDER BY a.updated_at DESC, a.id")
def o04(t):
    return L.sort_listings(t.apartments, t.plans, "updated_desc").select("id", "updated_at")


@query("o04_by_name", "SELECT a.id, a.title FROM apartments a ORDER BY a.title, a.id")
def o04_name(t):
    return L.sort_listings(t.apartments, t.plans, "name_asc").select("id", "title")


@query("o05_second_page", f"{_PRICED} ORDER BY coalesce(m.min_price, 999999999), a.id LIMIT 20 OFFSET 20")
def o05(t):
    return L.page(L.sort_listings(t.apartments, t.plans, "price_asc").select("id", "min_price"), 20, 20)


@query("o06_similar_top_five", """
WITH tgt AS (SELECT p.bedrooms, p.price, a.state AS city FROM plans p JOIN apartments a ON a.id = p.apartment_id
  WHERE p.apartment_id = 3 AND p.is_available AND p.price IS NOT NULL ORDER BY p.price, p.id LIMIT 1)
SELECT a.id, a.title, min(abs(m.price - tgt.price)) AS price_diff FROM tgt JOIN apartments a ON a.state = tgt.city
JOIN plans m ON m.apartment_id = a.id WHERE a.id <> 3 AND a.is_available AND m.is_available AND m.bedrooms = tgt.bedrooms
  AND m.price BETWEEN tgt.price * 0.75 AND tgt.price * 1.25
GROUP BY a.id, a.title ORDER BY price_diff, a.id LIMIT 5
""")
def o06(t):
    return L.similar(t.apartments.withColumn("city", F.col("state")), t.plans, 3).select("id", "title", "price_diff")


@query("o07_primary_plans", """
SELECT r.apartment_id, r.id AS plan_id, r.bedrooms, r.price FROM (SELECT p.*, row_number() OVER (PARTITION BY p.apartment_id
  ORDER BY p.price, p.id) AS rn FROM plans p WHERE p.is_available AND p.price IS NOT NULL) r WHERE r.rn = 1
""")
def o07(t):
    return L.primary_plans(t.plans)


_ONE_BED = """SELECT p.id AS plan_id, p.price, p.name AS plan_name, a.title AS apartment_title, a.city FROM plans p
  JOIN apartments a ON a.id = p.apartment_id WHERE p.is_available AND p.price IS NOT NULL AND p.bedrooms = 1"""


@query("o08_cheapest_one_bed", f"""
SELECT * FROM (SELECT * FROM (SELECT x.*, 0 AS pri FROM ({_ONE_BED} AND lower(a.city) = 'nation_15') x
  UNION ALL SELECT x.*, 1 FROM ({_ONE_BED}) x) y ORDER BY y.pri, y.price, y.plan_id LIMIT 1)
""".replace("SELECT * FROM (SELECT * FROM", "SELECT plan_id, price, plan_name, apartment_title, city FROM (SELECT * FROM"))
def o08(t):
    return L.cheapest_one_bed(t.plans, t.apartments, "Nation_15")


@query("o08_cheapest_one_bed_fallback", f"{_ONE_BED} ORDER BY p.price, p.id LIMIT 1")
def o08_fallback(t):
    return L.cheapest_one_bed(t.plans, t.apartments, "Nowhere")


@query("o09_newest_then_ascending", """
SELECT x.id, x.run_at FROM (SELECT r.id, r.run_at FROM runs r ORDER BY r.run_at DESC, r.id DESC LIMIT 25) x ORDER BY x.run_at, x.id
""")
def o09(t):
    return t.runs.select("id", "run_at").orderBy(F.desc("run_at"), F.desc("id")).limit(25).orderBy("run_at", "id")


@query("o10_seeded_sample")
def o10(t):
    seed = 7
    return t.candidates.select("seq", "title").orderBy(F.xxhash64("seq", F.lit(seed)), "seq").limit(20)


@query("o11_plan_groups", """
WITH k AS (SELECT p.*, cast(floor(p.area_sqft + 0.5) AS bigint) AS sqft_key FROM plans p),
g AS (SELECT k.apartment_id, k.bedrooms, k.bathrooms, k.sqft_key, min(k.price) AS group_price, count(*) AS n_options,
  arg_min(k.name, k.id) AS group_name FROM k GROUP BY 1, 2, 3, 4)
SELECT g.*, k.id AS plan_id, k.price FROM k JOIN g ON g.apartment_id = k.apartment_id AND g.bedrooms IS NOT DISTINCT FROM k.bedrooms
  AND g.bathrooms IS NOT DISTINCT FROM k.bathrooms AND g.sqft_key IS NOT DISTINCT FROM k.sqft_key
""")
def o11(t):
    return L.plan_groups(t.plans)


@query("o12_price_rows", """
SELECT 'u-' || cast(u.id AS string) AS row_key, p.id AS plan_id, u.price, u.available_from, p.external_url
FROM plans p JOIN units u ON u.plan_id = p.id WHERE u.is_available
UNION ALL SELECT 'p-' || cast(p.id AS string), p.id, coalesce(p.current_price, p.price), p.available_from, p.external_url
FROM plans p WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.plan_id = p.id AND u.is_available)
""")
def o12(t):
    return L.price_rows(t.plans, t.units)


@query("o14_price_series", """
SELECT h.plan_id, h.price, h.recorded_at FROM price_history h WHERE h.plan_id = 42 ORDER BY h.recorded_at, h.seq, h.line
""")
def o14(t):
    return H.series(t.price_history, 42).select("plan_id", "price", "recorded_at")


@query("o15_suppressed_newest_first", """
SELECT s.url, s.last_failed_at, s.last_reason, s.attempt_count FROM suppression s ORDER BY s.last_failed_at DESC, s.url
""")
def o15(t):
    return t.suppression.select("url", "last_failed_at", "last_reason", "attempt_count").orderBy(F.desc("last_failed_at"), "url")


