"""Joins."""

from pyspark.sql import functions as F

from rentscope.functions import urls as U
from rentscope.operators import history as H
from rentscope.operators import listings as L
from rentscope.operators import matching as M
from rentscope.plans.registry import query


@query("j01_plan_to_apartment", """
SELECT p.id AS plan_id, p.name, a.title FROM plans p JOIN apartments a ON a.id = p.apartment_id
""")
def j01(t):
    apts = t.apartments.select(F.col("id").alias("apartment_id"), "title")
    return t.plans.join(apts, "apartment_id").select(F.col("id").alias("plan_id"), "name", "title")


@query("j02_history_chain", """
SELECT h.plan_id, h.price, h.recorded_at, a.city FROM price_history h JOIN plans p ON p.id = h.plan_id
JOIN apartments a ON a.id = p.apartment_id WHERE a.city ILIKE '%nation_1%'
""")
def j02(t):
    apts = t.apartments.where(F.col("city").ilike("%nation_1%")).select(F.col("id").alias("apartment_id"), "city")
    plans = t.plans.select(F.col("id").alias("plan_id"), "apartment_id").join(apts, "apartment_id")
    return t.price_history.join(plans, "plan_id").select("plan_id", "price", "recorded_at", "city")


@query("j03_first_and_last", """
SELECT h.plan_id, arg_min(h.price, (h.recorded_at, h.seq, h.line)) AS previous_price, arg_max(h.price, (h.recorded_at, h.seq, h.line)) AS current_price
FROM price_history h GROUP BY h.plan_id
""")
def j03(t):
    return H.first_and_last(t.price_history)


@query("j04_left_join_min_price", """
SELECT a.id, m.min_price FROM apartments a LEFT JOIN (SELECT p.apartment_id, min(p.price) AS min_price FROM plans p
WHERE p.is_available AND p.price IS NOT NULL GROUP BY p.apartment_id) m ON m.apartment_id = a.id
""")
def j04(t):
    return L.with_min_price(t.apartments, t.plans).select("id", "min_price")


@query("j05_semi_join", """
SELECT a.id, a.title FROM apartments a WHERE a.id IN (SELECT p.apartment_id FROM plans p WHERE p.price <= 1400)
""")
def j05(t):
    return L.having_plan(t.apartments, t.plans, F.col("price") <= 1400).select("id", "title")


@query("j06_anti_join_url_or_id", r"""
SELECT c.seq, c.title FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM apartments a WHERE rtrim(trim(coalesce(a.source_url, '')), '/')
      = rtrim(trim(coalesce(c.source_url, '')), '/') AND rtrim(trim(coalesce(a.source_url, '')), '/') <> '')
  AND NOT EXISTS (SELECT 1 FROM apartments a WHERE a.external_id = c.external_id)
""")
def j06(t):
    return M.not_known(t.candidates, t.apartments).select("seq", "title")


_KNOWN = ("host1.example.com", "avalon7.example.com")


@query("j07_anti_join_domain", r"""
WITH c AS (SELECT d.seq, d.title, regexp_replace(regexp_extract(lower(trim(d.source_url)), '^[a-z]+://([^/?#]*)', 1),
    '^www\.', '') AS domain FROM candidates d WHERE trim(d.source_url) LIKE 'http%'),
k AS (SELECT regexp_replace(regexp_extract(lower(a.source_url), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS domain
  FROM apartments a WHERE a.source_url IS NOT NULL
  UNION SELECT 'host1.example.com' UNION SELECT 'avalon7.example.com')
SELECT x.domain, x.seq, x.title FROM (SELECT c.*, row_number() OVER (PARTITION BY c.domain ORDER BY c.seq) AS rn FROM c
  WHERE c.domain NOT IN (SELECT k.domain FROM k)) x WHERE x.rn = 1
""")
def j07(t):
    known = t.spark.createDataFrame([(d,) for d in _KNOWN], "domain string")
    return M.first_of_new_domain(t.candidates, t.apartments, known, "seq").select("domain", "seq", "title")


@query("j08_similar_double_join", """
WITH tgt AS (SELECT p.bedrooms, p.price, a.state AS city FROM plans p JOIN apartments a ON a.id = p.apartment_id
  WHERE p.apartment_id = 3 AND p.is_available AND p.price IS NOT NULL ORDER BY p.price, p.id LIMIT 1)
SELECT a.id, a.title, a.state AS city, min(q.price) AS min_price, max(q.price) AS max_price, min(q.bedrooms) AS min_beds,
  max(q.bedrooms) AS max_beds, count(q.id) AS plan_count,
  cast(sum(CASE WHEN q.is_available THEN 1 ELSE 0 END) AS bigint) AS available_count,
  min(abs(m.price - tgt.price)) AS price_diff
FROM tgt JOIN apartments a ON a.state = tgt.city JOIN plans m ON m.apartment_id = a.id JOIN plans q ON q.apartment_id = a.id
WHERE a.id <> 3 AND a.is_available AND m.is_available AND m.bedrooms = tgt.bedrooms
  AND m.price BETWEEN tgt.price * 0.75 AND tgt.price * 1.25
GROUP BY a.id, a.title, a.state
""")
def j08(t):
    return L.similar(t.apartments.withColumn("city", F.col("state")), t.plans, 3, limit=None).select(
        "id", "title", "city", "min_price", "max_price", "min_beds", "max_beds", "plan_count", "available_count", "price_diff"
    )


@query("j10_latest_with_ties", """
SELECT h.plan_id, h.price FROM price_history h JOIN (SELECT g.plan_id, max(g.recorded_at) AS m FROM price_history g
GROUP BY g.plan_id) x ON x.plan_id = h.plan_id AND x.m = h.recorded_at
""")
def j10(t):
    return H.newest_with_ties(t.price_history).select("plan_id", "price")


@query("j11_unique_within_five", """
SELECT s.apartment_id, s.pos, min(p.id) AS plan_id FROM snapshot s JOIN plans p ON p.apartment_id = s.apartment_id
  AND p.bedrooms = s.bedrooms AND p.is_available AND abs(p.area_sqft - s.size_sqft) <= 5
GROUP BY s.apartment_id, s.pos HAVING count(*) = 1
""")
def j11(t):
    return M.unique_within(t.snapshot, t.plans)


# The pairing row by row: a step takes the next named row of each listing and the first plan that fits and is still free.
RENAMED = """ro AS (SELECT s.apartment_id, s.name, row_number() OVER (PARTITION BY s.apartment_id ORDER BY s.pos) AS rn,
    list_sort(list(p.id) FILTER (p.id IS NOT NULL)) AS fits FROM {source} s JOIN apartments a ON a.id = s.apartment_id
    AND (contains(lower(a.source_url), 'avalon') OR contains(lower(a.source_url), 'host'))
  LEFT JOIN plans p ON p.apartment_id = s.apartment_id AND p.bedrooms IS NOT DISTINCT FROM s.bedrooms AND p.is_available AND p.area_sqft > 0
    AND regexp_matches(p.name, '(?i)^\\s*(studio|[0-9]+)\\s*(bed)?(room)?s?\\s*[/-]\\s*[0-9]+\\s*bath') AND abs(p.area_sqft - s.size_sqft) / p.area_sqft <= 0.05
  WHERE s.name <> '' AND s.size_sqft > 0 AND NOT regexp_matches(s.name, '(?i)^\\s*(studio|[0-9]+)\\s*(bed)?(room)?s?\\s*[/-]\\s*[0-9]+\\s*bath')
  GROUP BY s.apartment_id, s.pos, s.name),
rs AS (SELECT DISTINCT ro.apartment_id, cast(0 AS bigint) AS rn, cast(NULL AS varchar) AS new_name, cast(NULL AS bigint) AS plan_id, cast([] AS bigint[]) AS used FROM ro
  UNION ALL SELECT x.apartment_id, x.rn, x.name, x.pick, CASE WHEN x.pick IS NULL THEN x.used ELSE list_append(x.used, x.pick) END
  FROM (SELECT ro.apartment_id, ro.rn, ro.name, rs.used, list_filter(coalesce(ro.fits, []), lambda f: NOT list_contains(rs.used, f))[1] AS pick
    FROM rs JOIN ro ON ro.apartment_id = rs.apartment_id AND ro.rn = rs.rn + 1) x),
rg AS (SELECT rs.plan_id, rs.new_name FROM rs WHERE rs.plan_id IS NOT NULL)"""


@query("j12_greedy_rename", f"WITH RECURSIVE {RENAMED.format(source='snapshot')} SELECT rg.plan_id, rg.new_name FROM rg")
def j12(t):
    return M.rename_generic(t.snapshot, t.plans, t.apartments, hosts=("avalon", "host"))


_FUZZY = """
SELECT s.apartment_id, s.pos, coalesce(n.id, z.id) AS plan_id,
  CASE WHEN n.id IS NOT NULL THEN 'name' WHEN z.id IS NOT NULL THEN 'size' END AS matched_by
FROM snapshot s
LEFT JOIN (SELECT p.apartment_id, p.name, min(p.id) AS id FROM plans p GROUP BY p.apartment_id, p.name) n
  ON n.apartment_id = s.apartment_id AND n.name = s.name
LEFT JOIN (SELECT x.apartment_id, x.pos, min(p.id) AS id FROM snapshot x JOIN plans p ON p.apartment_id = x.apartment_id
  AND p.bedrooms = x.bedrooms AND p.area_sqft > 0 AND abs(p.area_sqft - x.size_sqft) / {base} < 0.10
  GROUP BY x.apartment_id, x.pos) z ON z.apartment_id = s.apartment_id AND z.pos = s.pos
"""


@query("j13_name_or_near_stored_size", _FUZZY.format(base="p.area_sqft"))
def j13(t):
    return M.name_or_near_size(t.snapshot, t.plans, "stored")


@query("j14_name_or_near_incoming_size", _FUZZY.format(base="x.size_sqft"))
def j14(t):
    return M.name_or_near_size(t.snapshot, t.plans, "incoming")


@query("j15_registry_by_domain", """
SELECT a.id, r.domain, r.data_source_type AS registry_type FROM apartments a JOIN registry r
ON r.domain = lower(regexp_extract(a.source_url, '^[a-z]+://([^/?#]*)', 1)) WHERE r.is_active
""")
def j15(t):
    r = t.registry.withColumnRenamed("data_source_type", "registry_type")
    return M.registry_for(t.apartments, r).select("id", "domain", "registry_type")


@query("j16_url_contains_domain", """
SELECT a.id, r.domain FROM apartments a JOIN registry r ON contains(lower(a.source_url), r.domain)
""")
def j16(t):
    apts = t.apartments.select("id", F.lower("source_url").alias("u"))
    return M.contains_join(apts, "u", t.registry.select("domain"), "domain").select("id", "domain")


@query("j17_patch_relative_urls", r"""
SELECT p.id, CASE WHEN p.external_url IS NOT NULL AND p.external_url <> '' AND p.external_url NOT LIKE 'http%'
    AND a.source_url IS NOT NULL
  THEN regexp_replace(a.source_url, '^(https?://[^/]+).*$', '\1')
    || CASE WHEN p.external_url LIKE '/%' THEN p.external_url ELSE '/' || p.external_url END
  ELSE nullif(p.external_url, '') END AS external_url
FROM plans p LEFT JOIN apartments a ON a.id = p.apartment_id
""")
def j17(t):
    base = t.apartments.select(F.col("id").alias("apartment_id"), "source_url")
    return t.plans.join(base, "apartment_id", "left").select(
        "id", U.absolute_url(F.col("source_url"), F.col("external_url")).alias("external_url")
    )


@query("j19_favourites_newest_first", """
SELECT a.id, a.title, f.created_at, f.fav_id FROM favourites f JOIN apartments a ON a.id = f.apartment_id WHERE f.user_id = 5
ORDER BY f.created_at DESC, f.fav_id DESC
""")
def j19(t):
    return L.favourites(t.favourites, t.apartments, 5).select("id", "title", "created_at", "fav_id")


@query("j20_left_join_child_count", """
SELECT a.id, a.title, count(p.id) AS plans FROM apartments a LEFT JOIN plans p ON p.apartment_id = a.id
WHERE a.title ILIKE '%avalon%' OR a.title ILIKE '%lakeside%' OR a.title ILIKE '%supplier%' GROUP BY a.id, a.title
""")
def j20(t):
    per = t.plans.groupBy(F.col("apartment_id").alias("id")).agg(F.count(F.lit(1)).alias("plans"))
    named = t.apartments.where(
        F.col("title").ilike("%avalon%") | F.col("title").ilike("%lakeside%") | F.col("title").ilike("%supplier%")
    )
    return named.join(per, "id", "left").select("id", "title", F.coalesce("plans", F.lit(0)).alias("plans"))


@query("j21_active_children", """
SELECT a.id, a.title, a.data_source_type,
  (SELECT count(*) FROM plans p WHERE p.apartment_id = a.id AND p.is_available) AS active_plans FROM apartments a
""")
def j21(t):
    per = t.plans.where("is_available").groupBy(F.col("apartment_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return t.apartments.join(per, "id", "left").select(
        "id", "title", "data_source_type", F.coalesce("n", F.lit(0)).alias("active_plans")
    )


@query("j22_natural_key_chain", """
SELECT a.id AS apartment_id, h.price, h.recorded_at FROM price_history h
JOIN (SELECT x.id AS listing_id, 'ext_' || cast(x.id % 120 AS string) AS external_id FROM plans x) l ON h.plan_id = l.listing_id
JOIN apartments a ON a.external_id = l.external_id
""")
def j22(t):
    listings = t.plans.select(F.col("id").alias("plan_id"), F.concat(F.lit("ext_"), F.col("id") % 120).alias("external_id"))
    keyed = listings.join(t.apartments.select(F.col("id").alias("apartment_id"), "external_id"), "external_id")
    return t.price_history.join(keyed, "plan_id").select("apartment_id", "price", "recorded_at")


@query("j24_with_plans", """
SELECT DISTINCT a.id, a.title, a.source_url FROM apartments a JOIN plans p ON p.apartment_id = a.id
WHERE a.is_available AND a.source_url IS NOT NULL AND a.title NOT ILIKE '%senior%' ORDER BY a.id
""")
def j24(t):
    kept = t.apartments.where(
        F.col("is_available") & F.col("source_url").isNotNull() & ~F.col("title").ilike("%senior%")
    )
    return L.having_plan(kept, t.plans, F.lit(True)).select("id", "title", "source_url").orderBy("id")


@query("j25_rekey_to_children", """
WITH ph AS (SELECT f.apartment_id, cast(f.fav_id % 5000 AS double) AS price, f.created_at AS recorded_at FROM favourites f)
SELECT p.id AS plan_id, ph.price, ph.recorded_at FROM ph JOIN plans p ON p.apartment_id = ph.apartment_id
""")
def j25(t):
    parent = t.favourites.select("apartment_id", (F.col("fav_id") % 5000).cast("double").alias("price"),
                                 F.col("created_at").alias("recorded_at"))
    return H.rekey_to_plans(parent, t.plans)


@query("j25_rekey_to_parent", """
SELECT p.apartment_id, h.price, h.recorded_at FROM price_history h JOIN plans p ON p.id = h.plan_id
""")
def j25_back(t):
    return H.rekey_to_apartments(t.price_history, t.plans)
