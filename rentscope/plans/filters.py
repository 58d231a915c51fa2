"""Filters and predicates."""

from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.functions import urls as U
from rentscope.operators import listings as L
from rentscope.operators.scale import before, instant
from rentscope.plans.registry import query

AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
# Words and hosts that disqualify a discovered candidate.
HOTEL_WORDS = ("hotel", "motel", "inn &")
INCOME_WORDS = ("public housing", "housing authority", "affordable")
AGGREGATOR_HOSTS = ("zillow", "apartments.com", "craigslist")


@query("f01_filter_listings", """
SELECT a.id, a.title, a.city FROM apartments a
WHERE a.title NOT ILIKE '%senior%' AND a.city ILIKE '%nation_1%' AND a.has_parking IS TRUE AND a.is_available = true
  AND (a.data_source_type <> 'unscrapeable' OR a.data_source_type IS NULL)
  AND a.id IN (SELECT p.apartment_id FROM plans p WHERE p.bedrooms >= 1 AND p.bedrooms <= 3 AND p.price <= 3000
               AND p.area_sqft >= 300)
""")
def f01(t):
    return L.filter_listings(
        t.apartments, t.plans, city="nation_1", has_parking=True, is_available=True, min_bedrooms=1, max_bedrooms=3,
        max_price=3000, min_sqft=300,
    ).select("id", "title", "city")


@query("f02_city_substring", "SELECT a.id, a.city FROM apartments a WHERE a.city ILIKE '%TION_2%'")
def f02(t):
    return t.apartments.where(P.contains_ci(F.col("city"), "TION_2")).select("id", "city")


@query("f03_not_senior", "SELECT a.id, a.title FROM apartments a WHERE a.title NOT ILIKE '%senior%'")
def f03(t):
    return t.apartments.where(P.not_contains_ci(F.col("title"), "senior")).select("id", "title")


@query("f04_exclusion_list", """
SELECT a.id, a.title FROM apartments a
WHERE a.is_available AND a.source_url IS NOT NULL AND a.title NOT ILIKE '%senior%' AND a.title NOT ILIKE '%affordable%'
  AND a.title NOT ILIKE '%housing authority%' AND a.source_url NOT ILIKE '%avalon%'
""")
def f04(t):
    bad = P.like_any(F.col("title"), ["%senior%", "%affordable%", "%housing authority%"])
    return t.apartments.where(
        F.col("is_available") & F.col("source_url").isNotNull() & ~bad & ~F.col("source_url").ilike("%avalon%")
    ).select("id", "title")


@query("f05_city_equals_any_case", "SELECT a.id, a.city FROM apartments a WHERE lower(a.city) = lower('Nation_3')")
def f05(t):
    return t.apartments.where(P.equals_ci(F.col("city"), "Nation_3")).select("id", "city")


@query("f06_three_valued_bool", """
SELECT a.id, 'pets' AS test FROM apartments a WHERE a.pets_allowed IS TRUE
UNION ALL SELECT a.id, 'no_pets' AS test FROM apartments a WHERE a.pets_allowed IS FALSE
""")
def f06(t):
    a = t.apartments
    yes = a.where(P.is_bool(F.col("pets_allowed"), True)).select("id", F.lit("pets").alias("test"))
    return yes.unionByName(a.where(P.is_bool(F.col("pets_allowed"), False)).select("id", F.lit("no_pets").alias("test")))


@query("f07_plan_ranges", """
SELECT p.id, p.bedrooms, p.price, p.area_sqft FROM plans p
WHERE p.bedrooms >= 1 AND p.price >= 2000 AND p.price <= 4000 AND p.area_sqft <= 900
""")
def f07(t):
    tests = L.plan_conditions(min_bedrooms=1, min_price=2000, max_price=4000, max_sqft=900)
    return t.plans.where(L.all_of(tests)).select("id", "bedrooms", "price", "area_sqft")


@query("f08_available_before", """
SELECT p.id, p.available_from FROM plans p WHERE p.available_from IS NOT NULL AND p.available_from <= @ts'2001-11-20 00:00:00'
""")
def f08(t):
    return t.plans.where(L.available_by(F.col("available_from"), "2001-11-20 00:00:00")).select("id", "available_from")


@query("f09_not_value_or_null", """
SELECT a.id, a.data_source_type FROM apartments a WHERE a.data_source_type <> 'unscrapeable' OR a.data_source_type IS NULL
""")
def f09(t):
    return t.apartments.where(P.not_value_or_null(F.col("data_source_type"), "unscrapeable")).select("id", "data_source_type")


@query("f10_lookback_inclusive", """
SELECT h.plan_id, h.price, h.recorded_at FROM price_history h WHERE h.recorded_at >= @ts'2001-10-06 00:00:00'
""")
def f10(t):
    return t.price_history.where(F.col("recorded_at") >= before(AS_OF, days=30)).select("plan_id", "price", "recorded_at")


@query("f11_lookback_strict", """
SELECT h.plan_id, h.price, h.recorded_at FROM price_history h WHERE h.recorded_at > @ts'2001-10-06 00:00:00'
""")
def f11(t):
    return t.price_history.where(F.col("recorded_at") > before(AS_OF, days=30)).select("plan_id", "price", "recorded_at")


@query("f12_free_text", """
SELECT DISTINCT a.id, a.title, a.city FROM apartments a
WHERE a.title ILIKE '%oak%' OR a.description ILIKE '%oak%' OR a.city ILIKE '%oak%' OR a.zipcode ILIKE '%oak%'
  OR a.address ILIKE '%oak%'
""")
def f12(t):
    return L.search(t.apartments, t.plans, "oak").select("id", "title", "city")


@query("f13_free_text_with_plans", """
SELECT DISTINCT a.id, 'bounded' AS variant FROM apartments a JOIN plans p ON p.apartment_id = a.id
WHERE (a.title ILIKE '%a%' OR a.description ILIKE '%a%' OR a.city ILIKE '%a%' OR a.zipcode ILIKE '%a%'
  OR a.address ILIKE '%a%') AND p.bedrooms >= 0 AND p.price <= 1500
UNION ALL
SELECT DISTINCT a.id, 'zero_bound_only' AS variant FROM apartments a
WHERE a.title ILIKE '%e%' OR a.description ILIKE '%e%' OR a.city ILIKE '%e%' OR a.zipcode ILIKE '%e%' OR a.address ILIKE '%e%'
""")
def f13(t):
    one = L.search(t.apartments, t.plans, "a", min_bedrooms=0, max_price=1500).select("id", F.lit("bounded").alias("variant"))
    two = L.search(t.apartments, t.plans, "e", min_bedrooms=0).select("id", F.lit("zero_bound_only").alias("variant"))
    return one.unionByName(two)


@query("f14_in_lists", """
SELECT p.id, p.name, lower(p.name) IN ('unit', 'tour now', 'select') AS folded FROM plans p
WHERE lower(p.name) IN ('unit', 'tour now', 'select')
   OR (p.name NOT IN ('Unit','Favorite','Tour','Tour Now','Available Now','View Details','Select','Share','Save','')
       AND p.name LIKE 'A%')
""")
def f14(t):
    folded = F.lower("name").isin("unit", "tour now", "select")
    clean = ~F.col("name").isin(*P.UNCLEAN_NAMES) & F.col("name").startswith("A")
    return t.plans.where(folded | clean).select("id", "name", folded.alias("folded"))


@query("f15_like_any", """
SELECT a.id, a.title FROM apartments a WHERE a.title ILIKE '%avalon%' OR a.title ILIKE '%lakeside%' OR a.title ILIKE '%village%'
""")
def f15(t):
    return t.apartments.where(P.like_any(F.col("title"), ["%avalon%", "%lakeside%", "%village%"])).select("id", "title")


@query("f16_regex_match", "SELECT p.id, p.name FROM plans p WHERE regexp_matches(p.name, '^A[0-9]')")
def f16(t):
    return t.plans.where(F.col("name").rlike(r"^A\d")).select("id", "name")


@query("f17_relative_band", "SELECT p.id, p.price FROM plans p WHERE p.price BETWEEN 2000 * 0.75 AND 2000 * 1.25")
def f17(t):
    return t.plans.where(F.col("price").between(2000 * 0.75, 2000 * 1.25)).select("id", "price")


@query("f18_keyword_exclusion", r"""
SELECT c.seq, c.title FROM candidates c
WHERE c.source_url IS NOT NULL AND trim(c.source_url) LIKE 'http%'
  AND regexp_extract(lower(trim(c.source_url)), '^[a-z]+://([^/?#]*)', 1) NOT LIKE '%zillow%'
  AND regexp_extract(lower(trim(c.source_url)), '^[a-z]+://([^/?#]*)', 1) NOT LIKE '%apartments.com%'
  AND regexp_extract(lower(trim(c.source_url)), '^[a-z]+://([^/?#]*)', 1) NOT LIKE '%craigslist%'
  AND lower(c.title) NOT LIKE '%hotel%' AND lower(c.title) NOT LIKE '%motel%' AND lower(c.title) NOT LIKE '%inn &%'
  AND lower(c.title) NOT LIKE '%public housing%' AND lower(c.title) NOT LIKE '%housing authority%'
  AND lower(c.title) NOT LIKE '%affordable%'
""")
def f18(t):
    url = F.trim("source_url")
    return t.candidates.where(
        url.startswith("http") & ~P.mentions_any(U.bare_domain(url), AGGREGATOR_HOSTS)
        & ~P.mentions_any(F.col("title"), HOTEL_WORDS) & ~P.mentions_any(F.col("title"), INCOME_WORDS)
    ).select("seq", "title")


@query("f19_quality_threshold", """
SELECT c.seq, c.rating, c.user_rating_count FROM candidates c
WHERE coalesce(c.rating, 0) >= 4.0 AND coalesce(c.user_rating_count, 0) >= 20
""")
def f19(t):
    return t.candidates.where(P.at_least(F.col("rating"), 4.0) & P.at_least(F.col("user_rating_count"), 20)).select(
        "seq", "rating", "user_rating_count"
    )


@query("f20_client_filters", """
WITH s AS (SELECT p.apartment_id, min(CASE WHEN p.price > 0 THEN p.price END) AS min_price,
  max(CASE WHEN p.price > 0 THEN p.price END) AS max_price, bool_or(p.bedrooms IN (1, 3)) AS beds
  FROM plans p GROUP BY p.apartment_id)
SELECT a.id, a.title, s.min_price, s.max_price FROM apartments a JOIN s ON s.apartment_id = a.id
WHERE lower(a.title) LIKE '%supplier#0%' AND a.city IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_15', 'NATION_20')
  AND s.max_price >= 3000 AND s.min_price <= 2000 AND s.beds
""")
def f20(t):
    summary = L.apartment_summary(t.apartments, t.plans)
    cities = ["NATION_1", "NATION_2", "NATION_3", "NATION_15", "NATION_20"]
    return L.client_filter(summary, t.plans, "Supplier#0", cities, 3000, 2000, [1, 3]).select(
        "id", "title", "min_price", "max_price"
    )


@query("f21_drop_income_restricted", r"""
WITH s AS (SELECT p.apartment_id, count(*) AS n, bool_or(regexp_matches(p.name,
  '\bami\b|\d+%\s*ami|area median income|income.restricted|income.qualified|lihtc|section 8', 'i')) AS hit
  FROM plans p GROUP BY p.apartment_id)
SELECT a.id, a.title, s.n AS plan_count FROM apartments a JOIN s ON s.apartment_id = a.id
WHERE NOT s.hit AND NOT regexp_matches(a.title,
  'housing authority|affordable housing|community development corp|habitat for humanity|public housing', 'i')
""")
def f21(t):
    s = L.apartment_summary(t.apartments, t.plans)
    return s.where((F.col("plan_count") > 0) & ~F.col("income_restricted")).select("id", "title", "plan_count")


@query("f22_stale_or_missing", """
SELECT r.domain, coalesce(r.last_successful_adapter, '-') AS adapter, r.last_adapter_success_at FROM registry r
WHERE r.is_active AND (r.last_adapter_success_at IS NULL OR r.last_adapter_success_at < @ts'2024-01-24 00:00:00')
""")
def f22(t):
    stale = P.stale_or_missing(F.col("last_adapter_success_at"), before(EVENTS_AS_OF, days=7))
    return t.registry.where(F.col("is_active") & stale).select(
        "domain", F.coalesce("last_successful_adapter", F.lit("-")).alias("adapter"), "last_adapter_success_at"
    ).orderBy(F.asc_nulls_first("last_adapter_success_at"), "domain")


@query("f23_active_suppression", """
SELECT s.url, s.attempt_count, s.retry_after FROM suppression s WHERE s.retry_after > @ts'2024-01-31 00:00:00'
""")
def f23(t):
    return t.suppression.where(F.col("retry_after") > instant(EVENTS_AS_OF)).select("url", "attempt_count", "retry_after")


@query("f24_refresh_candidates", """
SELECT a.id, a.source_url FROM apartments a
WHERE a.source_url IS NOT NULL AND a.is_available AND a.data_source_type = 'brand_site'
""")
def f24(t):
    return t.apartments.where(
        F.col("source_url").isNotNull() & F.col("is_available") & (F.col("data_source_type") == "brand_site")
    ).select("id", "source_url")


@query("f25_neighborhoods", """
SELECT DISTINCT a.zipcode AS name, a.city, a.state FROM apartments a WHERE a.city ILIKE '%nation%' AND a.state = 'AS'
""")
def f25(t):
    areas = t.apartments.select(F.col("zipcode").alias("name"), "city", "state")
    return areas.where(P.contains_ci(F.col("city"), "nation") & (F.col("state") == "AS")).distinct()


@query("f26_relative_urls", """
SELECT p.id, p.external_url FROM plans p
WHERE p.external_url IS NOT NULL AND p.external_url <> '' AND p.external_url NOT LIKE 'http%'
""")
def f26(t):
    return t.plans.where(U.is_relative(F.col("external_url"))).select("id", "external_url")


@query("f27_place_types", """
SELECT c.seq, c.title FROM candidates c WHERE c.seq % 5 = 0 OR lower(c.title) LIKE '%apartment%' OR lower(c.title) LIKE '%housing%'
  OR lower(c.title) LIKE '%residence%' OR lower(c.title) LIKE '%complex%'
""")
def f27(t):
    places = t.candidates.withColumn(
        "types", F.when(F.col("seq") % 5 == 0, F.array(F.lit("lodging"), F.lit("point_of_interest")))
        .otherwise(F.array(F.lit("store")))
    )
    typed = F.exists("types", lambda x: F.lower(x).contains("lodging") | F.lower(x).contains("real_estate"))
    named = P.mentions_any(F.col("title"), ("apartment", "housing", "residence", "complex"))
    return places.where(typed | named).select("seq", "title")


@query("f28_missing_coordinates", """
SELECT a.id, CASE WHEN contains(a.address, a.city) THEN a.address
  ELSE a.address || ', ' || a.city || ', ' || a.state END AS full_address
FROM apartments a WHERE (a.latitude IS NULL OR a.longitude IS NULL) AND a.address IS NOT NULL
""")
def f28(t):
    full = F.when(F.col("address").contains(F.col("city")), F.col("address")).otherwise(
        F.concat_ws(", ", "address", "city", "state")
    )
    missing = (F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("address").isNotNull()
    return t.apartments.where(missing).select("id", full.alias("full_address"))
