"""Scalar functions and projections."""

from pyspark.sql import functions as F

from rentscope.functions import checks as C
from rentscope.functions import labels as T
from rentscope.functions import messages as G
from rentscope.functions import urls as U
from rentscope.operators import alerts as A
from rentscope.operators import listings as L
from rentscope.operators import observability as B
from rentscope.operators import stats as S
from rentscope.plans.filters import AS_OF
from rentscope.plans.registry import query

_NUM = "CASE WHEN {x} = floor({x}) THEN cast(cast({x} AS bigint) AS string) ELSE cast({x} AS string) END"
_BEDS, _BATHS = _NUM.format(x="p.bedrooms"), _NUM.format(x="p.bathrooms")


@query("p01_location_label", """
SELECT a.id, CASE WHEN a.address <> '' THEN a.address || ', ' ELSE '' END || a.city || ', ' || a.state AS location FROM apartments a
""")
def p01(t):
    return t.apartments.select("id", T.location_label(F.col("address"), F.col("city"), F.col("state")).alias("location"))


@query("p02_plan_spec", f"""
SELECT p.id, nullif(concat_ws(' / ', CASE WHEN p.bedrooms = 0 THEN 'Studio' ELSE {_BEDS} || ' bed' END, {_BATHS} || ' bath',
  CASE WHEN p.area_sqft <> 0 THEN format('{{:,}}', cast(p.area_sqft AS bigint)) || ' sqft' END), '') AS spec FROM plans p
""")
def p02(t):
    return t.plans.select("id", T.plan_spec(F.col("bedrooms"), F.col("bathrooms"), F.col("area_sqft")).alias("spec"))


@query("p03_plan_spec_short", """
SELECT p.id, nullif(concat_ws(' · ', CASE WHEN p.bedrooms = 0 THEN 'Studio' ELSE cast(cast(p.bedrooms AS bigint) AS string) || 'BR' END,
  cast(cast(p.bathrooms AS bigint) AS string) || 'BA',
  CASE WHEN p.area_sqft <> 0 THEN format('{:,}', cast(p.area_sqft AS bigint)) || ' sqft' END), '') AS spec FROM plans p
""")
def p03(t):
    return t.plans.select("id", T.plan_spec_short(F.col("bedrooms"), F.col("bathrooms"), F.col("area_sqft")).alias("spec"))


@query("p04_drop_pct", """
SELECT p.id, round((p.price - p.current_price) * 100 / p.price, 1) AS drop_pct FROM plans p
""")
def p04(t):
    return t.plans.select("id", T.drop_pct(F.col("price"), F.col("current_price")).alias("drop_pct"))


@query("p05_pct_vs_median", """
SELECT p.id, CASE WHEN p.max_price > 0 THEN round((p.price - p.max_price) / p.max_price, 4) END AS pct FROM plans p
""")
def p05(t):
    return t.plans.select("id", S.fraction_vs_median(F.col("price"), F.col("max_price")).alias("pct"))


@query("p06_url_domain", "SELECT g.page_id, lower(regexp_extract(g.url, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM pages g")
def p06(t):
    return t.pages.select("page_id", U.authority(F.col("url")).alias("domain"))


@query("p07_bare_domain", r"""
SELECT g.page_id, regexp_replace(lower(regexp_extract(g.url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages g
""")
def p07(t):
    return t.pages.select("page_id", U.bare_domain(F.col("url")).alias("domain"))


@query("p08_entity_key", r"""
WITH u AS (SELECT g.page_id, regexp_replace(lower(regexp_extract(g.url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')
    || rtrim(regexp_extract(g.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS base,
  list_sort(list_filter(string_split(regexp_extract(g.url, '\?([^#]*)', 1), '&'),
    lambda x: regexp_matches(x, '=.') AND NOT starts_with(x, 'utm_'))) AS q FROM pages g)
SELECT u.page_id, 'scraper_' || substring(sha256(u.base || CASE WHEN len(u.q) > 0 THEN '?' || array_to_string(u.q, '&') ELSE '' END), 1, 20)
  AS entity_key FROM u
""")
def p08(t):
    return t.pages.select("page_id", U.entity_key(F.col("url")).alias("entity_key"))


@query("p09_host_key_collisions", r"""
SELECT 'scraper_' || regexp_replace(regexp_extract(g.url, '//([^/]*)', 1), '^www\.', '') AS host_key, count(*) AS pages FROM pages g
GROUP BY 1 HAVING count(*) > 1
""")
def p09(t):
    return t.pages.groupBy(U.host_key(F.col("url")).alias("host_key")).agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


@query("p10_cache_key", r"""
SELECT g.page_id, regexp_replace(lower(regexp_extract(g.url, '^[a-z]+://([^/?#]*)', 1)), '[^A-Za-z0-9_]', '_', 'g') || '__'
  || substring(md5(regexp_extract(g.url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), 1, 8) AS cache_key,
  regexp_replace(regexp_extract(g.url, '//([^/]*)', 1), '[^A-Za-z0-9_]', '_', 'g') AS domain_key FROM pages g
""")
def p10(t):
    return t.pages.select(
        "page_id", U.cache_key(F.col("url")).alias("cache_key"), U.domain_cache_key(F.col("url")).alias("domain_key")
    )


@query("p11_norm_url", "SELECT c.seq, rtrim(trim(coalesce(c.source_url, '')), '/') AS url FROM candidates c")
def p11(t):
    return t.candidates.select("seq", U.norm_url(F.col("source_url")).alias("url"))


@query("p12_name_slug", r"""
SELECT a.id, regexp_replace(replace(replace(lower(a.title), ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') AS slug FROM apartments a
""")
def p12(t):
    return t.apartments.select("id", T.name_slug(F.col("title")).alias("slug"))


@query("p13_split_address", """
WITH x AS (SELECT a.id, CASE a.id % 4 WHEN 0 THEN coalesce(a.address, '') ELSE a.city || ' Street, ' || a.city || ', ' || a.state || ' '
  || a.zipcode || ', USA' END AS addr FROM apartments a),
y AS (SELECT x.id, string_split(x.addr, ',') AS q FROM x)
SELECT y.id, CASE WHEN len(y.q) > 2 THEN trim(y.q[len(y.q) - 2]) ELSE '' END AS city,
  CASE WHEN len(y.q) > 1 AND len(string_split(trim(y.q[len(y.q) - 1]), ' ')) >= 2
    THEN string_split(trim(y.q[len(y.q) - 1]), ' ')[1] ELSE '' END AS state,
  CASE WHEN len(y.q) > 1 AND len(string_split(trim(y.q[len(y.q) - 1]), ' ')) >= 2
    THEN string_split(trim(y.q[len(y.q) - 1]), ' ')[2] ELSE '' END AS zipcode FROM y
""")
def p13(t):
    address = F.when(F.col("id") % 4 == 0, F.coalesce("address", F.lit(""))).otherwise(
        F.concat("city", F.lit(" Street, "), "city", F.lit(", "), "state", F.lit(" "), "zipcode", F.lit(", USA"))
    )
    return t.apartments.select("id", *[c.alias(n) for n, c in T.split_address(address).items()])


@query("p15_parse_availability", r"""
WITH s AS (SELECT x.pos, x.availability AS a, date '2001-11-05' AS today,
  regexp_extract(x.availability, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})|([0-9]{4})-([0-9]{2})-([0-9]{2})', ['m','d','y','y2','m2','d2']) AS n,
  regexp_extract(x.availability, '(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?(?:\s+([0-9]{4}))?',
    ['mon','d','y']) AS w FROM snapshot x),
d AS (SELECT s.*, CASE WHEN s.n.m <> '' THEN try_cast(CASE WHEN try_cast(s.n.y AS int) < 100 THEN cast(try_cast(s.n.y AS int) + 2000 AS string)
    ELSE s.n.y END || '-' || s.n.m || '-' || s.n.d AS date)
  WHEN s.n.y2 <> '' THEN try_cast(s.n.y2 || '-' || s.n.m2 || '-' || s.n.d2 AS date) END AS numeric_date,
  CASE WHEN s.w.mon <> '' THEN cast((instr('jan feb mar apr may jun jul aug sep oct nov dec', lower(s.w.mon)) - 1) / 4 + 1 AS int) END AS mo FROM s),
e AS (SELECT d.*, CASE WHEN d.mo IS NOT NULL THEN try_cast(CASE WHEN d.w.y <> '' THEN d.w.y ELSE '2001' END || '-' || cast(d.mo AS string)
  || '-' || d.w.d AS date) END AS first FROM d),
f AS (SELECT e.*, coalesce(e.numeric_date, CASE WHEN e.first < e.today AND e.w.y = '' THEN try_cast('2002-' || cast(e.mo AS string)
  || '-' || e.w.d AS date) ELSE e.first END) AS whn FROM e)
SELECT f.pos, CASE WHEN f.a IS NULL OR f.a = '' THEN true WHEN lower(f.a) LIKE '%waitlist%' THEN false
  WHEN f.whn IS NOT NULL THEN f.whn <= f.today ELSE true END AS is_available,
  CASE WHEN f.a IS NOT NULL AND lower(f.a) NOT LIKE '%waitlist%' AND f.whn > f.today THEN cast(f.whn AS timestamp) END AS available_from FROM f
""")
def p15(t):
    flag, start = T.parse_availability(F.col("availability"), AS_OF)
    return t.snapshot.select("pos", flag.alias("is_available"), start.alias("available_from"))


@query("p16_availability_flag", """
SELECT s.pos, lower(coalesce(s.availability, '')) NOT LIKE '%waitlist%' AND lower(coalesce(s.availability, '')) NOT LIKE '%unavailable%'
  AS is_available FROM snapshot s
""")
def p16(t):
    return t.snapshot.select("pos", S.availability_flag(F.col("availability")).alias("is_available"))


@query("p17_absolute_url", r"""
SELECT p.id, CASE WHEN p.external_url = '' THEN NULL WHEN p.external_url LIKE 'http%' THEN p.external_url
  ELSE 'https://Host.example.com' || CASE WHEN p.external_url LIKE '/%' THEN '' ELSE '/' END || p.external_url END AS url FROM plans p
""")
def p17(t):
    base = F.lit("https://Host.example.com/communities/x?y=1")
    return t.plans.select("id", U.absolute_url(base, F.col("external_url")).alias("url"))


@query("p18_beds_from_plan_code", """
SELECT p.id, CASE WHEN regexp_matches(p.name, '^A[0-9]') THEN 1 WHEN regexp_matches(p.name, '^B[0-9]') THEN 2
  WHEN regexp_matches(p.name, '^C[0-9]') THEN 3 WHEN regexp_matches(p.name, '^S[0-9]') THEN 0 END AS bedrooms FROM plans p
""")
def p18(t):
    return t.plans.select("id", T.beds_from_plan_code(F.col("name")).alias("bedrooms"))


@query("p19_plan_display_name", rf"""
SELECT p.id, CASE WHEN p.name <> '' AND NOT regexp_matches(p.name, '^(Studio|\d+\s*Bed(room)?s?)\s*[/\-]\s*\d+(\.\d+)?\s*Bath', 'i')
  THEN p.name ELSE concat_ws(' / ', CASE WHEN p.bedrooms = 0 THEN 'Studio' WHEN p.bedrooms IS NULL THEN '?' ELSE {_BEDS} || ' Bed' END,
  {_BATHS} || ' Bath', format('{{:,}}', cast(p.area_sqft AS bigint)) || ' sqft') END AS label FROM plans p
""")
def p19(t):
    label = T.plan_display_name(F.col("name"), F.col("bedrooms"), F.col("bathrooms"), F.col("area_sqft"))
    return t.plans.select("id", label.alias("label"))


@query("p20_availability_label", """
WITH s AS (SELECT u.plan_id, min(u.available_from) AS soonest FROM units u WHERE u.is_available AND u.available_from IS NOT NULL GROUP BY 1),
x AS (SELECT p.id, p.is_available, coalesce(p.available_from, s.soonest) AS d FROM plans p LEFT JOIN s ON s.plan_id = p.id)
SELECT x.id, CASE WHEN NOT x.is_available THEN 'Unavailable' WHEN x.d IS NULL OR x.d <= @ts'2001-11-05 00:00:00' THEN 'Now'
  ELSE strftime(x.d, '%-m/%-d') END AS label FROM x
""")
def p20(t):
    soonest = t.units.where(F.col("is_available")).groupBy(F.col("plan_id").alias("id")).agg(F.min("available_from").alias("soonest"))
    starts = F.coalesce("available_from", "soonest")
    return t.plans.join(soonest, "id", "left").select(
        "id", T.availability_label(F.col("is_available"), starts, AS_OF).alias("label")
    )


@query("p21_freshness_label", """
WITH x AS (SELECT a.id, a.last_scraped_at AS ts, date_diff('second', a.last_scraped_at, @ts'2001-11-05 10:30:00') / 3600 AS h FROM apartments a)
SELECT x.id, CASE WHEN x.ts IS NULL THEN NULL WHEN x.h < 1 THEN 'Updated just now'
  WHEN x.h < 24 THEN 'Updated ' || cast(cast(floor(x.h + 0.5) AS bigint) AS string) || 'h ago' WHEN x.h < 48 THEN 'Updated yesterday'
  ELSE 'Updated ' || cast(cast(floor(x.h / 24 + 0.5) AS bigint) AS string) || 'd ago' END AS label FROM x
""")
def p21(t):
    return t.apartments.select("id", T.freshness_label(F.col("last_scraped_at"), "2001-11-05 10:30:00").alias("label"))


@query("p22_market_label", """
WITH x AS (SELECT p.id, p.price - p.max_price + 20 AS diff, p.max_price - 20 AS med, p.bedrooms FROM plans p WHERE p.price IS NOT NULL),
y AS (SELECT x.*, cast(abs(floor(x.diff + 0.5)) AS bigint) AS apart, CASE WHEN x.bedrooms = 0 THEN 'studio'
  ELSE cast(cast(x.bedrooms AS bigint) AS string) || 'BR' END AS kind FROM x)
SELECT y.id, CASE WHEN y.apart < 50 THEN 'At ' ELSE '$' || format('{:,}', y.apart) || CASE WHEN y.diff < 0 THEN ' below ' ELSE ' above ' END END
  || 'Springfield median ($' || format('{:,}', cast(floor(y.med + 0.5) AS bigint)) || ') for ' || y.kind AS label,
  CASE WHEN y.diff <= 0 THEN 'good' WHEN y.diff / y.med > 0.10 THEN 'high' ELSE 'neutral' END AS tone FROM y
""")
def p22(t):
    label, tone = T.market_label(F.col("price"), F.col("max_price") - 20, F.lit("Springfield"), F.col("bedrooms"))
    return t.plans.where("price IS NOT NULL").select("id", label.alias("label"), tone.alias("tone"))


@query("p23_beds_label", """
WITH s AS (SELECT p.apartment_id, min(p.bedrooms) AS lo, max(p.bedrooms) AS hi FROM plans p GROUP BY p.apartment_id, p.p_group),
x AS (SELECT s.*, CASE WHEN s.lo = 0 THEN 'Studio' ELSE cast(cast(s.lo AS bigint) AS string) || ' bd' END AS a FROM s)
SELECT x.apartment_id, x.lo, x.hi, CASE WHEN x.lo = x.hi THEN x.a ELSE x.a || '–' || cast(cast(x.hi AS bigint) AS string) || ' bd' END AS label FROM x
""".replace("FROM plans p GROUP BY p.apartment_id, p.p_group", "FROM plans p GROUP BY p.apartment_id, p.id % 4"))
def p23(t):
    ranges = t.plans.groupBy("apartment_id", (F.col("id") % 4).alias("g")).agg(
        F.min("bedrooms").alias("lo"), F.max("bedrooms").alias("hi")
    )
    return ranges.select("apartment_id", "lo", "hi", T.beds_label(F.col("lo"), F.col("hi")).alias("label"))


@query("p24_costs", """
SELECT c.id, cast(cast(cast(c.input_tok * 3 + c.output_tok * 11 AS decimal(18, 0)) * 0.0000001 AS decimal(10, 6)) AS double) AS token_cost,
  cast(cast(c.api_calls * 0.003 + c.cache_hits * 0.007 AS decimal(10, 6)) AS double) AS place_cost FROM costs c
""")
def p24(t):
    return t.costs.select(
        "id", T.token_cost(F.col("input_tok"), F.col("output_tok")).cast("double").alias("token_cost"),
        T.place_cost(F.col("api_calls"), F.col("cache_hits")).cast("double").alias("place_cost"),
    )


@query("p25_type_coercion", """
SELECT e.event_id, cast(e.event_id % 50 AS string) AS unit_number,
  try_cast(nullif(CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'PH' ELSE cast(e.event_id % 30 AS string) END, '') AS int) AS floor_level
FROM events e
""")
def p25(t):
    raw = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "PH").otherwise(
        (F.col("event_id") % 30).cast("string")
    )
    return t.events.select(
        "event_id", (F.col("event_id") % 50).cast("string").alias("unit_number"), raw.try_cast("int").alias("floor_level")
    )


@query("p26_mdy_to_iso", """
WITH x AS (SELECT s.pos, CASE WHEN s.pos % 3 = 0 THEN s.availability ELSE cast(1 + s.pos % 12 AS string) || '/' || cast(1 + s.pos % 28 AS string)
  || '/2026' END AS d FROM snapshot s), y AS (SELECT x.pos, string_split(x.d, '/') AS q FROM x)
SELECT y.pos, CASE WHEN len(y.q) = 3 THEN y.q[3] || '-' || lpad(y.q[1], cast(greatest(2, length(y.q[1])) AS int), '0') || '-'
  || lpad(y.q[2], cast(greatest(2, length(y.q[2])) AS int), '0') END AS iso FROM y
""")
def p26(t):
    text = F.when(F.col("pos") % 3 == 0, F.col("availability")).otherwise(
        F.concat(1 + F.col("pos") % 12, F.lit("/"), 1 + F.col("pos") % 28, F.lit("/2026"))
    )
    return t.snapshot.select("pos", T.mdy_to_iso(text).alias("iso"))


def _contexts(t):
    fired = A.evaluate(t.subscriptions, t.units, t.plans, t.apartments, t.price_history, AS_OF).where("fired")
    return A.context(fired, t.units, t.plans, t.apartments, t.price_history, AS_OF)


@query("p27_alert_texts")
def p27(t):
    return _contexts(t).select(
        "id", G.alert_subject().alias("alert_subject"),
        G.alert_body("Rentscope", "rental prices", "https://app.example.com").alias("alert_body"),
        G.alert_short("Rentscope").alias("alert_short"),
    )


@query("p27_subject_parts", """
SELECT p.id, CASE WHEN (p.price - p.current_price) > 0 THEN '🔔 ' || p.name || ' dropped to $' || format('{:,.0f}', p.current_price) || '/mo (−'
    || format('{:.1f}', (p.price - p.current_price) / p.price * 100) || '% from $' || format('{:,.0f}', p.price) || ')'
  WHEN p.bedrooms > 1 THEN '🔔 ' || p.name || ' now below your $' || format('{:,.0f}', p.area_sqft) || ' target ($' || format('{:,.0f}', p.current_price) || '/mo)'
  ELSE '🔔 Price drop alert: ' || p.name || ' ($' || format('{:,.0f}', p.current_price) || '/mo)' END AS alert_subject
FROM plans p WHERE p.current_price IS NOT NULL AND p.area_sqft IS NOT NULL AND p.bedrooms IS NOT NULL
""")
def p27_subject(t):
    drop = (F.col("price") - F.col("current_price")) / F.col("price") * 100
    rows = t.plans.where("current_price IS NOT NULL AND area_sqft IS NOT NULL AND bedrooms IS NOT NULL").select(
        "id", F.col("name").alias("apartment_title"), F.col("current_price").alias("latest_price"),
        F.col("price").alias("baseline_price"), F.when(F.col("bedrooms") > 1, F.col("area_sqft")).alias("target_price"),
        drop.alias("drop_pct"),
    )
    return rows.select("id", G.alert_subject().alias("alert_subject"))


@query("p28_prefix_and_note", """
SELECT a.id, '[archived] ' || a.title AS title, coalesce(a.description || chr(10) || chr(10), '') || '[2026-04-29] checked' AS description
FROM apartments a
""")
def p28(t):
    return t.apartments.select(
        "id", T.with_prefix(F.col("title"), "[archived] ").alias("title"),
        T.with_note(F.col("description"), "[2026-04-29] checked").alias("description"),
    )


@query("p29_first_segment", "SELECT a.id, split_part(a.city || ', ' || a.state, ',', 1) AS city FROM apartments a")
def p29(t):
    location = F.concat_ws(", ", "city", "state")
    return t.apartments.select("id", F.split_part(location, F.lit(","), F.lit(1)).alias("city"))


@query("p30_explode_listings", """
SELECT p.apartment_id, p.id AS plan_id, a.title, p.name AS plan_name, coalesce(h.price, p.price) AS price,
  coalesce(h.recorded_at, a.updated_at) AS recorded_at
FROM plans p JOIN apartments a ON a.id = p.apartment_id LEFT JOIN price_history h ON h.plan_id = p.id
WHERE p.is_available AND p.price > 0
""")
def p30(t):
    return L.explode_listings(t.apartments, t.plans, t.price_history)


@query("p31_suggested_target", "SELECT p.id, cast(floor(p.price * 0.95::double) AS bigint) AS target FROM plans p")
def p31(t):
    return t.plans.select("id", F.floor(F.col("price") * 0.95).alias("target"))


@query("p32_row_validation", """
SELECT s.id, concat_ws(',', CASE WHEN s.price_drop_pct * 8 - 10 < 0 OR s.price_drop_pct * 8 - 10 > 100 THEN 'price_drop_pct_range' END,
  CASE WHEN s.target_price >= s.baseline_price THEN 'target_not_below_baseline' END) AS violations FROM subscriptions s
WHERE s.price_drop_pct * 8 - 10 < 0 OR s.price_drop_pct * 8 - 10 > 100 OR s.target_price >= s.baseline_price
""")
def p32(t):
    rows = t.subscriptions.withColumn("price_drop_pct", F.col("price_drop_pct") * 8 - 10)
    _, rejected = C.split_valid(rows, C.subscription_rules())
    return rejected.select("id", F.array_join("violations", ",").alias("violations"))


@query("p32_apartment_validation", """
SELECT a.id, concat_ws(',', CASE WHEN length(a.city) <> 2 THEN 'state_length' END,
  CASE WHEN length(a.zipcode) < 5 OR length(a.zipcode) > 10 THEN 'zipcode_length' END) AS violations FROM apartments a
""")
def p32_apartment(t):
    rows = t.apartments.withColumn("state", F.col("city"))
    return rows.select("id", F.array_join(C.violations(C.apartment_rules()), ",").alias("violations"))


@query("p33_scope_validation", """
SELECT s.id, concat_ws(',', CASE WHEN s.apartment_id IS NULL AND s.plan_id IS NULL AND s.unit_id IS NULL AND s.city IS NULL THEN 'no_target' END,
  CASE WHEN s.city IS NOT NULL OR s.zipcode IS NOT NULL OR s.min_bedrooms IS NOT NULL OR s.max_bedrooms IS NOT NULL THEN 'area_disabled' END,
  CASE WHEN s.target_price IS NULL AND s.price_drop_pct IS NULL THEN 'no_threshold' END) AS violations FROM subscriptions s
""")
def p33(t):
    return t.subscriptions.select("id", F.array_join(C.violations(C.scope_rules()), ",").alias("violations"))


@query("p34_short_title", """
SELECT a.id, CASE WHEN length(a.title) > 32 THEN substring(a.title, 1, 30) || '..' ELSE a.title END AS title FROM apartments a
""")
def p34(t):
    return t.apartments.select("id", B.short_title(F.col("title")).alias("title"))


@query("p35_null_to_zero", "SELECT p.id, coalesce(p.price, 0) AS price FROM plans p")
def p35(t):
    return t.plans.select("id", F.coalesce("price", F.lit(0.0)).alias("price"))
