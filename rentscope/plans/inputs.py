"""Sources and sinks, over documents that Spark builds from the tables."""

from pyspark.sql import functions as F

from rentscope.operators import merge as G
from rentscope.plans.registry import query
from rentscope.sources import readers as R
from rentscope.sources import writers as W


def _payloads(t):
    """One raw place payload per candidate."""
    return t.candidates.select("seq", F.to_json(F.struct(
        F.concat(F.lit("places/"), "external_id").alias("name"),
        F.when(F.col("seq") % 4 != 0, F.struct(F.col("title").alias("text"))).alias("displayName"),
        F.concat(F.lit("1 Main St, "), "city", F.lit(", CA 9"), F.lpad((F.col("seq") % 9999).cast("string"), 4, "0"), F.lit(", USA")).alias("formattedAddress"),
        F.trim("source_url").alias("websiteUri"), "rating", F.col("user_rating_count").alias("userRatingCount"),
        F.struct((F.col("seq") % 90).cast("double").alias("latitude"), (-F.col("seq") % 90).cast("double").alias("longitude")).alias("location"),
    )).alias("json"))


@query("s01_read_table", "SELECT p.* FROM plans p")
def s01(t):
    return t.plans


@query("s02_place_map", """
SELECT c.external_id AS place_id, c.title, trim(c.source_url) AS source_url FROM candidates c WHERE trim(c.source_url) LIKE 'http%'
""")
def s02(t):
    place = F.struct("title", "city", F.trim("source_url").alias("source_url"))
    docs = t.candidates.select(F.to_json(F.create_map("external_id", place)).alias("json"))
    return R.place_map(docs, "json").select("place_id", "title", "source_url")


@query("s03_seed_list", """
SELECT c.title AS name, trim(c.source_url) AS url, c.city FROM candidates c WHERE lower(c.title) LIKE '%hotel%'
""")
def s03(t):
    entries = t.candidates.select(F.col("title").alias("name"), F.trim("source_url").alias("url"), "city")
    return R.seed_list(entries, "Hotel")


@query("s04_discovery", "SELECT c.title, c.city, c.rating FROM candidates c")
def s04(t):
    doc = F.struct(F.lit(1).alias("total"), F.array(F.struct("title", "city", "rating")).alias("apartments"))
    return R.discovery(t.candidates.select(F.to_json(doc).alias("json")), "json").select("title", "city", "rating")


@query("s05_step_cache", """
SELECT s.url, 2 AS steps FROM suppression s WHERE s.attempt_count <> 3 AND s.last_failed_at >= @ts'2024-01-15 00:00:00'
""")
def s05(t):
    step = F.struct(F.lit("click").alias("action"), F.create_map(F.lit("text"), F.lit("Floor plans")).alias("args"))
    entries = t.suppression.select(
        "url", F.array(step, step).alias("steps"),
        F.when(F.col("attempt_count") != 3, F.date_format("last_failed_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("last_success"),
    )
    return R.fresh_steps(entries, "2024-02-14 00:00:00").select("url", F.size("steps").alias("steps"))


@query("s06_read_pages", "SELECT g.page_id, g.url, length(g.html) AS chars FROM pages g")
def s06(t):
    return t.pages.select("page_id", "url", F.length("html").alias("chars"))


@query("s07_jsonl_rows", "SELECT c.id, c.source, c.input_tok + c.output_tok AS total_tok FROM costs c")
def s07(t):
    return W.jsonl_rows(t.costs, "2024-01-31 00:00:00").select("id", "source", "total_tok")


@query("s08_summary_document", """
SELECT count(*) AS total, round(count(DISTINCT c.city) * 0.012::double, 4) AS cost_usd, count(DISTINCT c.city) AS cities FROM candidates c
""")
def s08(t):
    return W.summary_totals(t.candidates, 0.012).select("total", "cost_usd", F.size("city_counts").cast("bigint").alias("cities"))


@query("s09_fact_defaults", """
SELECT r.id, r.cost_usd, false AS path_cache_hit, false AS content_hash_short_circuit, r.input_tokens, r.output_tokens, r.elapsed_sec FROM runs r
""")
def s09(t):
    return W.with_defaults(t.runs, W.RUN_DEFAULTS).select(
        "id", "cost_usd", "path_cache_hit", "content_hash_short_circuit", "input_tokens", "output_tokens", "elapsed_sec"
    )


@query("s10_webhook_batch", "SELECT w.seq AS request, w.event, w.sg_message_id FROM webhook_events w")
def s10(t):
    body = F.to_json(F.array(F.struct("event", "sg_message_id"))).alias("json")
    return R.webhook_batch(t.webhook_events.select("seq", body), "json", "seq").select("request", "event", "sg_message_id")


_NESTED = """lv AS (SELECT p.id, p.apartment_id, p.name, p.price FROM plans p JOIN apartments a ON a.id = p.apartment_id WHERE p.is_available),
ne AS (SELECT a.id AS apartment_id, 'listing' AS kind, NULL AS plan_id, NULL AS item, NULL AS line, a.title, a.city, NULL AS name, NULL AS unit_number,
  NULL AS price, NULL AS recorded_at FROM apartments a
UNION ALL SELECT lv.apartment_id, 'plan', lv.id, NULL, NULL, NULL, NULL, lv.name, NULL, lv.price, NULL FROM lv
UNION ALL SELECT lv.apartment_id, 'unit', lv.id, u.id, NULL, NULL, NULL, NULL, u.unit_number, u.price, NULL FROM units u JOIN lv ON lv.id = u.plan_id
UNION ALL SELECT lv.apartment_id, 'point', lv.id, h.seq, h.line, NULL, NULL, NULL, NULL, h.price, h.recorded_at FROM price_history h
  JOIN lv ON lv.id = h.plan_id)"""


@query("s11_nested_listing", f"WITH {_NESTED} SELECT * FROM ne")
def s11(t):
    return W.nested_listing(t.apartments, t.plans, t.units, t.price_history)


@query("s11_nested_listing_contents", f"""
WITH {_NESTED} SELECT ne.apartment_id, ne.plan_id, count(*) FILTER (WHERE ne.kind = 'unit') AS units, count(*) FILTER (WHERE ne.kind = 'point') AS points
FROM ne WHERE ne.plan_id IS NOT NULL GROUP BY 1, 2
""")
def s11_contents(t):
    rows = W.nested_listing(t.apartments, t.plans, t.units, t.price_history).where("plan_id IS NOT NULL")
    return rows.groupBy("apartment_id", "plan_id").agg(F.count_if(F.col("kind") == "unit").alias("units"), F.count_if(F.col("kind") == "point").alias("points"))


@query("p14_place_rows")
def p14(t):
    return R.place_rows(_payloads(t), "json")


@query("p14_place_titles", """
SELECT 'google_places/' || c.external_id AS external_id, CASE WHEN c.seq % 4 <> 0 THEN c.title ELSE 'places/' || c.external_id END AS title,
  c.city, 'CA' AS state, '9' || lpad(cast(c.seq % 9999 AS string), 4, '0') AS zipcode, coalesce(trim(c.source_url), '') AS source_url FROM candidates c
""")
def p14_titles(t):
    return R.place_rows(_payloads(t), "json").select("external_id", "title", "city", "state", "zipcode", "source_url")


@query("m02_normalised_places", """
WITH k AS (SELECT c.external_id, arg_max(c.seq, c.seq) AS s FROM candidates c GROUP BY 1)
SELECT 'google_places/' || c.external_id AS external_id, CASE WHEN c.seq % 4 <> 0 THEN c.title ELSE 'places/' || c.external_id END AS title
FROM candidates c JOIN k ON k.external_id = c.external_id AND k.s = c.seq
UNION ALL SELECT 'google_old_' || cast(a.id AS string), a.title FROM apartments a WHERE a.id % 2 = 0
""")
def m02(t):
    last = _payloads(t).join(t.candidates.select("seq", "external_id"), "seq").groupBy("external_id").agg(F.max_by("json", "seq").alias("json"))
    stored = t.apartments.where(F.col("id") % 2 == 0).select(F.concat(F.lit("google_old_"), "id").alias("external_id"), "title")
    return G.upsert_by_key(stored, R.place_rows(last, "json"), "external_id").select("external_id", "title")


@query("m02_raw_places")
def m02_raw(t):
    last = _payloads(t).join(t.candidates.select("seq", "external_id"), "seq").groupBy("external_id").agg(F.max_by("json", "seq").alias("json"))
    raw = R.raw_place_rows(last, "json")
    return G.upsert_by_key(raw.where(F.col("user_rating_count") > 50), raw, "place_resource_name")
