"""Run gating and outcome classification."""

from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.operators import gating as G
from rentscope.plans.registry import query


@query("g01_gate", """
WITH c AS (SELECT a.id, a.source_url, lower(regexp_extract(a.source_url, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM apartments a
  WHERE a.source_url IS NOT NULL UNION ALL SELECT 1000000 + s.attempt_count, s.url,
  lower(regexp_extract(s.url, '^[a-z]+://([^/?#]*)', 1)) FROM suppression s),
d AS (SELECT c.id, c.source_url, CASE WHEN r.domain IS NULL THEN 'unregistered' WHEN r.robots_txt_allows = false THEN 'robots_denied'
  WHEN r.data_source_type = 'unscrapeable' THEN 'skipped_unscrapeable' WHEN s.url IS NOT NULL THEN 'skipped_negative_cache' ELSE 'go' END
  AS decision, r.corporate_parent_url FROM c LEFT JOIN registry r ON r.domain = c.domain AND r.is_active
  LEFT JOIN suppression s ON s.url = c.source_url AND s.retry_after > @ts'2024-01-31 00:00:00')
SELECT d.id, d.source_url, d.decision, CASE WHEN d.decision = 'go' THEN coalesce(d.corporate_parent_url, d.source_url) END AS visit_url FROM d
""")
def g01(t):
    listed = t.apartments.where(F.col("source_url").isNotNull()).select("id", "source_url")
    failing = t.suppression.select((F.lit(1_000_000) + F.col("attempt_count")).cast("bigint").alias("id"), F.col("url").alias("source_url"))
    return G.gate(listed.unionByName(failing), t.registry, t.suppression, "2024-01-31 00:00:00").select(
        "id", "source_url", "decision", "visit_url"
    )


@query("g02_outcome", """
SELECT r.id, CASE WHEN r.outcome = 'content_unchanged' THEN 'content_unchanged' WHEN r.elapsed_sec > 100 THEN 'hard_fail'
  WHEN r.input_tokens % 3 > 0 THEN CASE WHEN r.outcome IN ('platform_direct','platform_direct_static','platform_direct_rendered','cache_hit')
  THEN r.outcome ELSE 'success' END ELSE 'validated_fail' END AS final_outcome FROM runs r
""")
def g02(t):
    return t.runs.select("id", G.classify_outcome(
        F.col("outcome") == "content_unchanged", F.col("elapsed_sec") > 100, F.col("input_tokens") % 3, F.col("outcome")
    ).alias("final_outcome"))


@query("g03_outcome_class", """
SELECT r.id, CASE WHEN r.outcome IN ('success','content_unchanged','cache_hit','platform_direct') THEN 'success'
  WHEN r.outcome IN ('validated_fail','hard_fail') THEN 'failure' ELSE 'neither' END AS class FROM runs r
""")
def g03(t):
    return t.runs.select("id", P.outcome_class(F.col("outcome")).alias("class"))


@query("g04_banned_hosts", """
WITH c AS (SELECT x.seq, CASE WHEN x.seq % 5 = 0 THEN 'https://www.Zillow.com/h/' || cast(x.seq AS string) WHEN x.seq % 5 = 1
  THEN 'https://realtor.com' ELSE trim(x.source_url) END AS url FROM candidates x)
SELECT c.seq, lower(regexp_extract(c.url, '^[a-z]+://([^/?#]*)', 1)) IN ('craigslist.org','www.craigslist.org','zillow.com','www.zillow.com',
  'apartments.com','www.apartments.com','realtor.com','www.realtor.com') AS banned FROM c
""")
def g04(t):
    url = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("https://www.Zillow.com/h/"), "seq")).when(
        F.col("seq") % 5 == 1, "https://realtor.com"
    ).otherwise(F.trim("source_url"))
    return t.candidates.select("seq", G.banned(url).alias("banned"))
