"""Domain tables as SQL views over the star-schema parquet files.

The text of each view runs in Spark and in DuckDB.  Two placeholders differ per engine:
``@ts'...'`` is a zone-less timestamp literal and ``@avg(x)`` an average summed exactly
in decimals, so that the result does not depend on the order in which rows arrive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from rentscope.page_views import PAGE_VIEWS

# Declared schemas: reading a table needs neither a footer scan nor inference.
BASE_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

VIEWS: dict[str, str] = {}

VIEWS["apartments"] = """
SELECT s.s_suppkey AS id,
  'ext_' || cast(s.s_suppkey AS string) AS external_id,
  s.s_name || CASE
    WHEN s.s_suppkey % 13 = 5 THEN ' Senior Village'
    WHEN s.s_suppkey % 17 = 3 THEN ' Affordable Housing'
    WHEN s.s_suppkey % 19 = 4 THEN ' Avalon Court'
    WHEN s.s_suppkey % 7 = 2 THEN ' Lakeside Apartments and Residences'
    ELSE '' END AS title,
  CASE s.s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN cast(s.s_suppkey AS string) || ' Main St, ' || n.n_name
    ELSE cast(s.s_suppkey AS string) || ' Oak Ave' END AS address,
  n.n_name AS city,
  substring(r.r_name, 1, 2) AS state,
  cast(90000 + s.s_suppkey % 40 AS string) AS zipcode,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' ELSE 'condo' END AS property_type,
  CASE WHEN s.s_suppkey % 6 = 0 THEN NULL ELSE 37 + cast(s.s_suppkey % 100 AS double) / 100 END AS latitude,
  CASE WHEN s.s_suppkey % 8 = 0 THEN NULL ELSE -122 - cast(s.s_suppkey % 100 AS double) / 100 END AS longitude,
  CASE s.s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS pets_allowed,
  CASE s.s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS has_parking,
  s.s_acctbal >= 0 AS is_available,
  CASE WHEN s.s_suppkey % 9 = 4 THEN NULL ELSE
    CASE WHEN s.s_suppkey % 4 = 1 THEN 'https://www.' ELSE 'https://' END
    || CASE WHEN s.s_suppkey % 10 >= 7 THEN 'Avalon' ELSE 'Host' END
    || cast(cast(floor(s.s_suppkey / 5) AS bigint) AS string) || '.example.com/communities/p'
    || cast(cast(floor(s.s_suppkey / 2) AS bigint) AS string)
    || CASE s.s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/floor-plans' ELSE '' END
    || CASE s.s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '?utm_source=feed' ELSE '?b=2&utm_medium=x&a=1' END
    END AS source_url,
  CASE s.s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unscrapeable' WHEN 2 THEN 'legal_block'
    ELSE 'brand_site' END AS data_source_type,
  CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE 'Homes in ' || r.r_name END AS description,
  CASE WHEN s.s_suppkey % 3 = 0 THEN '1 month free' ELSE NULL END AS current_special,
  CASE WHEN s.s_suppkey % 3 = 0 THEN NULL ELSE md5('page' || cast(s.s_suppkey AS string)) END AS last_content_hash,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL
    ELSE @ts'2001-10-01 00:00:00' + cast(s.s_suppkey % 36 AS int) * interval '1' day END AS last_scraped_at,
  @ts'2001-01-01 00:00:00' + cast(s.s_suppkey % 200 AS int) * interval '1' day AS updated_at
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["plans"] = """
SELECT p.p_partkey AS id,
  p.p_partkey % (SELECT count(*) FROM supplier sc) AS apartment_id,
  CASE p.p_partkey % 8
    WHEN 0 THEN cast(p.p_size % 5 AS string) || ' Bed / ' || cast(1 + p.p_size % 3 AS string) || ' Bath'
    WHEN 1 THEN 'Unit'
    WHEN 2 THEN 'Tour Now'
    WHEN 3 THEN 'A' || cast(p.p_partkey % 9 AS string)
    WHEN 4 THEN 'B' || cast(p.p_partkey % 700 AS string)
    WHEN 5 THEN 'S' || cast(p.p_partkey AS string)
    WHEN 6 THEN p.p_name
    ELSE 'Marina Creek ' || cast(p.p_partkey AS string) END AS name,
  CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE cast(p.p_size % 5 AS double) END AS bedrooms,
  cast(1 + p.p_size % 3 AS double) AS bathrooms,
  CASE WHEN p.p_partkey % 13 = 0 THEN cast(0 AS double) WHEN p.p_partkey % 17 = 0 THEN NULL
    ELSE cast(p.p_size * 30 + p.p_partkey % 7 AS double) END AS area_sqft,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE p.p_retailprice * (3 + p.p_size % 5) / 2 END AS price,
  CASE WHEN p.p_partkey % 11 = 0 OR p.p_partkey % 14 = 3 THEN NULL
    ELSE p.p_retailprice * (3 + p.p_size % 5) / 2 - (p.p_partkey % 5) * 10 END AS current_price,
  CASE WHEN p.p_partkey % 11 = 0 OR p.p_partkey % 4 = 0 THEN NULL
    ELSE p.p_retailprice * (3 + p.p_size % 5) / 2 + (p.p_partkey % 4) * 50 END AS max_price,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL
    ELSE @ts'2001-10-15 00:00:00' + cast(p.p_partkey % 90 AS int) * interval '1' day END AS available_from,
  p.p_partkey % 6 <> 0 AS is_available,
  CASE p.p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '/floorplans/' || cast(p.p_partkey AS string)
    WHEN 3 THEN 'plans/' || cast(p.p_partkey AS string)
    ELSE 'https://host.example.com/plan/' || cast(p.p_partkey AS string) END AS external_url,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE cast(p.p_partkey % 12 AS int) END AS floor_level,
  CASE p.p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'N' ELSE 'SW' END AS facing
FROM part p
"""

_UNIT = """
SELECT p.p_partkey * 4 + {i} AS id, p.p_partkey AS plan_id,
  CASE WHEN (p.p_partkey + {i}) % 5 = 0 THEN NULL ELSE 'U' || cast(p.p_partkey AS string) || '-{i}' END AS unit_number,
  CASE WHEN (p.p_partkey + {i}) % 9 = 0 THEN NULL
    ELSE p.p_retailprice * (3 + p.p_size % 5) / 2 + {i} * 25 - (p.p_partkey % 3) * 10 END AS price,
  cast(p.p_size * 30 + {i} AS double) AS area_sqft,
  cast(p.p_partkey % 12 AS int) AS floor_level,
  CASE p.p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'N' ELSE 'E' END AS facing,
  CASE WHEN (p.p_partkey + {i}) % 3 = 0 THEN NULL
    ELSE @ts'2001-10-20 00:00:00' + cast((p.p_partkey + {i}) % 60 AS int) * interval '1' day END AS available_from,
  (p.p_partkey + {i}) % 4 <> 0 AS is_available
FROM part p WHERE p.p_partkey % 4 > {i}
"""
VIEWS["units"] = " UNION ALL ".join(_UNIT.format(i=i) for i in range(3))

VIEWS["price_history"] = """
SELECT l.l_partkey AS plan_id, l.l_extendedprice / l.l_quantity AS price, l.l_shipdate AS recorded_at,
  l.l_orderkey AS seq, l.l_linenumber AS line
FROM lineitem l
"""

VIEWS["subscriptions"] = """
SELECT c.c_custkey AS id, c.c_custkey % 500 AS user_id,
  CASE WHEN c.c_custkey % 4 = 0 THEN ((c.c_custkey + 1 + c.c_custkey % 3) % (SELECT count(*) FROM part pc)) * 4 + least(c.c_custkey % 3, 1)
    END AS unit_id,
  CASE WHEN c.c_custkey % 4 = 1 THEN c.c_custkey % (SELECT count(*) FROM part pc) END AS plan_id,
  CASE WHEN c.c_custkey % 4 = 2 THEN c.c_custkey % (SELECT count(*) FROM supplier sc) END AS apartment_id,
  CASE WHEN c.c_custkey % 4 = 3 AND c.c_custkey % 8 = 3 THEN lower(n.n_name) END AS city,
  CASE WHEN c.c_custkey % 4 = 3 AND c.c_custkey % 16 >= 11 THEN cast(90000 + c.c_custkey % 40 AS string) END AS zipcode,
  CASE WHEN c.c_custkey % 4 = 3 AND c.c_custkey % 3 = 0 THEN cast(c.c_custkey % 3 AS double) END AS min_bedrooms,
  CASE WHEN c.c_custkey % 4 = 3 AND c.c_custkey % 5 < 3 THEN cast(2 + c.c_custkey % 3 AS double) END AS max_bedrooms,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE 1400 + c.c_acctbal / 4 END AS target_price,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE cast(c.c_custkey % 20 AS double) END AS price_drop_pct,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE cast(1500 + (c.c_custkey % 40) * 50 AS double) END AS baseline_price,
  CASE WHEN c.c_custkey % 6 = 0 THEN NULL
    ELSE @ts'2001-09-01 00:00:00' + cast(c.c_custkey % 50 AS int) * interval '1' day END AS baseline_recorded_at,
  c.c_custkey % 3 <> 1 AS notify_email,
  c.c_custkey % 2 = 0 AS notify_telegram,
  CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE 'chat' || cast(c.c_custkey AS string) END AS telegram_chat_id,
  c.c_custkey % 9 <> 0 AS is_active,
  CASE c.c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN @ts'2001-11-04 06:00:00'
    ELSE @ts'2001-10-01 00:00:00' END AS last_notified_at,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE cast(c.c_custkey % 4 AS int) END AS trigger_count,
  @ts'2001-08-01 00:00:00' + cast(c.c_custkey % 30 AS int) * interval '1' day AS created_at
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

VIEWS["runs"] = """
SELECT e.event_id AS id,
  CASE WHEN e.event_id % 20 = 0 THEN NULL ELSE e.user_id % (SELECT count(*) FROM supplier sc) END AS apartment_id,
  e.ts AS run_at,
  'https://Host' || cast(e.user_id % 40 AS string) || '.example.com/p/' || cast(e.user_id AS string) AS url,
  CASE WHEN e.event_type = 'view' THEN CASE WHEN e.event_id % 2 = 0 THEN 'success' ELSE 'cache_hit' END
    WHEN e.event_type = 'click' THEN CASE e.event_id % 3 WHEN 0 THEN 'platform_direct_static'
      WHEN 1 THEN 'platform_direct_rendered' ELSE 'platform_direct' END
    WHEN e.event_type = 'error' THEN CASE e.event_id % 3 WHEN 0 THEN 'hard_fail' WHEN 1 THEN 'validated_fail'
      ELSE 'skipped_negative_cache' END
    WHEN e.event_type = 'signup' THEN 'content_unchanged'
    ELSE CASE e.event_id % 3 WHEN 0 THEN 'not_apartment' WHEN 1 THEN 'no_data' ELSE 'skipped_unscrapeable' END
    END AS outcome,
  e.event_id % 1000 AS input_tokens, e.event_id % 77 AS output_tokens,
  CASE WHEN e.event_type IN ('view', 'error') THEN e.value / 1000 ELSE cast(0 AS double) END AS cost_usd,
  e.value AS elapsed_sec,
  CASE e.event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'sightmap' WHEN 2 THEN 'equity' WHEN 3 THEN 'windsor'
    WHEN 4 THEN 'universal_dom' ELSE 'rentcafe' END AS adapter_name
FROM events e
"""

VIEWS["costs"] = """
SELECT e.event_id AS id, e.ts AS ts,
  CASE WHEN e.event_type IN ('view', 'click', 'error') THEN 'scraper' ELSE 'google_maps' END AS source,
  CASE e.event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'success' WHEN 'click' THEN 'cache_hit'
    ELSE 'ok' END AS outcome,
  e.event_id % 1000 AS input_tok, e.event_id % 77 AS output_tok, e.event_id % 9 AS api_calls,
  e.event_id % 4 AS cache_hits, cast(e.value / 1000 AS decimal(10, 6)) AS cost_usd
FROM events e
"""

VIEWS["notifications"] = """
SELECT e.event_id AS id, e.user_id AS subscription_id, e.user_id % 50 AS user_id, e.ts AS sent_at,
  CASE e.event_id % 3 WHEN 0 THEN 'telegram' ELSE 'email' END AS channel,
  CASE WHEN e.event_id % 3 = 0 THEN CASE WHEN e.event_type = 'error' THEN 'failed' ELSE 'sent' END
    WHEN e.event_type = 'error' THEN CASE WHEN e.event_id % 2 = 0 THEN 'failed' ELSE 'bounced' END
    WHEN e.event_type = 'view' THEN 'opened' WHEN e.event_type = 'click' THEN 'clicked'
    WHEN e.event_type = 'signup' THEN CASE WHEN e.event_id % 5 = 0 THEN 'unsubscribed' ELSE 'delivered' END
    ELSE 'sent' END AS status,
  'm' || cast(e.event_id AS string) AS external_id,
  e.value AS trigger_price
FROM events e
"""

VIEWS["webhook_events"] = """
SELECT e.event_id AS seq,
  CASE e.event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'click'
    WHEN 'error' THEN CASE e.event_id % 4 WHEN 0 THEN 'bounce' WHEN 1 THEN 'deferred' WHEN 2 THEN 'spamreport'
      ELSE 'processed' END
    WHEN 'signup' THEN 'delivered' ELSE 'group_unsubscribe' END AS event,
  CASE WHEN e.event_id % 13 = 0 THEN '' WHEN e.event_id % 13 = 1 THEN NULL
    WHEN e.event_id % 2 = 0 THEN 'm' || cast(cast(floor(e.event_id / 4) AS bigint) * 4 + 1 AS string) || '.filter001.x'
    ELSE 'm' || cast(cast(floor(e.event_id / 3) AS bigint) * 3 + 2 AS string) END AS sg_message_id
FROM events e
"""

VIEWS["favourites"] = """
SELECT o.o_custkey AS user_id, o.o_orderkey % (SELECT count(*) FROM supplier sc) AS apartment_id,
  o.o_orderdate AS created_at, o.o_orderkey AS fav_id
FROM orders o
"""

VIEWS["images"] = """
SELECT o.o_orderkey AS id, o.o_orderkey % (SELECT count(*) FROM supplier sc) AS apartment_id,
  'https://img.example.com/' || cast(o.o_orderkey AS string) AS url, o.o_orderkey % 3 = 0 AS is_primary,
  o.o_orderdate AS created_at
FROM orders o
"""

VIEWS["registry"] = """
SELECT lower(CASE WHEN s.s_suppkey % 3 = 0 THEN 'www.' ELSE '' END
    || CASE WHEN s.s_suppkey % 10 >= 7 THEN 'Avalon' ELSE 'Host' END
    || cast(cast(floor(s.s_suppkey / 5) AS bigint) AS string) || '.example.com') AS domain,
  CASE s.s_suppkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS robots_txt_allows,
  s.s_suppkey % 8 <> 3 AS is_active,
  CASE s.s_suppkey % 6 WHEN 1 THEN 'unscrapeable' WHEN 2 THEN 'legal_block' ELSE 'brand_site' END AS data_source_type,
  CASE WHEN s.s_suppkey % 9 = 2 THEN 'https://corporate.example.com/' || cast(s.s_suppkey AS string) END
    AS corporate_parent_url,
  CASE s.s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'sightmap' WHEN 2 THEN 'universal_dom' ELSE 'equity' END
    AS last_successful_adapter,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL
    ELSE @ts'2024-01-10 00:00:00' + cast(s.s_suppkey % 20 AS int) * interval '1' day END AS last_adapter_success_at
FROM supplier s WHERE s.s_suppkey % 5 IN (1, 3)
"""

VIEWS["suppression"] = """
SELECT 'https://Host' || cast(c.c_custkey % 40 AS string) || '.example.com/p/' || cast(c.c_custkey AS string) AS url,
  @ts'2023-12-01 00:00:00' + cast(c.c_custkey % 20 AS int) * interval '1' day AS first_failed_at,
  @ts'2024-01-01 00:00:00' + cast(c.c_custkey % 28 AS int) * interval '1' day AS last_failed_at,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'hard_fail' ELSE 'validated_fail' END AS last_reason,
  cast(1 + c.c_custkey % 5 AS int) AS attempt_count,
  @ts'2024-01-08 00:00:00' + cast(c.c_custkey % 50 AS int) * interval '1' day AS retry_after
FROM customer c
"""

VIEWS["snapshot"] = """
SELECT p.p_partkey % (SELECT count(*) FROM supplier sc) AS apartment_id, p.p_partkey AS pos,
  CASE WHEN p.p_partkey % 8 = 0 THEN 'C' || cast(p.p_partkey % 50 AS string)
    WHEN p.p_partkey % 8 = 1 THEN 'Unit'
    WHEN p.p_partkey % 8 = 3 THEN 'A' || cast(p.p_partkey % 9 AS string)
    WHEN p.p_partkey % 8 = 4 THEN 'B' || cast(p.p_partkey % 700 AS string)
    WHEN p.p_partkey % 8 = 5 THEN 'S' || cast(p.p_partkey AS string)
    WHEN p.p_partkey % 8 = 7 THEN 'Marina Creek ' || cast(p.p_partkey AS string)
    ELSE p.p_name END AS name,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL WHEN p.p_partkey % 3 = 1 THEN 'U' || cast(p.p_partkey AS string) || '-0'
    ELSE 'N' || cast(p.p_partkey % 90 AS string) END AS unit_number,
  CASE WHEN p.p_partkey % 23 = 0 THEN NULL ELSE cast(p.p_size % 5 AS double) END AS bedrooms,
  CASE WHEN p.p_partkey % 29 = 0 THEN NULL ELSE cast(1 + p.p_size % 3 AS double) END AS bathrooms,
  CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE cast(p.p_size * 30 + p.p_partkey % 11 AS double) END AS size_sqft,
  CASE WHEN p.p_partkey % 12 = 5 THEN NULL WHEN p.p_partkey % 37 = 1 THEN cast(30000 AS double)
    WHEN p.p_partkey % (SELECT count(*) FROM supplier sc) % 9 = 2 THEN cast(2500 AS double)
    ELSE p.p_retailprice * (3 + p.p_size % 5) / 2 - (p.p_partkey % 4) * 15 END AS min_price,
  CASE WHEN p.p_partkey % 12 = 5 OR p.p_partkey % 12 = 7 THEN NULL
    WHEN p.p_partkey % (SELECT count(*) FROM supplier sc) % 9 = 2 THEN cast(2900 AS double)
    ELSE p.p_retailprice * (3 + p.p_size % 5) / 2 + 100 END AS max_price,
  CASE p.p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Available Now' WHEN 2 THEN 'Waitlist'
    WHEN 3 THEN 'Available 12/' || cast(1 + p.p_partkey % 28 AS string) || '/2001'
    WHEN 4 THEN 'Jun ' || cast(1 + p.p_partkey % 28 AS string) || 'th'
    WHEN 5 THEN 'Available 2001-10-' || cast(10 + p.p_partkey % 20 AS string)
    WHEN 6 THEN 'Dec ' || cast(1 + p.p_partkey % 33 AS string) || ', maybe'
    WHEN 7 THEN '13/45/2001 then 1/2/02' ELSE 'unavailable' END AS availability,
  CASE WHEN p.p_partkey % 6 = 1 THEN 'https://host.example.com/new/' || cast(p.p_partkey AS string) END AS external_url,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE cast(p.p_partkey % 9 AS int) END AS floor_level,
  CASE p.p_partkey % 4 WHEN 0 THEN 'NE' WHEN 1 THEN '' ELSE NULL END AS facing,
  CASE WHEN p.p_partkey % (SELECT count(*) FROM supplier sc) % 10 = 1 THEN 'jonah_digital'
    WHEN p.p_partkey % (SELECT count(*) FROM supplier sc) % 10 = 2 THEN NULL ELSE 'sightmap' END AS adapter_name
FROM part p
WHERE p.p_partkey % 10 <> 9 AND p.p_partkey % (SELECT count(*) FROM supplier sc) % 4 <> 3
"""

VIEWS["candidates"] = """
SELECT c.c_custkey AS seq, 'ext_' || cast(c.c_custkey % (4 * (SELECT count(*) FROM supplier sc)) AS string) AS external_id,
  c.c_name || CASE c.c_custkey % 9 WHEN 0 THEN ' Senior Living' WHEN 1 THEN ' Hotel' WHEN 2 THEN ' Public Housing'
    ELSE ' Residences' END AS title,
  n.n_name AS city, CASE c.c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://x.example.com' WHEN 2 THEN ''
    ELSE ' https://www.' || CASE c.c_custkey % 12 WHEN 3 THEN 'zillow.' WHEN 4 THEN 'Avalon' ELSE 'Host' END
      || cast(c.c_custkey % 60 AS string) || '.example.com/communities/p' || cast(c.c_custkey % 90 AS string)
      || CASE c.c_custkey % 3 WHEN 0 THEN '//' ELSE '' END END AS source_url,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE cast(30 + c.c_custkey % 21 AS double) / 10 END AS rating,
  CASE WHEN c.c_custkey % 8 = 0 THEN NULL ELSE c.c_custkey % 100 END AS user_rating_count
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# One day's refresh: listings on 23 sites, what the registry knows of these, addresses that failed before, and the pages that could be fetched.
VIEWS["daily_listings"] = """
SELECT a.id, 'https://site' || cast(a.id % 23 AS string) || '.example.com/l/' || cast(a.id AS string) AS source_url, a.title, a.is_available,
  CASE WHEN a.id % 13 = 5 THEN 'unscrapeable' ELSE 'brand_site' END AS data_source_type, a.current_special, a.last_scraped_at
FROM apartments a
"""
VIEWS["daily_registry"] = """
SELECT 'site' || cast(k.n AS string) || '.example.com' AS domain, CASE k.n % 9 WHEN 3 THEN false WHEN 5 THEN NULL ELSE true END AS robots_txt_allows,
  k.n % 10 <> 7 AS is_active, CASE WHEN k.n % 8 = 6 THEN 'unscrapeable' ELSE 'brand_site' END AS data_source_type,
  CASE WHEN k.n % 6 = 2 THEN 'https://corporate.example.com/' || cast(k.n AS string) END AS corporate_parent_url,
  CASE k.n % 3 WHEN 0 THEN 'greystar' WHEN 1 THEN 'avalonbay' END AS last_successful_adapter, @ts'2001-10-01 00:00:00' AS last_adapter_success_at
FROM (SELECT DISTINCT s.s_suppkey % 23 AS n FROM supplier s) k WHERE k.n % 11 <> 4
"""
VIEWS["daily_suppression"] = """
SELECT d.source_url AS url, @ts'2001-10-10 00:00:00' AS first_failed_at, @ts'2001-10-20 00:00:00' AS last_failed_at, 'hard_fail' AS last_reason,
  cast(2 AS bigint) AS attempt_count, CASE WHEN d.id % 17 = 9 THEN @ts'2001-11-20 00:00:00' ELSE @ts'2001-11-01 00:00:00' END AS retry_after
FROM daily_listings d WHERE d.id % 17 IN (9, 10, 12)
"""
_UNITS_PAGE = """'<script>Fusion.globalContent={"units":[{"floorPlan":{"name":"A' || cast({n} % 3 AS string) || '"},"unitName":"1","bedroomNumber":1,"bathroomNumber":1,'
  || '"squareFeet":' || cast(500 + {n} % 300 AS string) || ',"startingAtPricesUnfurnished":{"prices":{"price":' || cast(1800 + {n} % 50 AS string)
  || '}}},{"floorPlan":{"name":"New' || cast({n} AS string) || '"},"unitName":"2","bedroomNumber":2,"bathroomNumber":2,"squareFeet":' || cast(900 + {n} % 300 AS string)
  || ',"startingAtPricesUnfurnished":{"prices":{"price":' || cast(2500 + {n} % 50 AS string) || '}}}]};  Fusion.x=1;</script><p>Homes at number ' || cast({n} AS string) || '</p>'"""
VIEWS["daily_pages"] = f"""
SELECT d.source_url AS url, CASE WHEN d.id % 7 = 6 THEN NULL WHEN d.id % 5 = 0 THEN '<p>Welcome to number ' || cast(d.id AS string) || '</p>'
  ELSE {_UNITS_PAGE.replace('{n}', 'd.id')} END AS html FROM daily_listings d
UNION ALL SELECT g.corporate_parent_url, {_UNITS_PAGE.replace('{n}', '4711')} FROM daily_registry g WHERE g.corporate_parent_url LIKE '%8'
"""

VIEWS.update(PAGE_VIEWS)

_WORD = re.compile(r"\b(?:FROM|JOIN)\s+\(?([a-z_]+)\b", re.IGNORECASE)


def _needed(sql: str) -> list[str]:
    """Views named in ``sql``, each after the views it is built from."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _WORD.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    ctes = [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def duckdb_sql(sql: str) -> str:
    text = with_views(sql).replace("@ts'", "timestamp '")
    return re.sub(
        r"@avg\(([^()]*(?:\([^()]*\))?[^()]*)\)",
        r"(cast(sum(cast(\1 AS decimal(18, 8))) AS double) / count(\1))",
        text,
    )


# Tasks that pages are built and read in, also where few cores are known of when the query is built; each writes a file per shuffle partition.
LEAST_TASKS = 24


class Tables:
    """Domain tables of one data folder, each an unevaluated DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._registered: dict[str, str] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A base table dealt out evenly by rows: a narrow one is a small file or two, which would leave the pages built from it to as many tasks."""
        return self.base(name).repartition(max(2 * self.spark.sparkContext.defaultParallelism, LEAST_TASKS))

    def _base_view(self, name: str, spread: bool = False) -> str:
        """Name of a session view over a base table of this folder."""
        key = f"{name}_spread" if spread else name
        if key not in self._registered:
            view = f"{key}_{hashlib.md5(self.sf_dir.encode()).hexdigest()[:10]}"
            (self.spread(name) if spread else self.base(name)).createOrReplaceTempView(view)
            self._registered[key] = view
        return self._registered[key]

    def _sql(self, sql: str, spread: bool = False) -> DataFrame:
        def swap(m: re.Match) -> str:
            name = m.group(1)
            if name in BASE_TABLES and name not in VIEWS:
                return m.group(0)[: m.start(1) - m.start(0)] + self._base_view(name, spread)
            return m.group(0)

        return self.spark.sql(_WORD.sub(swap, with_views(sql).replace("@ts'", "timestamp_ntz '")))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self._sql(VIEWS[name], spread=name in PAGE_VIEWS)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
