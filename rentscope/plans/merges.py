"""Bulk upserts, merges and repairs."""

from pyspark.sql import functions as F

from rentscope.operators import backoff, refresh
from rentscope.operators import merge as G
from rentscope.plans.alerting import _AREA, _LAST
from rentscope.plans.dataquality import SANITISED
from rentscope.plans.filters import AS_OF
from rentscope.plans.joins import RENAMED
from rentscope.plans.registry import query
from rentscope.session import shared_folder

_LIVE = ("lower(coalesce(s.availability, '')) NOT LIKE '%waitlist%' AND lower(coalesce(s.availability, '')) NOT LIKE '%unavailable%'")
_LASTC = """lc AS (SELECT r.external_id, r.title, r.city, r.source_url FROM (SELECT c.*, row_number() OVER (PARTITION BY c.external_id
  ORDER BY c.seq DESC) AS rn FROM candidates c) r WHERE r.rn = 1)"""


@query("m01_upsert_places", f"""
WITH {_LASTC}, nw AS (SELECT lc.*, row_number() OVER (ORDER BY md5(lc.external_id), lc.external_id)
  + (SELECT max(x.id) FROM apartments x) AS id FROM lc WHERE lc.external_id NOT IN (SELECT y.external_id FROM apartments y))
SELECT a.id, a.external_id, CASE WHEN lc.external_id IS NOT NULL THEN lc.title ELSE a.title END AS title,
  CASE WHEN lc.external_id IS NOT NULL THEN lc.city ELSE a.city END AS city,
  CASE WHEN lc.external_id IS NOT NULL THEN lc.source_url ELSE a.source_url END AS source_url
FROM apartments a LEFT JOIN lc ON lc.external_id = a.external_id
UNION ALL SELECT nw.id, nw.external_id, nw.title, nw.city, nw.source_url FROM nw
""")
def m01(t):
    return G.upsert_places(t.apartments, t.candidates, "seq")["places"].select("id", "external_id", "title", "city", "source_url")


@query("m01_default_plans", f"""
WITH {_LASTC} SELECT row_number() OVER (ORDER BY md5(lc.external_id), lc.external_id) + (SELECT max(x.id) FROM apartments x) AS apartment_id,
  'Default Plan' AS name, 1.0::double AS bedrooms, 1.0::double AS bathrooms, 800.0::double AS area_sqft, 0.0::double AS price, true AS is_available
FROM lc WHERE lc.external_id NOT IN (SELECT y.external_id FROM apartments y)
""")
def m01_plans(t):
    return G.upsert_places(t.apartments, t.candidates, "seq")["plans"]


@query("m01_inserted", """
SELECT count(DISTINCT c.external_id) AS inserted FROM candidates c WHERE c.external_id NOT IN (SELECT y.external_id FROM apartments y)
""")
def m01_count(t):
    return G.upsert_places(t.apartments, t.candidates, "seq")["inserted"]


@query("m03_insert_if_absent", """
SELECT r.external_id, r.seq, r.title FROM (SELECT c.*, row_number() OVER (PARTITION BY c.external_id ORDER BY c.seq) AS rn FROM candidates c) r
WHERE r.rn = 1 AND r.external_id NOT IN (SELECT a.external_id FROM apartments a)
""")
def m03(t):
    return G.insert_if_absent(t.apartments, t.candidates, "external_id", "seq").select("external_id", "seq", "title")


_SEED = f"""sr AS (SELECT s.apartment_id, s.name, arg_max(s.min_price, s.pos) AS price, arg_max({_LIVE}, s.pos) AS live,
  arg_max(s.size_sqft, s.pos) FILTER (WHERE s.size_sqft <> 0) AS size FROM snapshot s WHERE s.min_price IS NOT NULL GROUP BY 1, 2),
mn AS (SELECT p.apartment_id, p.name, min(p.id) AS id FROM plans p GROUP BY 1, 2),
sd AS (SELECT p.id, p.apartment_id, p.name, CASE WHEN sr.name IS NOT NULL THEN sr.price ELSE p.price END AS price,
    CASE WHEN sr.name IS NOT NULL THEN sr.live ELSE p.is_available END AS is_available, coalesce(sr.size, p.area_sqft) AS area_sqft
  FROM plans p LEFT JOIN mn ON mn.id = p.id LEFT JOIN sr ON sr.apartment_id = mn.apartment_id AND sr.name = mn.name
  UNION ALL SELECT (SELECT max(x.id) FROM plans x) + row_number() OVER (ORDER BY md5(cast(sr.apartment_id AS string) || '|' || sr.name),
    sr.apartment_id, sr.name), sr.apartment_id, sr.name, sr.price, sr.live, coalesce(sr.size, 0)
  FROM sr WHERE NOT EXISTS (SELECT 1 FROM mn WHERE mn.apartment_id = sr.apartment_id AND mn.name = sr.name))"""


@query("m04_seed_plans", f"WITH {_SEED} SELECT * FROM sd")
def m04(t):
    return G.seed_plans(t.plans, t.snapshot).select("id", "apartment_id", "name", "price", "is_available", "area_sqft")


@query("m04_seed_history", f"""
WITH {_SEED} SELECT k.id AS plan_id, s.min_price AS price, @ts'2001-11-05 00:00:00' AS recorded_at FROM snapshot s
JOIN (SELECT sd.apartment_id, sd.name, min(sd.id) AS id FROM sd GROUP BY 1, 2) k ON k.apartment_id = s.apartment_id AND k.name = s.name
WHERE s.min_price IS NOT NULL
""")
def m04_history(t):
    return G.seed_history(G.seed_plans(t.plans, t.snapshot), t.snapshot, AS_OF)


def _match_sql(source: str, plans: str = "plans") -> str:
    """The rule row by row: a step takes the next row of each listing and carries the plans made or woken so far."""
    return f"""nm AS (SELECT p.apartment_id, p.name, min(CASE WHEN p.is_available THEN p.id END) AS act, min(CASE WHEN NOT p.is_available THEN p.id END)
    AS arc FROM {plans} p GROUP BY 1, 2),
nr AS (SELECT s.apartment_id, s.pos, count(*) AS n, min(p.id) AS id FROM {source} s JOIN {plans} p ON p.apartment_id = s.apartment_id
  AND p.bedrooms = s.bedrooms AND p.is_available AND abs(p.area_sqft - s.size_sqft) <= 5 GROUP BY 1, 2),
st AS (SELECT s.apartment_id, s.pos, s.name, s.bedrooms, s.size_sqft, nm.act, nm.arc, w.bedrooms AS arc_beds, w.area_sqft AS arc_size, coalesce(nr.n, 0) AS near_n,
    nr.id AS near_id, row_number() OVER (PARTITION BY s.apartment_id ORDER BY s.pos) AS rn FROM {source} s
  LEFT JOIN nm ON nm.apartment_id = s.apartment_id AND nm.name IS NOT DISTINCT FROM s.name LEFT JOIN {plans} w ON w.id = nm.arc
  LEFT JOIN nr ON nr.apartment_id = s.apartment_id AND nr.pos = s.pos),
sq AS (SELECT DISTINCT st.apartment_id, cast(0 AS bigint) AS rn, cast(NULL AS bigint) AS pos, cast(NULL AS varchar) AS name, cast(NULL AS int) AS tier,
    cast(NULL AS bigint) AS plan_id, cast(NULL AS bigint) AS made_by,
    cast([] AS STRUCT(pos bigint, id bigint, name varchar, beds double, size double)[]) AS made FROM st
  UNION ALL
  SELECT d.apartment_id, d.rn, d.pos, d.name, d.tier, CASE WHEN d.act IS NOT NULL THEN d.act WHEN d.arc IS NOT NULL THEN d.arc WHEN d.tier = 3
      THEN CASE WHEN d.near_n = 1 THEN d.near_id ELSE d.near[1].id END END,
    CASE WHEN coalesce(d.act, d.arc) IS NOT NULL THEN NULL WHEN d.tier = 1 THEN d.own[1].pos WHEN d.tier = 3 AND d.near_n = 0 THEN d.near[1].pos WHEN d.tier = 4 THEN d.pos END,
    CASE WHEN d.tier = 2 THEN list_append(d.made, {{'pos': NULL, 'id': d.arc, 'name': NULL, 'beds': d.arc_beds, 'size': d.arc_size}})
      WHEN d.tier = 4 THEN list_append(d.made, {{'pos': d.pos, 'id': NULL, 'name': coalesce(nullif(d.name, ''), 'Unit'), 'beds': d.bedrooms, 'size': coalesce(d.size_sqft, 0)}})
      ELSE d.made END
  FROM (SELECT c.*, CASE WHEN c.act IS NOT NULL THEN 1 WHEN c.arc IS NOT NULL THEN CASE WHEN len(c.woken) = 0 THEN 2 ELSE 1 END WHEN len(c.own) > 0 THEN 1
      WHEN c.near_n + len(c.near) = 1 THEN 3 WHEN c.bedrooms IS NOT NULL THEN 4 END AS tier
    FROM (SELECT st.*, sq.made, list_filter(sq.made, lambda m: m.id = st.arc) AS woken, list_filter(sq.made, lambda m: m.id IS NULL AND m.name = st.name) AS own,
        list_filter(sq.made, lambda m: m.beds = st.bedrooms AND abs(m.size - st.size_sqft) <= 5) AS near
      FROM sq JOIN st ON st.apartment_id = sq.apartment_id AND st.rn = sq.rn + 1) c) d),
mt AS (SELECT sq.apartment_id, sq.pos, sq.name, sq.tier, sq.plan_id, sq.made_by FROM sq WHERE sq.rn > 0)"""


_MATCHED = ("apartment_id", "pos", "tier", "plan_id", "made_by")


@query("m05_match_plans", f"WITH RECURSIVE {_match_sql('snapshot')} SELECT mt.apartment_id, mt.pos, mt.tier, mt.plan_id, mt.made_by FROM mt")
def m05(t):
    return G.match_plans(t.snapshot, t.plans).select(*_MATCHED)


# Listings of many rows whose sizes and names run into each other, most plans unknown: what one row makes decides on later ones.
_DENSE = """few AS (SELECT p.* REPLACE (p.apartment_id % 9 AS apartment_id, p.area_sqft % 190 AS area_sqft) FROM plans p WHERE p.id % 5 = 0),
dn AS (SELECT s.* REPLACE (s.apartment_id % 9 AS apartment_id, s.size_sqft % 190 AS size_sqft, CASE WHEN s.pos % 6 = 0 THEN NULL WHEN s.pos % 10 = 1 THEN ''
  WHEN s.pos % 4 = 1 THEN 'Unit' WHEN s.pos % 3 = 0 THEN s.name ELSE 'K' || cast(s.pos % 23 AS string) END AS name) FROM snapshot s)"""


@query("m05_match_in_sequence", f"WITH RECURSIVE {_DENSE}, {_match_sql('dn', 'few')} SELECT mt.apartment_id, mt.pos, mt.tier, mt.plan_id, mt.made_by FROM mt")
def m05_sequence(t):
    i = F.col("pos")
    few = t.plans.where(F.col("id") % 5 == 0).withColumns({"apartment_id": F.col("apartment_id") % 9, "area_sqft": F.col("area_sqft") % 190})
    dense = t.snapshot.withColumns({
        "apartment_id": F.col("apartment_id") % 9, "size_sqft": F.col("size_sqft") % 190,
        "name": F.when(i % 6 == 0, None).when(i % 10 == 1, "").when(i % 4 == 1, "Unit").when(i % 3 == 0, F.col("name")).otherwise(F.concat(F.lit("K"), i % 23)),
    })
    return G.match_plans(dense, few).select(*_MATCHED)


_NEWPLANS = """np AS (SELECT mt.apartment_id, mt.pos, (SELECT max(x.id) FROM plans x) + row_number() OVER (ORDER BY
    md5(cast(mt.apartment_id AS string) || '|' || cast(mt.pos AS string)), mt.apartment_id, mt.pos) AS id FROM mt WHERE mt.tier = 4)"""
# Hosts of the fixtures, so that stored generic names give way to codes.
_HOSTS = ("avalon", "host")
_PLACED = f"""{SANITISED}, {RENAMED.format(source='san')},
named AS (SELECT p.* REPLACE (coalesce(rg.new_name, p.name) AS name) FROM plans p LEFT JOIN rg ON rg.plan_id = p.id),
{_match_sql('san', 'named')}, {_NEWPLANS},
pl AS (SELECT s.*, coalesce(mt.plan_id, np.id) AS plan_id FROM san s JOIN mt ON mt.apartment_id = s.apartment_id
  AND mt.pos = s.pos LEFT JOIN np ON np.apartment_id = mt.apartment_id AND np.pos = mt.made_by WHERE mt.tier IS NOT NULL)"""
# Which stored or new unit each row ends in: the last row of (plan, number), numbers '' when anonymous.
_UNITS = """ic AS (SELECT i.*, coalesce(nullif(i.unit_number, ''), '') AS k FROM {src} i),
ls AS (SELECT x.* FROM (SELECT ic.*, row_number() OVER (PARTITION BY ic.plan_id, ic.k ORDER BY ic.pos DESC) AS rn FROM ic) x WHERE x.rn = 1),
su AS (SELECT u.*, coalesce(u.unit_number, '') AS k, row_number() OVER (PARTITION BY u.plan_id, coalesce(u.unit_number, '') ORDER BY u.id) AS rk
  FROM units u),
pp AS (SELECT ic.plan_id, bool_or(ic.k = '') AS anon, bool_or(ic.k <> '') AS numbered FROM ic GROUP BY 1),
un AS (SELECT su.id, su.plan_id, su.unit_number, CASE WHEN su.rk = 1 AND ls.k IS NOT NULL THEN ls.min_price ELSE su.price END AS price,
    CASE WHEN su.rk = 1 AND ls.k IS NOT NULL THEN ls.size_sqft ELSE su.area_sqft END AS area_sqft,
    CASE WHEN su.rk = 1 AND ls.k IS NOT NULL THEN {flag} WHEN su.k = '' AND coalesce(pp.anon, false) AND su.rk > 1 THEN false
      WHEN su.k <> '' AND coalesce(pp.numbered, false) AND ls.k IS NULL THEN false ELSE su.is_available END AS is_available
  FROM su LEFT JOIN ls ON ls.plan_id = su.plan_id AND ls.k = su.k LEFT JOIN pp ON pp.plan_id = su.plan_id
  UNION ALL SELECT (SELECT max(x.id) FROM units x) + row_number() OVER (ORDER BY md5(cast(ls.plan_id AS string) || '|' || ls.k), ls.plan_id, ls.k),
    ls.plan_id, nullif(ls.k, ''), ls.min_price, ls.size_sqft, {flag} FROM ls
  WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.plan_id = ls.plan_id AND su.k = ls.k))"""
_DIRECT = "dr AS (SELECT s.*, s.pos AS plan_id FROM snapshot s)"
_FLAG = "NOT coalesce(contains(lower(ls.availability), 'waitlist'), false)"


@query("m06_upsert_units", f"""
WITH {_DIRECT}, {_UNITS.format(src='dr', flag=_FLAG)} SELECT un.id, un.plan_id, un.unit_number, un.price, un.area_sqft FROM un
""")
def m06(t):
    rows = t.snapshot.withColumn("plan_id", F.col("pos"))
    return G.upsert_units(rows, t.units, AS_OF).select("id", "plan_id", "unit_number", "price", "area_sqft")


def _applied(t):
    return G.apply_snapshot(t.apartments, t.plans, t.units, t.subscriptions, t.snapshot, AS_OF, _HOSTS, _scraped(t))


_PLAN_COLUMNS = (
    "id", "apartment_id", "name", "bedrooms", "bathrooms", "area_sqft", "price", "max_price", "is_available", "external_url", "floor_level", "facing",
)
_FOLDED_PLANS = """
rp AS (SELECT x.* FROM (SELECT pl.*, row_number() OVER (PARTITION BY pl.plan_id ORDER BY pl.min_price NULLS LAST, pl.pos) AS rn FROM pl) x WHERE x.rn = 1),
en AS (SELECT pl.plan_id, min(pl.min_price) AS lo, max(pl.min_price) AS hi FROM pl GROUP BY 1),
fr AS (SELECT s.* REPLACE (coalesce(nullif(s.name, ''), 'Unit') AS name), np.id AS nid FROM san s JOIN np ON np.apartment_id = s.apartment_id AND np.pos = s.pos),
al AS (SELECT p.id, p.apartment_id, p.name, p.bedrooms, p.bathrooms, p.area_sqft, p.price, p.max_price, p.is_available, p.external_url, p.floor_level,
  p.facing FROM named p UNION ALL SELECT fr.nid, fr.apartment_id, fr.name, fr.bedrooms, coalesce(nullif(fr.bathrooms, 0), 1),
  coalesce(fr.size_sqft, 0), fr.min_price, NULL, true, NULL, NULL, NULL FROM fr)
SELECT al.id, al.apartment_id, CASE WHEN rp.name <> '' AND coalesce(al.name, '') IN ('', 'Unit') THEN rp.name ELSE al.name END AS name,
  coalesce(rp.bedrooms, al.bedrooms) AS bedrooms, coalesce(rp.bathrooms, al.bathrooms) AS bathrooms,
  CASE WHEN rp.size_sqft IS NOT NULL AND (al.area_sqft IS NULL OR abs(al.area_sqft - rp.size_sqft) > 10) THEN rp.size_sqft ELSE al.area_sqft END AS area_sqft,
  CASE WHEN rp.plan_id IS NOT NULL THEN en.lo ELSE al.price END AS price,
  CASE WHEN rp.plan_id IS NOT NULL THEN nullif(en.hi, en.lo) ELSE al.max_price END AS max_price,
  CASE WHEN rp.plan_id IS NOT NULL THEN true WHEN al.apartment_id IN (SELECT pl.apartment_id FROM pl) THEN false ELSE al.is_available END AS is_available,
  coalesce(nullif(rp.external_url, ''), al.external_url) AS external_url, coalesce(rp.floor_level, al.floor_level) AS floor_level,
  coalesce(nullif(rp.facing, ''), al.facing) AS facing
FROM al LEFT JOIN rp ON rp.plan_id = al.id LEFT JOIN en ON en.plan_id = al.id
"""
_PLANS_AFTER = f"WITH RECURSIVE {_PLACED}, {_FOLDED_PLANS}"


@query("m07_apply_snapshot_plans", _PLANS_AFTER)
def m07(t):
    return _applied(t)["plans"].select(*_PLAN_COLUMNS)


@query("m07_refreshed_store", _PLANS_AFTER)
def m07_store(t):
    """The same merge over stored tables, bucket by bucket."""
    store = refresh.new_store(shared_folder(t.spark, "store"), t.apartments, t.plans, t.units, t.subscriptions, buckets=32)
    refresh.refresh(t.spark, store, t.snapshot, AS_OF, 1, _HOSTS, _scraped(t))
    return store.plans.read(t.spark).select(*_PLAN_COLUMNS)


@query("m07_apply_snapshot_history", f"""
WITH RECURSIVE {_PLACED} SELECT pl.plan_id, min(pl.min_price) AS price, @ts'2001-11-05 00:00:00' AS recorded_at FROM pl GROUP BY pl.plan_id
HAVING min(pl.min_price) IS NOT NULL
""")
def m07_history(t):
    return _applied(t)["history"]


@query("m07_apply_snapshot_units", f"""
WITH RECURSIVE {_PLACED}, {_UNITS.format(src='pl', flag='true')}
SELECT un.id, un.plan_id, un.unit_number, un.price, un.area_sqft, un.is_available FROM un
""")
def m07_units(t):
    return _applied(t)["units"].select("id", "plan_id", "unit_number", "price", "area_sqft", "is_available")


@query("m07_apply_snapshot_rules", f"""
WITH RECURSIVE {_PLACED}, {_UNITS.format(src='pl', flag='true')}
SELECT s.id, s.is_active AND NOT coalesce(NOT un.is_available, false) AS is_active FROM subscriptions s LEFT JOIN un ON un.id = s.unit_id
  AND un.plan_id IN (SELECT p.id FROM plans p WHERE p.apartment_id IN (SELECT x.apartment_id FROM san x)
  UNION ALL SELECT np.id FROM np WHERE np.apartment_id IN (SELECT x.apartment_id FROM san x))
""")
def m07_rules(t):
    return _applied(t)["rules"].select("id", "is_active")


@query("m07_apply_snapshot_notices", f"""
WITH RECURSIVE {_PLACED}, {_UNITS.format(src='pl', flag='true')}
SELECT s.id AS subscription_id, s.user_id, s.unit_id, 'unit_unavailable' AS trigger_type, @ts'2001-11-05 00:00:00' AS sent_at
FROM subscriptions s JOIN un ON un.id = s.unit_id JOIN plans p ON p.id = un.plan_id
WHERE s.is_active AND NOT un.is_available AND p.apartment_id IN (SELECT x.apartment_id FROM san x)
""")
def m07_notices(t):
    return _applied(t)["notices"]


@query("m08_stale_plans", """
SELECT p.id, p.is_available AND NOT (EXISTS (SELECT 1 FROM snapshot s WHERE s.apartment_id = p.apartment_id)
  AND NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.apartment_id = p.apartment_id AND s.name = p.name)) AS is_available FROM plans p
""")
def m08(t):
    return G.mark_stale_plans(t.plans, t.snapshot).select("id", "is_available")


@query("m09_pause_unit_alerts", """
SELECT s.id, s.is_active AND NOT EXISTS (SELECT 1 FROM units u JOIN plans p ON p.id = u.plan_id JOIN snapshot x ON x.apartment_id = p.apartment_id
  WHERE u.id = s.unit_id AND NOT u.is_available) AS is_active FROM subscriptions s
""")
def m09(t):
    return G.pause_let_units(t.subscriptions, t.units, t.plans, t.snapshot).select("id", "is_active")


_AMENITIES = """
SELECT a.id, coalesce(CASE a.id % 5 WHEN 0 THEN true WHEN 1 THEN false END, a.pets_allowed) AS pets_allowed,
  coalesce(CASE a.id % 7 WHEN 0 THEN false END, a.has_parking) AS has_parking,
  CASE WHEN a.id % 2 = 0 THEN CASE WHEN a.id % 3 = 1 THEN 'Half off' END ELSE a.current_special END AS current_special
FROM (SELECT x.* REPLACE (x.id AS id) FROM apartments x) a WHERE a.id % 2 = 0
UNION ALL SELECT a.id, a.pets_allowed, a.has_parking, a.current_special FROM apartments a WHERE a.id % 2 <> 0
"""


def _scraped(t):
    i = F.col("id")
    return t.apartments.where(i % 2 == 0).select(
        "id", F.when(i % 5 == 0, True).when(i % 5 == 1, False).alias("pets_allowed"),
        F.when(i % 7 == 0, False).alias("has_parking"), F.when(i % 3 == 1, "Half off").alias("current_special"),
    )


@query("m10_amenities_and_special", _AMENITIES)
def m10(t):
    return G.merge_amenities(t.apartments, _scraped(t), ["pets_allowed", "has_parking"], ["current_special"]).select(
        "id", "pets_allowed", "has_parking", "current_special"
    )


@query("m07_apply_snapshot_listings", _AMENITIES)
def m07_listings(t):
    return _applied(t)["apartments"].select("id", "pets_allowed", "has_parking", "current_special")


@query("m11_suppression_merge", """
WITH l AS (SELECT r.url, r.run_at, r.id, r.outcome, CASE WHEN r.outcome IN ('success','content_unchanged','cache_hit','platform_direct') THEN 1
    WHEN r.outcome IN ('validated_fail','hard_fail') THEN 0 END AS ok FROM runs r),
s AS (SELECT x.*, sum(x.ok) OVER (PARTITION BY x.url ORDER BY x.run_at DESC, x.id DESC) AS later FROM l x WHERE x.ok IS NOT NULL),
f AS (SELECT s.url, min(s.run_at) AS a, max(s.run_at) AS b, count(*) AS n, arg_max(s.outcome, s.run_at) AS why FROM s WHERE s.later = 0 GROUP BY s.url),
k AS (SELECT u.* FROM suppression u WHERE u.url NOT IN (SELECT l.url FROM l WHERE l.ok = 1)),
m AS (SELECT coalesce(k.url, f.url) AS url, coalesce(k.first_failed_at, f.a) AS first_failed_at, coalesce(f.b, k.last_failed_at) AS last_failed_at,
  coalesce(f.why, k.last_reason) AS last_reason, coalesce(k.attempt_count, 0) + coalesce(f.n, 0) AS attempt_count, f.b AS fb, k.retry_after AS kr
  FROM k FULL JOIN f ON f.url = k.url)
SELECT m.url, m.first_failed_at, m.last_failed_at, m.last_reason, m.attempt_count, CASE WHEN m.fb IS NULL THEN m.kr
  ELSE m.fb + CASE WHEN m.attempt_count = 1 THEN interval '7' day WHEN m.attempt_count = 2 THEN interval '14' day ELSE interval '30' day END END
  AS retry_after FROM m
""")
def m11(t):
    return backoff.merge(t.suppression, t.runs)


_DUPS = r"""kx AS (SELECT a.id, regexp_replace(lower(regexp_extract(a.source_url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')
    || regexp_replace(rtrim(regexp_extract(a.source_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/floor-?plans$', '') AS k,
  (SELECT count(*) FROM plans p WHERE p.apartment_id = a.id) AS n, NOT contains(a.source_url, 'utm_') AS canonical FROM apartments a
  WHERE a.source_url IS NOT NULL),
kr AS (SELECT kx.*, first_value(kx.id) OVER (PARTITION BY kx.k ORDER BY kx.n DESC, kx.canonical DESC, kx.id) AS keep_id FROM kx),
du AS (SELECT kr.id AS kill_id, kr.keep_id FROM kr WHERE kr.id <> kr.keep_id)"""


@query("m12_archive_plans", f"""
WITH {_DUPS} SELECT p.id, p.is_available AND du.kill_id IS NULL AS is_available,
  CASE WHEN du.kill_id IS NULL THEN p.name ELSE '[archived dup] ' || p.name END AS name
FROM plans p LEFT JOIN du ON du.kill_id = p.apartment_id
""")
def m12(t):
    return G.archive_plans(t.plans, G.duplicate_map(t.apartments, t.plans)).select("id", "is_available", "name")


@query("m12_archive_apartments", f"""
WITH {_DUPS} SELECT a.id, a.is_available AND du.kill_id IS NULL AS is_available,
  CASE WHEN du.kill_id IS NULL THEN a.data_source_type ELSE 'unscrapeable' END AS data_source_type,
  CASE WHEN du.kill_id IS NULL THEN a.title ELSE '[archived dup of ' || cast(du.keep_id AS string) || '] ' || a.title END AS title
FROM apartments a LEFT JOIN du ON du.kill_id = a.id
""")
def m12_apartments(t):
    return G.archive_apartments(t.apartments, G.duplicate_map(t.apartments, t.plans)).select("id", "is_available", "data_source_type", "title")


@query("m13_duplicate_map", f"WITH {_DUPS} SELECT du.kill_id, du.keep_id FROM du")
def m13(t):
    return G.duplicate_map(t.apartments, t.plans)


@query("m14_move_rules", f"""
WITH {_DUPS} SELECT s.id, coalesce(du.keep_id, s.apartment_id) AS apartment_id, CASE WHEN du.keep_id IS NULL THEN s.baseline_price ELSE
  (SELECT min(p.current_price) FROM plans p WHERE p.apartment_id = du.keep_id AND p.is_available AND p.current_price IS NOT NULL) END AS baseline_price
FROM subscriptions s LEFT JOIN du ON du.kill_id = s.apartment_id
""")
def m14(t):
    return G.move_rules(t.subscriptions, G.duplicate_map(t.apartments, t.plans), t.plans).select("id", "apartment_id", "baseline_price")


@query("m15_reparent_plans", f"""
WITH {_DUPS} SELECT p.id, coalesce(du.keep_id, p.apartment_id) AS apartment_id FROM plans p LEFT JOIN du ON du.kill_id = p.apartment_id
""")
def m15(t):
    return G.move_children(t.plans, G.duplicate_map(t.apartments, t.plans)).select("id", "apartment_id")


@query("m15_drop_parents", f"WITH {_DUPS} SELECT a.id, a.title FROM apartments a WHERE a.id NOT IN (SELECT du.kill_id FROM du)")
def m15_parents(t):
    return G.drop_parents(t.apartments, G.duplicate_map(t.apartments, t.plans)).select("id", "title")


@query("m16_backfill_baselines", f"""
WITH {_LAST}, {_AREA.format(extra='AND p.price IS NOT NULL').replace('s.unit_id IS NULL AND ', '')},
mp AS (SELECT p.apartment_id, min(p.price) AS price FROM plans p WHERE p.is_available AND p.price IS NOT NULL GROUP BY 1)
SELECT s.id, CASE WHEN s.plan_id IS NOT NULL THEN coalesce(lt.p1, p.price) WHEN s.apartment_id IS NOT NULL THEN mp.price ELSE ar.price END
  AS baseline_price, s.created_at AS baseline_recorded_at
FROM subscriptions s LEFT JOIN lt ON lt.plan_id = s.plan_id LEFT JOIN plans p ON p.id = s.plan_id
LEFT JOIN mp ON mp.apartment_id = s.apartment_id LEFT JOIN ar ON ar.id = s.id
""")
def m16(t):
    return G.backfill_baselines(t.subscriptions, t.plans, t.apartments, t.price_history).select("id", "baseline_price", "baseline_recorded_at")


@query("m17_backfill_current_price", f"""
WITH {_LAST} SELECT p.id, lt.p1 AS current_price FROM plans p LEFT JOIN lt ON lt.plan_id = p.id
""")
def m17(t):
    return G.backfill_current_price(t.plans, t.price_history).select("id", "current_price")


@query("m18_deactivate_area_rules", """
SELECT s.id, s.is_active AND NOT (s.plan_id IS NULL AND s.apartment_id IS NULL) AS is_active FROM subscriptions s
""")
def m18(t):
    return G.deactivate_area_rules(t.subscriptions).select("id", "is_active")


@query("m19_seed_registry", """
SELECT DISTINCT lower(regexp_extract(a.source_url, '^[a-z]+://([^/?#]*)', 1)) AS domain, true AS is_active, 'brand_site' AS data_source_type
FROM apartments a WHERE a.source_url IS NOT NULL AND lower(regexp_extract(a.source_url, '^[a-z]+://([^/?#]*)', 1)) NOT IN
  (SELECT r.domain FROM registry r)
""")
def m19(t):
    return G.seed_registry(t.apartments, t.registry).drop("robots_txt_allows")


@query("m20_mirror_class", """
SELECT a.id, coalesce((SELECT arg_max(r.data_source_type, (length(r.domain), r.domain)) FROM registry r WHERE contains(lower(a.source_url), r.domain)),
  a.data_source_type) AS data_source_type FROM apartments a
""")
def m20(t):
    return G.mirror_class(t.apartments, t.registry).select("id", "data_source_type")


@query("m21_reclassify", """
SELECT a.id, CASE WHEN a.id % 10 = 3 THEN 'brand_site' WHEN a.id % 10 = 4 THEN 'legal_block' ELSE a.data_source_type END AS data_source_type,
  CASE WHEN a.id % 10 IN (3, 4) THEN NULL ELSE a.last_content_hash END AS last_content_hash FROM apartments a
""")
def m21(t):
    k = F.col("id") % 10
    mapping = t.apartments.where(k.isin(3, 4)).select("id", F.when(k == 3, "brand_site").otherwise("legal_block").alias("new_type"))
    return G.reclassify(t.apartments, mapping).select("id", "data_source_type", "last_content_hash")


@query("m22_single_primary_image", """
SELECT i.id, i.apartment_id, i.is_primary AND i.id = first_value(i.id) OVER (PARTITION BY i.apartment_id ORDER BY i.is_primary DESC,
  i.created_at DESC, i.id DESC) AS is_primary FROM images i
""")
def m22(t):
    return G.single_primary(t.images).select("id", "apartment_id", "is_primary")


@query("m23_unsubscribe_all", """
SELECT s.id, s.is_active AND s.user_id % 7 <> 0 AS is_active FROM subscriptions s
""")
def m23(t):
    owners = t.subscriptions.where(F.col("user_id") % 7 == 0).select("user_id")
    return G.unsubscribe_all(t.subscriptions, owners).select("id", "is_active")


@query("m23_link_channel", """
SELECT s.id, CASE WHEN s.user_id % 6 = 0 AND s.is_active THEN true WHEN s.user_id % 6 = 1 THEN false ELSE s.notify_telegram END AS notify_telegram,
  CASE WHEN s.user_id % 6 = 0 AND s.is_active THEN 'c' || cast(s.user_id AS string) WHEN s.user_id % 6 = 1 THEN NULL ELSE s.telegram_chat_id END
  AS telegram_chat_id FROM subscriptions s
""")
def m23_link(t):
    u = F.col("user_id")
    links = t.subscriptions.where((u % 6).isin(0, 1)).select(
        "user_id", F.when(u % 6 == 0, F.concat(F.lit("c"), u)).alias("chat_id")
    ).distinct()
    return G.link_channel(t.subscriptions, links).select("id", "notify_telegram", "telegram_chat_id")


@query("m25_cascade_delete", """
WITH d AS (SELECT a.id FROM apartments a WHERE NOT a.is_available), dp AS (SELECT p.id FROM plans p WHERE p.apartment_id IN (SELECT d.id FROM d))
SELECT 'apartments' AS tbl, count(*) AS n FROM apartments a WHERE a.id NOT IN (SELECT d.id FROM d)
UNION ALL SELECT 'plans', count(*) FROM plans p WHERE p.id NOT IN (SELECT dp.id FROM dp)
UNION ALL SELECT 'units', count(*) FROM units u WHERE u.plan_id NOT IN (SELECT dp.id FROM dp)
UNION ALL SELECT 'history', count(*) FROM price_history h WHERE h.plan_id NOT IN (SELECT dp.id FROM dp)
UNION ALL SELECT 'images', count(*) FROM images i WHERE i.apartment_id NOT IN (SELECT d.id FROM d)
""")
def m25(t):
    dead = t.apartments.where(~F.col("is_available")).select("id")
    left = G.cascade_delete(dead, t.apartments, t.plans, t.units, t.price_history, t.images)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("m26_adapter_hints", """
WITH k AS (SELECT x.* FROM (SELECT lower(regexp_extract(r.url, '^[a-z]+://([^/?#]*)', 1)) AS domain, r.adapter_name, r.run_at, row_number() OVER
    (PARTITION BY lower(regexp_extract(r.url, '^[a-z]+://([^/?#]*)', 1)) ORDER BY r.run_at DESC, r.id DESC) AS rn FROM runs r
  WHERE r.outcome IN ('platform_direct_static','platform_direct_rendered') AND r.adapter_name IS NOT NULL AND r.adapter_name <> 'universal_dom') x
  WHERE x.rn = 1)
SELECT g.domain, CASE WHEN k.domain IS NOT NULL THEN k.adapter_name ELSE g.last_successful_adapter END AS last_successful_adapter,
  CASE WHEN k.domain IS NOT NULL AND k.adapter_name IS DISTINCT FROM g.last_successful_adapter THEN k.run_at ELSE g.last_adapter_success_at END
  AS last_adapter_success_at FROM registry g LEFT JOIN k ON k.domain = g.domain
""")
def m26(t):
    return G.update_hints(t.registry, t.runs).select("domain", "last_successful_adapter", "last_adapter_success_at")


@query("m27_content_hash_split", """
SELECT a.id, CASE WHEN coalesce(a.last_content_hash = md5('page' || cast(a.id - a.id % 2 AS string)), false) THEN 'unchanged' ELSE 'changed' END AS part
FROM apartments a
""")
def m27(t):
    hashes = t.apartments.select("id", F.md5(F.concat(F.lit("page"), F.col("id") - F.col("id") % 2)).alias("new_hash"))
    changed, same = G.split_by_hash(t.apartments, hashes)
    return changed.select("id", F.lit("changed").alias("part")).unionByName(same.select("id", F.lit("unchanged").alias("part")))


@query("m28_default_children", """
SELECT p.id AS apartment_id, 'Default Plan' AS name, p.bedrooms, p.bathrooms, p.area_sqft, p.current_price AS price, p.is_available FROM plans p
WHERE p.bedrooms IS NOT NULL AND p.bathrooms IS NOT NULL AND p.area_sqft IS NOT NULL AND p.current_price IS NOT NULL
""")
def m28(t):
    return G.default_children(t.plans.drop("apartment_id", "name", "price"))


@query("m29_fold_first_child", """
SELECT a.id, p.bedrooms, p.bathrooms, p.area_sqft, p.price AS current_price, p.available_from FROM apartments a
LEFT JOIN plans p ON p.id = (SELECT min(q.id) FROM plans q WHERE q.apartment_id = a.id)
""")
def m29(t):
    return G.fold_first_child(t.apartments, t.plans).select("id", "bedrooms", "bathrooms", "area_sqft", "current_price", "available_from")
