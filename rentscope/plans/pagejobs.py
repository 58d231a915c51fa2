"""Extraction jobs over page tables."""

from pyspark.sql import functions as F

from rentscope.functions import pagetext as X
from rentscope.operators import pages as G
from rentscope.plans.registry import query

_HIDE = "regexp_replace({x}, '<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'gis')"


def _strip(x: str, tags=("script", "style")) -> str:
    for tag in tags:
        x = _HIDE.format(x=x, t=tag)
    return f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"


def _unescape(x: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _text(x: str) -> str:
    bare = f"regexp_replace({_strip(x)}, '<[^>]*>', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({_unescape(bare)}, '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def _inner(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return f"regexp_replace({_unescape(bare)}, '^\\s+|\\s+$', '', 'g')"


_TITLE = _inner("regexp_extract(d.html, '<title\\b[^>]*>(.*?)</title', 1, 'is')")
_SLUG = "regexp_extract(regexp_replace(regexp_extract(d.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1)"
_HEADS = ("list_transform(regexp_extract_all(" + _strip("d.html", ("script", "style", "noscript"))
          + ", '<h[123]\\b[^>]*>(.*?)</h[123]>', 1, 'is'), lambda h: " + _inner("h") + ")")
_NUMS = ("list_filter(list_transform(regexp_extract_all({t}, '\\$([\\d,]+)(?:\\s*[-–]\\s*\\$([\\d,]+))?', 1), "
         "lambda v: try_cast(replace(v, ',', '') AS double)), lambda v: v BETWEEN {lo} AND {hi})[1]")


def _num(x: str) -> str:
    return f"try_cast(replace({x}, ',', '') AS double)"


_HASH = _strip("g.html", ("script", "style", "noscript"))
for _p, _o in ((X.TOKEN[4:], "gi"), (X.SESSION[4:], "gi"), (X.ISO_TIME[4:], "gi"), (X.EPOCH_MS, "g")):
    _HASH = f"regexp_replace({_HASH}, '{_p}', '', '{_o}')"


@query("t01_content_hash", f"SELECT g.page_id, sha256(trim(regexp_replace({_HASH}, '\\s+', ' ', 'g'))) AS hash FROM pages g")
def t01(t):
    return t.pages.select("page_id", X.content_hash(F.col("html")).alias("hash"))


@query("t02_html_text", f"SELECT g.page_id, {_text('g.html')} AS text FROM pages g")
def t02(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"))


def _first_word(x: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{w}'" for w in words) + " END"


@query("t03_classify_pages", f"""
WITH z AS (SELECT d.page_id, lower(regexp_extract(d.url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, lower({_TITLE} || ' ' ||
  regexp_extract(regexp_extract(d.html, '<meta\\b[^>]*\\bname\\s*=\\s*"description"[^>]*>', 0, 'is'), '\\bcontent\\s*=\\s*"([^"]*)"', 1, 'is')) AS head,
  replace(lower({_text('d.html')}), chr(10), ' ') AS body FROM detail_pages d)
SELECT z.page_id, coalesce('domain is a hotel chain (' || {_first_word('z.host', X.HOTEL_DOMAINS)} || ')',
  'title/meta contains ''' || {_first_word('z.head', X.BAD_HEADER_WORDS)} || '''', 'page body contains ''' || {_first_word('z.body', X.BAD_BODY_WORDS)} || '''')
  AS reason FROM z
""")
def t03(t):
    return t.detail_pages.select("page_id", X.rejection(F.col("html"), F.col("url")).alias("reason"))


@query("t04_challenge_pages", """
SELECT d.page_id, length(d.html) <= 20000 AND ((contains(lower(d.html), 'just a moment') AND contains(lower(d.html), 'cloudflare'))
  OR contains(lower(d.html), 'cf-chl-') OR contains(lower(d.html), '__cf_bm')) AS challenge FROM detail_pages d
""")
def t04(t):
    return t.detail_pages.select("page_id", X.is_challenge(F.col("html")).alias("challenge"))


_HREFS = ("list_transform(regexp_extract_all(" + _strip("d.html", ("script", "style", "noscript"))
          + ", '<a\\b[^>]*?\\bhref\\s*=\\s*\"[^\"]*\"[^>]*>.*?</a', 0, 'is'), lambda a: regexp_extract(a, '\\bhref\\s*=\\s*\"([^\"]*)\"', 1, 'is'))")
_PLANLINKS = ("len(list_distinct(list_filter(" + _HREFS + ", lambda h: regexp_matches(h, '^(/floor-?plans?/[^/?#]{{2,}}/?|plans?/[^/?#]{{2,}}/?)$', 'i')"
              "))) >= 2").replace("{{", "{").replace("}}", "}")
_DETECT = {
    "jonah_digital": "contains(d.html, 'jd-fp-floorplan-card')", "fatwin": "contains(d.html, 'fatwin.com')",
    "leasingstar": "regexp_matches(d.html, 'c-leasestar-api\\.realpage\\.com|myleasestar\\.com', 'i') AND regexp_matches(d.html, 'var\\s+propertyId\\s*=')",
    "sightmap": "regexp_matches(d.html, 'https://sightmap\\.com/embed/([a-z0-9]{6,})|engrain[_-]?id=\"([a-z0-9]{6,})\"', 'i')",
    "rentcafe": "regexp_matches(d.html, '(?:cdngeneralmvc|api)\\.rentcafe\\.com', 'i')", "generic_detail": _PLANLINKS,
}
_PLATFORM = ("CASE " + " ".join(f"WHEN d.hint = '{n}' AND ({c}) THEN '{n}'" for n, c in _DETECT.items()) + " "
             + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _DETECT.items()) + " ELSE 'agent' END")


@query("t05_detect_platform", f"SELECT d.page_id, {_PLATFORM} AS platform FROM detail_pages d")
def t05(t):
    return G.detect_platform(t.detail_pages).select("page_id", "platform")


@query("a48_platform_coverage", f"""
WITH z AS (SELECT {_PLATFORM} AS platform FROM detail_pages d)
SELECT z.platform, count(*) AS n, (SELECT cast(floor(100 * count_if(y.platform <> 'agent') / count(*)) AS bigint) FROM z y) AS covered_pct
FROM z GROUP BY z.platform
""")
def a48(t):
    return G.platform_coverage(t.detail_pages)


@query("t06_plan_signals", r"""
SELECT d.page_id, length(d.html) >= 1000 AND (regexp_matches(lower(d.html), 'sightmap\.com|fatwin\.com|jd-fp-floorplan-card|cdngeneralmvc\.rentcafe\.com|api\.rentcafe\.com|fusion\.globalcontent|bozzuto\.com|entrata|realpage')
  OR regexp_matches(d.html, '<a[^>]+href="[^"]*(?:floor-?plans?|residences?|/plan-)[^"]*/[a-zA-Z0-9\-]+/?"', 'i')
  OR regexp_matches(d.html, '\$\d[\d,]*(?:\s*[/-]\s*\$?\d[\d,]*)?\s*(?:/\s*mo)?[\s\S]{0,200}?\d+\s*bed', 'i')) AS enough FROM detail_pages d
""")
def t06(t):
    return t.detail_pages.select("page_id", X.has_plan_signals(F.col("html"), 1_000).alias("enough"))


_LINKS = """lk AS (SELECT g.page_id, g.url AS page_url, unnest(regexp_extract_all({h}, '<a\\b[^>]*?\\bhref\\s*=\\s*"[^"]*"[^>]*>.*?</a', 0, 'is')) AS tag,
  generate_subscripts(regexp_extract_all({h}, '<a\\b[^>]*?\\bhref\\s*=\\s*"[^"]*"[^>]*>.*?</a', 0, 'is'), 1) - 1 AS pos FROM {src} g),
ln AS (SELECT lk.page_id, lk.page_url, lk.pos, regexp_extract(lk.tag, '\\bhref\\s*=\\s*"([^"]*)"', 1, 'is') AS href, {inner} AS text FROM lk),
ab AS (SELECT ln.*, CASE WHEN regexp_matches(ln.href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ln.href
    WHEN starts_with(ln.href, '/') THEN regexp_extract(ln.page_url, '^([a-zA-Z]+://[^/?#]*)', 1) || ln.href
    WHEN starts_with(ln.href, '#') THEN regexp_replace(ln.page_url, '#.*$', '') || ln.href
    ELSE regexp_replace(regexp_replace(ln.page_url, '[?#].*$', ''), '[^/]*$', '') || ln.href END AS url FROM ln)"""


def _links_sql(src: str) -> str:
    return _LINKS.format(h=_strip("g.html", ("script", "style", "noscript")), src=src,
                         inner=_inner("regexp_extract(lk.tag, '^<a\\b[^>]*>(.*)</a$', 1, 'is')"))


@query("t07_links", f"WITH {_links_sql('pages')} SELECT ab.page_id, ab.pos, ab.href, ab.text, ab.url FROM ab")
def t07(t):
    return G.links(t.pages).select("page_id", "pos", "href", "text", "url")


@query("t07_plan_links", f"""
WITH {_links_sql('detail_pages')}, u AS (SELECT ab.page_id, ab.url, min(ab.pos) AS pos FROM ab WHERE ab.href <> '' AND NOT regexp_matches(ab.href,
  '^(#|mailto:|tel:|javascript:)') AND regexp_matches(regexp_extract(ab.url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1),
  '/floor-?plans?/[^/?#]{{2,}}/?$|/plans?/[^/?#]{{2,}}/?$|/residences?/[^/?#]{{2,}}/?$|/[^/?#]+/plan-[^/?#]+/?$', 'i') GROUP BY 1, 2)
SELECT u.page_id, u.url, u.pos FROM u WHERE u.page_id IN (SELECT v.page_id FROM u v GROUP BY 1 HAVING count(*) >= 2)
""")
def t07_plans(t):
    return G.plan_links(t.detail_pages).select("page_id", "url", "pos")


@query("t08_keyword_links", f"""
WITH {_links_sql('detail_pages')} SELECT DISTINCT ab.page_id, ab.url FROM ab WHERE regexp_matches(lower(ab.text), 'availability|floor|plans|pricing')
""")
def t08(t):
    return G.keyword_links(t.detail_pages)


def _case(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {w}" for p, w in rules) + " ELSE 0 END"


_SCORE = (_case("lower(ab.text)", X.TEXT_GOOD) + " + " + _case("lower(ab.href)", X.HREF_GOOD) + " + " + _case("lower(ab.text)", X.TEXT_BAD)
          + " + " + _case("lower(ab.href)", X.HREF_BAD)
          + " + CASE WHEN starts_with(ab.href, 'http') AND lower(regexp_extract(ab.href, '^[a-zA-Z]+://([^/?#]*)', 1)) NOT IN ('', "
          "lower(regexp_extract(ab.page_url, '^[a-zA-Z]+://([^/?#]*)', 1))) AND NOT regexp_matches(lower(regexp_extract(ab.href, "
          "'^[a-zA-Z]+://([^/?#]*)', 1)), 'sightmap|rentcafe|entrata|yardi') THEN -20 ELSE 0 END")


@query("t09_link_scores", f"WITH {_links_sql('detail_pages')} SELECT ab.page_id, ab.pos, ab.href, {_SCORE} AS score FROM ab WHERE ab.text <> ''")
def t09(t):
    return G.scored_links(t.detail_pages).select("page_id", "pos", "href", "score")


@query("o13_ranked_links", f"""
WITH {_links_sql('detail_pages')}, s AS (SELECT ab.page_id, ab.pos, ab.href, {_SCORE} AS score FROM ab WHERE ab.text <> ''),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.page_id ORDER BY s.score DESC, s.pos) AS rank FROM s)
SELECT r.page_id, r.pos, r.href, r.score, r.rank FROM r WHERE r.rank <= 3
""")
def o13(t):
    return G.ranked_links(t.detail_pages, 3).select("page_id", "pos", "href", "score", "rank")


@query("t10_content_blob_units", """
SELECT p.p_partkey AS page_id, 0 AS pos, 'A' || cast(p.p_partkey % 9 AS string) AS plan_name, cast(p.p_partkey AS string) || '-1' AS unit_number,
  cast(p.p_size % 4 AS double) AS bedrooms, 1.0::double AS bathrooms, cast(p.p_size * 20 AS double) AS size_sqft, 3 AS floor_level,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL WHEN p.p_partkey % 3 = 0 THEN 2500 ELSE cast(2000 + p.p_size AS double) END AS price,
  CASE WHEN p.p_partkey % 5 = 0 THEN 'unavailable' ELSE 'Available 2026-06-01' END AS availability FROM part p
UNION ALL SELECT p.p_partkey, 2, 'B1', '9', 0, 1, NULL, NULL, NULL, 'Available Now' FROM part p
""")
def t10(t):
    return G.content_blob_units(t.blob_pages)


@query("t11_availability_blob_plans", """
SELECT p.p_partkey AS page_id, 0 AS pos, 'One' AS plan_name, 1.0::double AS bedrooms, 1.0::double AS bathrooms, 650.0::double AS size_sqft,
  1900.0::double AS price FROM part p
UNION ALL SELECT p.p_partkey, 2, 'Two', 2, NULL, NULL, NULL FROM part p
""")
def t11(t):
    return G.availability_blob_plans(t.blob_pages).drop("unit_number", "floor_level", "availability")


@query("t12_structured_places", """
SELECT p.p_partkey AS page_id, 0 AS pos, 'Alder' || cast(p.p_partkey % 7 AS string) AS plan_name, 2.0::double AS bedrooms, 1.0::double AS bathrooms FROM part p
UNION ALL SELECT p.p_partkey, 1, 'Birch', 0, 1 FROM part p
""")
def t12(t):
    return G.structured_places(t.blob_pages).select("page_id", "pos", "plan_name", "bedrooms", "bathrooms")


@query("t13_name_anchored_prices", f"""
WITH b AS (SELECT x.page_id, {_text('x.html')} AS t, ['Alder' || cast(x.page_id % 7 AS string), 'Birch'] AS names FROM blob_pages x),
n AS (SELECT b.page_id, b.t, unnest(b.names) AS plan_name, unnest([0, 1]) AS pos FROM b),
p AS (SELECT n.*, {_num("nullif(regexp_extract(substring(n.t, cast(instr(n.t, n.plan_name) AS int), 600), '[$]([0-9,]+)', 1), '')")} AS v FROM n),
q AS (SELECT p.*, CASE WHEN p.v BETWEEN 500 AND 20000 THEN p.v END AS near FROM p)
SELECT q.page_id, cast(q.pos AS int) AS pos, q.plan_name, q.near AS price FROM q
""")
def t13(t):
    return G.structured_places_priced(t.blob_pages).select("page_id", "pos", "plan_name", "price")


@query("t14_tagged_units", """
SELECT p.p_partkey AS page_id, 'S1' AS plan_name, 1.0::double AS bedrooms, 1.0::double AS bathrooms, 500.0::double AS size_sqft,
  CASE WHEN p.p_partkey % 2 = 0 THEN least(2100 + p.p_size, 2500) ELSE 2500 END::double AS price, 'available' AS availability FROM part p
""")
def t14(t):
    return G.tagged_units(t.blob_pages).drop("pos", "unit_number", "floor_level")


@query("t15_call_arguments", """
SELECT p.p_partkey AS page_id, 'L' AS name, 3.0::double AS bedrooms, 1449.0::double AS size_sqft,
  CASE WHEN p.p_partkey % 4 <> 0 THEN cast(6000 + p.p_size AS double) END AS min_price, 8306.0::double AS max_price FROM part p
""")
def t15(t):
    return G.call_arguments(t.blob_pages).drop("pos")


_DTEXT = f"z AS (SELECT d.*, {_text('d.html')} AS t, {_TITLE} AS title, {_HEADS} AS heads, {_SLUG} AS slug FROM detail_pages d)"
_HEAD1 = "trim(split_part(z.title, '|', 1))"


@query("t16_detail_plans", f"""
WITH {_DTEXT} SELECT z.page_id, coalesce(list_filter(z.heads, lambda h: length(h) > 1 AND length(h) < 80 AND NOT regexp_matches(h, '{X.HEADING_NOISE[4:]}', 'i')
  AND NOT regexp_matches(h, '{X.HEADING_ACTIONS[4:]}', 'i'))[1], CASE WHEN {_HEAD1} <> '' AND length({_HEAD1}) < 80 AND NOT regexp_matches({_HEAD1},
  '{X.HEADING_ACTIONS[4:]}', 'i') THEN {_HEAD1} END, z.slug) AS plan_name,
  coalesce(try_cast(regexp_extract(z.t, '(\\d+)\\s*(?:bed(?:room)?s?)\\b', 1, 'i') AS double), 0) AS bedrooms,
  {_num(f"regexp_extract(z.t, '{X.SQFT_DETAIL[4:]}', 1, 'i')")} AS size_sqft, {_NUMS.format(t='z.t', lo=500, hi=20000)} AS price FROM z
""")
def t16(t):
    return G.detail_plans(t.detail_pages)


_SPEC = X.SPEC_LINE[5:]


@query("t17_spec_line_plans", f"""
WITH {_DTEXT}, y AS (SELECT z.*, {_num(f"coalesce(nullif(regexp_extract(z.t, '{X.BASE_RENT[4:]}', 1, 'i'), ''), nullif(regexp_extract(z.t, '{X.BASE_RENT[4:]}', 2, 'i'), ''))")} AS rent FROM z)
SELECT y.page_id, coalesce(nullif(trim(split_part(y.title, '|', 1)), ''), y.slug) AS plan_name,
  coalesce(try_cast(regexp_extract(regexp_extract(y.t, '{_SPEC}', 1, 'is'), '(\\d+)', 1) AS double), 0) AS bedrooms,
  {_num(f"regexp_extract(y.t, '{_SPEC}', 3, 'is')")} AS size_sqft, CASE WHEN y.rent BETWEEN 1500 AND 20000 THEN y.rent END AS price FROM y
""")
def t17(t):
    return G.spec_line_plans(t.detail_pages)


_BED, _SQ = X.BEDS[4:], X.SQFT_PLAIN[4:]


@query("t18_nearest_bed_plans", f"""
WITH {_DTEXT}, y AS (SELECT z.*, length(string_split_regex(z.t, '{_SQ}', 'i')[1]) AS at, string_split_regex(z.t, '{_BED}', 'i') AS gaps,
  regexp_extract_all(z.t, '{_BED}', 0, 'i') AS hits, list_filter(z.heads, lambda h: h <> '' AND length(h) < 80 AND NOT regexp_matches(h, '{X.HEADING_NOISE_WIDE[4:]}', 'i')) AS fine FROM z),
m AS (SELECT y.page_id, y.at, unnest(y.hits) AS hit, unnest(list_transform(range(1, len(y.hits) + 1), lambda i:
  list_sum(list_transform(y.gaps[1:i], lambda g: length(g))) + list_sum(list_transform(y.hits[1:i], lambda g: length(g))))) AS fin,
  generate_subscripts(y.hits, 1) AS i FROM y),
b AS (SELECT m.page_id, arg_min(m.hit, abs(m.at - m.fin) * 1000 + m.i) AS hit FROM m GROUP BY m.page_id)
SELECT y.page_id, coalesce(list_filter(y.fine, lambda h: upper(h) = upper(y.slug))[1], y.fine[1], y.slug) AS plan_name,
  CASE WHEN NOT regexp_matches(y.t, '{_SQ}', 'i') THEN coalesce(try_cast(regexp_extract(y.t, '{_BED}', 1, 'i') AS double), 0)
    WHEN regexp_matches(y.t[greatest(y.at - 59, 1):y.at + 20], '\\bstudio\\b', 'i') THEN 0
    ELSE coalesce(try_cast(regexp_extract(b.hit, '(\\d+)', 1) AS double), 0) END AS bedrooms,
  {_num(f"regexp_extract(y.t, '{_SQ}', 1, 'i')")} AS size_sqft, {_NUMS.format(t='y.t', lo=500, hi=20000)} AS price
FROM y LEFT JOIN b ON b.page_id = y.page_id
""")
def t18(t):
    return G.nearest_bed_plans(t.detail_pages)


_NAMEOK = (f"regexp_matches(s, '{X.P.PLAN_NAME}') AND NOT regexp_matches(s, '{X.P.NOT_PLAN_PREFIX[4:]}', 'i') AND NOT regexp_matches(s, '{X.P.UNIT_NUMBER}') "
           f"AND lower(s) NOT IN {X.P.CONTROL_LABELS} AND NOT regexp_matches(s, '[$]|\\d+\\s*Bed|sq\\.?\\s*ft|waitlist', 'i') "
           "AND NOT regexp_matches(upper(s), '^(?:HOME|APT)\\s+\\w+')")


def _line(pattern: str) -> str:
    return f"list_filter(l.body, lambda s: regexp_matches(s, '{pattern}', 'i'))"


def _bounded(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 500 AND 25000 THEN {x} END"


_RB, _RA, _RM, _RS = X.RENT_BEFORE[4:], X.RENT_AFTER[4:], X.RENT_MONTH[4:], X.RENT_ALONE


@query("t19_unit_blocks", f"""
WITH bl AS (SELECT u.page_id, unnest(string_split(regexp_replace(u.text, '\\n((?:HOME|APT)\\s+\\w+)', chr(1) || '\\1', 'g'), chr(1))) AS block FROM unit_texts u),
ls AS (SELECT bl.page_id, list_filter(list_transform(string_split(bl.block, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS q FROM bl),
l AS (SELECT ls.page_id, ls.q[1] AS head, ls.q[2:] AS body FROM ls WHERE regexp_matches(ls.q[1], '^(?:HOME|APT)\\s+\\w+')),
p AS (SELECT l.*, {_line('studio|[0-9]+\\s*Bed')}[1] AS bl, {_line(_RB + '|' + _RA)}[1] AS r1, {_line(_RM)}[1] AS r2, {_line(_RS)}[1] AS r3 FROM l)
SELECT l.page_id, regexp_replace(l.head, '^(?:HOME|APT)\\s+', '') AS unit_number, list_filter(l.body, lambda s: {_NAMEOK})[1] AS plan_name,
  CASE WHEN regexp_matches(l.bl, '\\bstudio\\b', 'i') THEN 0 ELSE try_cast(regexp_extract(l.bl, '(\\d+)\\s*Bed', 1, 'i') AS double) END AS bedrooms,
  try_cast(regexp_extract({_line('[0-9]+\\s*Bath')}[1], '(\\d+)\\s*Bath', 1, 'i') AS double) AS bathrooms,
  {_num("regexp_extract(" + _line('[0-9,]+\\s*sq\\.?\\s*ft') + "[1], '([0-9,]+)\\s*sq\\.?\\s*ft', 1, 'i')")} AS size_sqft,
  coalesce({_bounded(_num(f"coalesce(nullif(regexp_extract(l.r1, '{_RB}', 1, 'i'), ''), nullif(regexp_extract(l.r1, '{_RA}', 1, 'i'), ''))"))},
    {_bounded(_num(f"regexp_extract(l.r2, '{_RM}', 1, 'i')"))}, {_bounded(_num(f"regexp_extract(l.r3, '{_RS}', 1, 'i')"))}) AS price,
  {_line('available|waitlist')}[-1] AS availability FROM p l
""")
def t19(t):
    return G.unit_blocks(t.unit_texts).select(
        "page_id", "unit_number", "plan_name", "bedrooms", "bathrooms", "size_sqft", "price", "availability"
    )


@query("t20_card_rent", f"""
WITH z AS (SELECT c.card_id, {_num(f"regexp_extract(c.text, '{X.CARD_RENT[4:]}', 1, 'i')")} AS m, list_filter(list_transform(regexp_extract_all(
  regexp_replace(regexp_replace(c.text, '{X.DEPOSIT[4:]}', '', 'gi'), '{X.FEE[4:]}', '', 'gi'), '{X.CARD_AMOUNT}', 1),
  lambda v: {_num('v')}), lambda v: v BETWEEN 1000 AND 25000)[1] AS b FROM cards c)
SELECT z.card_id, coalesce(CASE WHEN z.m BETWEEN 500 AND 25000 THEN z.m END, z.b) AS rent FROM z
""")
def t20(t):
    return t.cards.select("card_id", X.card_rent(F.col("text")).alias("rent"))


@query("t21_card_specs", f"""
SELECT c.card_id, CASE WHEN contains(lower(regexp_extract(c.text, '{X.CARD_BEDS[4:]}', 0, 'i')), 'studio') THEN 0
    ELSE try_cast(regexp_extract(c.text, '{X.CARD_BEDS[4:]}', 1, 'i') AS double) END AS bedrooms,
  try_cast(regexp_extract(c.text, '{X.CARD_BATHS[4:]}', 1, 'i') AS double) AS bathrooms, {_num(f"regexp_extract(c.text, '{X.CARD_SQFT[4:]}', 1, 'i')")} AS size_sqft,
  cast(regexp_matches(c.text, '{X.CARD_BEDS[4:]}', 'i') AS int) + cast(regexp_matches(c.text, '{X.CARD_BATHS[4:]}', 'i') AS int)
  + cast(regexp_matches(c.text, '{X.CARD_SQFT[4:]}', 'i') AS int) + cast(regexp_matches(c.text, '{X.CARD_PRICE_SIGNAL[4:]}', 'i') AS int) AS signals FROM cards c
""")
def t21(t):
    c = F.col("text")
    return t.cards.select(
        "card_id", X.card_beds(c).alias("bedrooms"), X.matched(c, X.CARD_BATHS).try_cast("double").alias("bathrooms"),
        X.number(X.matched(c, X.CARD_SQFT)).alias("size_sqft"), X.signal_count(c).alias("signals"),
    )


@query("t22_section_units", """
WITH s AS (SELECT x.page_id, unnest(string_split(regexp_replace(x.text, '(^|\\n)(PLAN\\s*[0-9]+)\\b', '\\1' || chr(1) || '\\2', 'gi'), chr(1))) AS s FROM plan_sections x),
p AS (SELECT s.page_id, s.s, regexp_extract(s.s, '^(PLAN\\s*[0-9]+)', 1, 'i') AS plan FROM s WHERE regexp_matches(s.s, '^PLAN\\s*[0-9]+', 'i')),
q AS (SELECT p.*, list_filter(string_split(regexp_extract(p.s, '^.*?\\n[ ]*[$]\\s*[0-9,]+[ ]*\\n(.*)$', 1, 's'), chr(10)), lambda y: regexp_matches(y, '[0-9]'))[1] AS size,
  trim(regexp_extract(p.s, '\\n([0-9]{2,4}(?: - [0-9]{2,4})?)\\n', 1)) AS guess,
  regexp_extract_all(p.s, '\\n([0-9]{1,2}\\s+[0-9]{1,4})\\s*\\n\\s*(.*?)\\n\\s*([$]\\s*[0-9,]+)\\s*\\n\\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|Today)\\b', 0, 's') AS us FROM p),
u AS (SELECT q.*, unnest(q.us) AS u FROM q)
SELECT u.page_id, u.plan, regexp_extract(u.u, '\\n\\s*([$]\\s*[0-9,]+)\\s*\\n', 1) AS price, regexp_extract(u.u, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|Today)$', 1) AS available,
  coalesce(nullif(trim(u.size), ''), u.guess) AS size FROM u
""")
def t22(t):
    return G.section_units(t.plan_sections)


@query("t23_embed_urls", """
SELECT d.page_id, coalesce(nullif(regexp_extract(d.html, 'https://sightmap\\.com/embed/([a-z0-9]{6,})', 0, 'i'), ''),
  'https://sightmap.com/embed/' || nullif(regexp_extract(d.html, 'engrain[_-]?id="([a-z0-9]{6,})"', 1, 'i'), '')) AS embed FROM detail_pages d
""")
def t23(t):
    return t.detail_pages.select("page_id", X.embed_url(F.col("html")).alias("embed"))


@query("t24_page_names", f"""
SELECT d.page_id, coalesce(nullif(trim(split_part(split_part({_TITLE}, '|', 1), '-', 1)), ''),
  nullif({_inner("regexp_extract(d.html, '<h1\\b[^>]*>(.*?)</h1', 1, 'is')")}, ''), d.url) AS name FROM detail_pages d
""")
def t24(t):
    return t.detail_pages.select("page_id", X.page_name(F.col("html"), F.col("url")).alias("name"))


_PRIO = "(" + " OR ".join(f"contains(lower(s), '{w}')" for w in X.PRICING_WORDS) + ")"


@query("t25_priority_text", f"""
WITH z AS (SELECT u.page_id, string_split(u.text, chr(10)) AS q FROM unit_texts u)
SELECT z.page_id, substring(array_to_string(list_concat(list_filter(z.q, lambda s: {_PRIO}), list_filter(z.q, lambda s: NOT {_PRIO})), chr(10)), 1, 80) AS text FROM z
""")
def t25(t):
    return t.unit_texts.select("page_id", X.prioritised(F.col("text"), 80).alias("text"))


@query("t26_typed_plans", """
SELECT s.pos AS page_id, coalesce(nullif(CASE WHEN s.pos % 5 = 0 THEN '' ELSE s.name END, ''), 'Unit') AS name,
  nullif(CASE WHEN s.pos % 4 = 0 THEN 0 ELSE s.size_sqft END, 0) AS size_sqft, nullif(CASE WHEN s.pos % 3 = 0 THEN 0 ELSE s.min_price END, 0) AS min_price,
  coalesce(s.availability, 'Available') AS availability FROM snapshot s
""")
def t26(t):
    i = F.col("pos")
    loose = t.snapshot.select(
        i.alias("page_id"), "pos", F.when(i % 5 == 0, "").otherwise(F.col("name")).alias("plan_name"), "unit_number", "bedrooms", "bathrooms",
        F.when(i % 4 == 0, 0.0).otherwise(F.col("size_sqft")).alias("size_sqft"),
        F.when(i % 3 == 0, 0.0).otherwise(F.col("min_price")).alias("price"), "availability",
    )
    return G.typed_plans(loose).select("page_id", "name", "size_sqft", "min_price", "availability")


@query("u01_extractor_registry")
def u01(t):
    pages = t.detail_pages.unionByName(t.blob_pages.select(F.col("page_id") + 1_000_000_000, "url", "html").toDF("page_id", "url", "html"), True)
    return G.extract_all(pages, hint="hint")


@query("u01_extracted_units", """
SELECT b.page_id, 'avalonbay' AS platform, count(*) AS n FROM (SELECT x.page_id, unnest([1, 2]) AS i FROM blob_pages x) b GROUP BY b.page_id
""")
def u01_units(t):
    return G.extract_all(t.blob_pages).groupBy("page_id", "platform").agg(F.count(F.lit(1)).alias("n"))


# A hint that applies goes first, one that does not apply or yields nothing is passed over; formats that yield nothing are passed over too.
@query("u01_hint_walk", """
SELECT b.page_id, CASE b.page_id % 4 WHEN 0 THEN 'greystar' ELSE 'avalonbay' END AS platform, CASE b.page_id % 4 WHEN 0 THEN 'Alder' || cast(b.page_id % 7 AS string)
  ELSE 'A' || cast(b.page_id % 9 AS string) END AS first_plan, 2 AS n FROM blob_pages b
UNION ALL SELECT -1 - d.page_id, CASE WHEN contains(d.html, 'jd-fp-floorplan-card') THEN 'jonah_digital' WHEN contains(d.html, 'fatwin.com') THEN 'fatwin' ELSE 'generic_detail' END,
  NULL, 1 FROM detail_pages d WHERE contains(d.html, 'jd-fp-floorplan-card') OR contains(d.html, 'fatwin.com') OR contains(d.html, '/floor-plans/b2')
""")
def u01_walk(t):
    i = F.col("page_id")
    blobs = t.blob_pages.select(
        "page_id", "url", "html", F.when(i % 4 == 0, "greystar").when(i % 4 == 1, "equity").when(i % 4 == 2, "no such format").alias("hint")
    )
    details = t.detail_pages.select((-1 - i).alias("page_id"), "url", "html", F.lit("rentcafe").alias("hint"))
    units = G.extract_all(blobs.unionByName(details), hint="hint")
    first = F.min_by("plan_name", "pos")
    return units.groupBy("page_id", "platform").agg(F.when(i >= 0, first).alias("first_plan"), F.count(F.lit(1)).alias("n"))
