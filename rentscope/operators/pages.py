"""Jobs over a table of pages: links, platform detection and extraction of plans and units."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentscope.functions import pagetext as X
from rentscope.functions import predicates as P
from rentscope.functions import urls as U
from rentscope.operators.scale import any_of, first_k, once

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'][^"']*["'][^>]*>.*?</a"""
# Fixed patterns: paths of a single plan's page.
PLAN_PATHS = (
    r"(?i)/floor-?plans?/[^/?#]{2,}/?$", r"(?i)/plans?/[^/?#]{2,}/?$", r"(?i)/residences?/[^/?#]{2,}/?$",
    r"(?i)/[^/?#]+/plan-[^/?#]+/?$",
)
# Words of link text that lead to prices.
LINK_WORDS = ("availability", "floor", "plans", "pricing")


HREF = r"""(?is)\bhref\s*=\s*["']([^"']*)["']"""
# Parts of a link by name, from its tag, its href and the page's address.
_LINK_PARTS = {
    "href": lambda tag, href, base: href,
    "text": lambda tag, href, base: X.inner_text(F.regexp_extract(tag, r"(?is)^<a\b[^>]*>(.*)</a$", 1)),
    "url": lambda tag, href, base: U.resolve(base, href),
}


def links(pages: DataFrame, parts: Sequence[str] = ("href", "text", "url")) -> DataFrame:
    """(page_id, page_url, pos, ``parts``): every link of a page in order; ``url`` is its address made absolute.

    The parts are made before the rows are: a condition on a column made after it would be moved ahead of that column, its expressions with
    it, and evaluate them again at each mention.  Outer, as in ``_exploded``.
    """

    def link(tag: Column) -> Column:
        href = X.unescaped(F.trim(F.regexp_extract(tag, HREF, 1)))
        return once(href, lambda h: F.struct(*[_LINK_PARTS[p](tag, h, F.col("url")).alias(p) for p in parts]))

    found = F.transform(F.regexp_extract_all(X.without_hidden(F.col("html")), F.lit(ANCHOR), F.lit(0)), link)
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode_outer(found).alias("pos", "_l"))
    return rows.where(F.col("pos").isNotNull()).select("page_id", "page_url", "pos", *[F.col("_l")[p].alias(p) for p in parts])


def _is_plan_path(url: Column) -> Column:
    return once(U.path_of(url), lambda path: any_of([path.rlike(p) for p in PLAN_PATHS]))


def plan_links(pages: DataFrame, min_links: int = 2) -> DataFrame:
    """Distinct plan-page addresses of pages with at least ``min_links`` of them, first place kept."""
    hits = links(pages, ("href", "url")).where(
        (F.col("href") != "") & ~F.col("href").rlike(r"^(#|mailto:|tel:|javascript:)") & _is_plan_path(F.col("url"))
    )
    unique = hits.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    # Counted beside the rows: a join with a count of them would read all pages again.
    counted = unique.where(F.col("page_id").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page_id")))
    return counted.where(F.col("_n") >= min_links).drop("_n")


def keyword_links(pages: DataFrame, words: Sequence[str] = LINK_WORDS) -> DataFrame:
    return links(pages, ("text", "url")).where(P.mentions_any(F.col("text"), words)).select("page_id", "url").distinct()


def scored_links(pages: DataFrame) -> DataFrame:
    return links(pages, ("href", "text")).where(F.col("text") != "").withColumn(
        "score", X.link_score(F.col("text"), F.col("href"), U.authority(F.col("page_url")))
    )


def ranked_links(pages: DataFrame, k: int = 20) -> DataFrame:
    """Best ``k`` links per page, page order on ties."""
    return first_k(scored_links(pages), ["page_id"], [F.desc("score"), F.col("pos")], k, "rank")


# --- embedded data ---------------------------------------------------------------------------

UNIT = "page_id long, pos int, plan_name string, unit_number string, bedrooms double, bathrooms double, size_sqft double, " \
       "floor_level int, price double, availability string"
_UNIT_COLUMNS = [c.split()[0] for c in UNIT.split(", ")]


def _as_units(df: DataFrame) -> DataFrame:
    """Common unit columns; those an extractor does not give are NULL."""
    types = dict(c.split() for c in UNIT.split(", "))
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in _UNIT_COLUMNS
    ])


_UNIT_TYPES = dict(c.split() for c in UNIT.split(", ") if not c.startswith("page_id "))
UNITS = "array<struct<" + ",".join(f"{c}:{t}" for c, t in _UNIT_TYPES.items()) + ">>"


def _unit(**values) -> Column:
    """One unit as a struct; columns that are not given are NULL."""
    return F.struct(*[(values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in _UNIT_TYPES.items()])


def _exploded(pages: DataFrame, units: Column) -> DataFrame:
    """The units of each page as rows.

    Outer, then without NULLs: an inner explode would be given a filter of its own that reads the page a second time.
    """
    rows = pages.select("page_id", units.cast(UNITS).alias("_u")).select("page_id", F.explode_outer("_u").alias("u"))
    return rows.where(F.col("u").isNotNull()).select("page_id", "u.*")


def _by_key(rows: Column, key: str, use: Callable[[Column], Column]) -> Column:
    """``use(rows of one key)`` for each key of an array of structs, keys in order of appearance."""
    keys = lambda r: F.array_distinct(F.transform(r, lambda x: x[key]))
    return once(rows, lambda r: F.transform(keys(r), lambda k: once(F.filter(r, lambda x: x[key] == k), use)))


def _first(rows: Column, field: str, known: bool = False) -> Column:
    """A field of the first row, or of the first row that knows it."""
    return F.get(F.filter(rows, lambda x: x[field].isNotNull()) if known else rows, F.lit(0))[field]


def _truthy(c: Column) -> Column:
    return F.when(~F.coalesce(c, F.lit("")).isin("", "0", "0.0", "false"), c)


CONTENT_BLOB = r"(?s)Fusion\.globalContent\s*=\s*(\{.+?);\s*Fusion\."
_BLOB_SCHEMA = (
    "units array<struct<unitName:string,floorPlan:struct<name:string>,bedroomNumber:string,bathroomNumber:string,squareFeet:string,"
    "floorNumber:string,unitStatus:string,availableDateUnfurnished:string,startingAtPricesUnfurnished:struct<moveInDate:string,"
    "prices:struct<netEffectivePrice:string,price:string,totalPrice:string>>>>"
)


def content_blob(html: Column) -> Column:
    """Units of the embedded content object: named plans only, price while available, date to the day."""

    def unit(u: Column, i: Column) -> Column:
        offer = u["startingAtPricesUnfurnished"]
        date = F.coalesce(_truthy(u["availableDateUnfurnished"]), _truthy(offer["moveInDate"]))
        free = F.coalesce(u["unitStatus"], F.lit("")).isin("VacantAvailable", "Available", "NoticeAvailable", "")
        price = F.coalesce(*[_truthy(offer["prices"][c]) for c in ("netEffectivePrice", "price", "totalPrice")]).try_cast("double")
        return _unit(
            pos=i, plan_name=F.trim(F.coalesce(u["floorPlan"]["name"], F.lit(""))), unit_number=F.nullif(F.trim(u["unitName"]), F.lit("")),
            bedrooms=F.coalesce(u["bedroomNumber"].try_cast("double"), F.lit(0.0)), bathrooms=F.coalesce(u["bathroomNumber"].try_cast("double"), F.lit(1.0)),
            size_sqft=_truthy(u["squareFeet"]).try_cast("int"), floor_level=_truthy(u["floorNumber"]).try_cast("int"), price=F.when(free, price),
            availability=F.when(~free, "unavailable").otherwise(
                F.coalesce(F.concat(F.lit("Available "), F.substring(date, 1, 10)), F.lit("Available Now"))
            ),
        )

    units = F.from_json(X.matched(html, CONTENT_BLOB), _BLOB_SCHEMA)["units"]
    return F.filter(F.transform(units, unit), lambda u: u["plan_name"] != "")


def content_blob_units(pages: DataFrame) -> DataFrame:
    return _exploded(pages, content_blob(F.col("html")))


AVAILABILITY_BLOB = r"(?s)ea5\.unitAvailability\s*=\s*(\{.*?\});\s*\n"
_AVAILABILITY_SCHEMA = (
    "BedroomTypes array<struct<AvailableUnits:array<struct<FloorplanId:string,FloorplanName:string,BestTerm:struct<Price:double>,"
    "SqFt:double,Bed:double,Bath:double,AvailableDate:string>>>>"
)


def availability_blob(html: Column) -> Column:
    """Plans of the embedded availability object: cheapest price, first known size and rooms."""
    types = F.from_json(X.matched(html, AVAILABILITY_BLOB), _AVAILABILITY_SCHEMA)["BedroomTypes"]
    rows = F.transform(F.flatten(F.transform(types, lambda b: b["AvailableUnits"])), lambda u, i: F.struct(
        i.alias("pos"), F.coalesce(F.nullif(u["FloorplanId"], F.lit("")), u["FloorplanName"], F.lit("")).alias("fp"),
        F.coalesce(u["FloorplanName"], F.lit("")).alias("plan_name"), u["BestTerm"]["Price"].alias("price"),
        F.when(u["SqFt"] != 0, u["SqFt"]).alias("size_sqft"), u["Bed"].alias("bedrooms"), u["Bath"].alias("bathrooms"),
    ))
    return _by_key(rows, "fp", lambda r: _unit(
        pos=_first(r, "pos"), plan_name=_first(r, "plan_name"), price=F.array_min(F.transform(r, lambda x: x["price"])),
        **{c: _first(r, c, known=True) for c in ("size_sqft", "bedrooms", "bathrooms")}, availability=F.lit("available"),
    ))


def availability_blob_plans(pages: DataFrame) -> DataFrame:
    return _exploded(pages, availability_blob(F.col("html")))


_PLACES_SCHEMA = (
    "`@type` string, containsPlace array<struct<`@type`:string,name:string,numberOfBedrooms:string,numberOfBathroomsTotal:string>>"
)


def _place_structs() -> Column:
    """Named accommodations of the first JSON-LD block of a lodging business."""
    raw = X.matched(F.col("html"), r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script""")
    lodging = once(F.from_json(raw, _PLACES_SCHEMA), lambda data: F.when(data["@type"] == "LodgingBusiness", data["containsPlace"]))
    kept = F.filter(lodging, lambda p: (p["@type"] == "Accommodation") & (F.trim(p["name"]) != ""))
    return F.transform(kept, lambda p: F.struct(
        F.trim(p["name"]).alias("plan_name"),
        F.coalesce(p["numberOfBedrooms"].try_cast("double"), F.lit(0.0)).alias("bedrooms"),
        F.coalesce(p["numberOfBathroomsTotal"].try_cast("double"), F.lit(1.0)).alias("bathrooms"),
    ))


def structured_places(pages: DataFrame) -> DataFrame:
    return _exploded(pages, F.transform(_place_structs(), lambda p, i: _unit(
        pos=i, plan_name=p["plan_name"], bedrooms=p["bedrooms"], bathrooms=p["bathrooms"], availability=F.lit("available")
    )))


def name_anchored_prices(names: Column, text: Column) -> Column:
    """Price per plan name: the first amount within 600 characters after the name, when plausible.

    When no name has one, the plausible amounts of the page are handed out in order.
    """
    amount = lambda t: X.number(X.matched(t, X.PRICE_OR_RANGE))
    ok = lambda v: v.between(500, 20_000)

    def near(name: Column, t: Column) -> Column:
        return once(F.position(name, t), lambda at: once(amount(F.substring(t, at, F.lit(600))), lambda v: F.when((at > 0) & ok(v), v)))

    def handed(t: Column) -> Column:
        harvested = F.filter(F.transform(F.regexp_extract_all(t, F.lit(X.PRICE_OR_RANGE), F.lit(1)), X.number), ok)
        return once(harvested, lambda h: F.transform(names, lambda _, i: F.get(h, i)))

    def prices(t: Column) -> Column:
        anchored = F.transform(names, lambda name: near(name, t))
        return once(anchored, lambda a: F.when(F.exists(a, lambda v: v.isNotNull()), a).otherwise(handed(t)))

    return once(text, prices)


def priced_places(html: Column) -> Column:
    """The structured places with the price that stands near their name."""

    def priced(places: Column) -> Column:
        prices = name_anchored_prices(F.transform(places, lambda p: p["plan_name"]), X.html_text(html))
        return once(prices, lambda v: F.transform(places, lambda p, i: _unit(
            pos=i, plan_name=p["plan_name"], bedrooms=p["bedrooms"], bathrooms=p["bathrooms"], price=F.get(v, i), availability=F.lit("available")
        )))

    return once(_place_structs(), lambda places: F.when(F.size(places) > 0, priced(places)))


def structured_places_priced(pages: DataFrame) -> DataFrame:
    return _exploded(pages, priced_places(F.col("html")))


def unit_tags(html: Column) -> Column:
    """Plans from unit tags with data attributes: cheapest available price, available if any is."""

    def row(tag: Column, i: Column) -> Column:
        attr = lambda n: X.matched(tag, rf"""data-spaces-{n}=["']([^"']+)["']""")
        free = F.coalesce(attr("available") == "true", F.lit(False))
        return F.struct(
            i.alias("pos"), attr("sort-plan-name").alias("plan_name"), free.alias("free"), F.when(free, attr("sort-price").try_cast("double")).alias("price"),
            attr("sort-area").try_cast("int").cast("double").alias("size_sqft"),
            F.coalesce(attr("sort-bed").try_cast("double"), F.lit(0.0)).alias("bedrooms"),
            F.coalesce(attr("sort-bath").try_cast("double"), F.lit(1.0)).alias("bathrooms"),
        )

    tags = F.regexp_extract_all(html, F.lit(r"""<article[^>]*data-spaces-obj=["']unit["'][^>]*>"""), F.lit(0))
    rows = F.filter(F.transform(tags, row), lambda r: r["plan_name"].isNotNull())
    return _by_key(rows, "plan_name", lambda r: _unit(
        **{c: _first(r, c) for c in ("pos", "plan_name", "bedrooms", "bathrooms")}, size_sqft=_first(r, "size_sqft", known=True),
        price=F.array_min(F.transform(r, lambda x: x["price"])),
        availability=F.when(F.exists(r, lambda x: x["free"]), "available").otherwise("unavailable"),
    ))


def tagged_units(pages: DataFrame) -> DataFrame:
    return _exploded(pages, unit_tags(F.col("html")))


CALL = r"setGA4Cookie\('GT',\s*'([^']+)',\s*'([^']+)',\s*'([^']+)',\s*'([^']+)',\s*'([^']+)',\s*'([^']+)'\)"


def calls(html: Column) -> Column:
    """Name, rooms, size and prices of the first analytics call per name; "0" is unknown."""

    def row(call: Column, i: Column) -> Column:
        part = lambda n: F.regexp_extract(call, CALL, n)
        known = lambda n: F.nullif(part(n), F.lit("0")).try_cast("double")
        return F.struct(
            part(1).alias("name"), part(2).try_cast("double").alias("bedrooms"), known(3).alias("size_sqft"), known(5).alias("min_price"),
            known(6).alias("max_price"), i.alias("pos"),
        )

    found = F.transform(F.regexp_extract_all(html, F.lit(CALL), F.lit(0)), row)
    return _by_key(F.filter(found, lambda r: r["bedrooms"].isNotNull()), "name", lambda r: F.get(r, F.lit(0)))


def call_arguments(pages: DataFrame) -> DataFrame:
    """(page_id, name, bedrooms, size_sqft, min_price, max_price, pos) of each page's calls."""
    rows = pages.select("page_id", calls(F.col("html")).alias("_c")).select("page_id", F.explode_outer("_c").alias("r"))
    return rows.where(F.col("r").isNotNull()).select("page_id", "r.*")


def called_units(html: Column) -> Column:
    return F.transform(calls(html), lambda c: _unit(
        pos=c["pos"], plan_name=c["name"], bedrooms=c["bedrooms"], size_sqft=c["size_sqft"], price=c["min_price"], availability=F.lit("available")
    ))


# --- single-plan pages -----------------------------------------------------------------------

def _plan(**values) -> Column:
    return F.struct(*[v.alias(n) for n, v in values.items()])


def detail_plan(html: Column, url: Column) -> Column:
    """The one plan of a page: heading, title or slug as name, first bed count, size and plausible price."""
    return once(X.html_text(html), lambda t: _plan(
        plan_name=X.detail_name(html, url), bedrooms=X.bed_count(t), size_sqft=X.number(X.matched(t, X.SQFT_DETAIL)), price=X.plausible_price(t)
    ))


def spec_line_plan(html: Column, url: Column) -> Column:
    """Variant with a "Studio | 1 Bath | 405 SF" line and a base-rent price."""
    head = F.trim(F.split_part(X.page_title(html), F.lit("|"), F.lit(1)))

    def plan(t: Column) -> Column:
        rent = X.number(F.coalesce(X.matched(t, X.BASE_RENT, 1), X.matched(t, X.BASE_RENT, 2)))
        kind = F.regexp_extract(t, X.SPEC_LINE, 1)
        return _plan(
            plan_name=F.coalesce(F.nullif(head, F.lit("")), X.slug(url)),
            bedrooms=F.coalesce(F.regexp_extract(kind, r"(\d+)", 1).try_cast("double"), F.lit(0.0)),
            size_sqft=X.number(X.matched(t, X.SPEC_LINE, 3)), price=F.when(rent.between(1_500, 20_000), rent),
        )

    return once(X.html_text(html), plan)


def nearest_bed_plan(html: Column, url: Column) -> Column:
    """Variant that takes the bed count written nearest to the size; headings equal to the slug name the plan."""
    code = X.slug(url)
    fine = F.filter(X.headings(html), lambda h: (h != "") & (F.length(h) < 80) & ~h.rlike(X.HEADING_NOISE_WIDE))
    same = lambda f, c: X.first_where(f, lambda h: F.upper(h) == F.upper(c))
    name = once(fine, lambda f: once(code, lambda c: F.coalesce(same(f, c), F.try_element_at(f, F.lit(1)), c)))
    return once(X.html_text(html), lambda t: _plan(
        plan_name=name, bedrooms=X.nearest_beds(t), size_sqft=X.number(X.matched(t, X.SQFT_PLAIN)), price=X.plausible_price(t)
    ))


def _plans(pages: DataFrame, plan: Callable[[Column, Column], Column]) -> DataFrame:
    return pages.select("page_id", plan(F.col("html"), F.col("url")).alias("_p")).select("page_id", "_p.*")


def detail_plans(pages: DataFrame) -> DataFrame:
    """(page_id, plan_name, bedrooms, size_sqft, price): one plan per page."""
    return _plans(pages, detail_plan)


def spec_line_plans(pages: DataFrame) -> DataFrame:
    return _plans(pages, spec_line_plan)


def nearest_bed_plans(pages: DataFrame) -> DataFrame:
    return _plans(pages, nearest_bed_plan)


# --- free text -------------------------------------------------------------------------------

def unit_blocks(texts: DataFrame) -> DataFrame:
    """Units from text split at HOME / APT headers."""
    blocks = texts.select("page_id", F.posexplode(F.split("text", X.UNIT_SPLIT)).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    rows = blocks.withColumn("lines", lines).withColumn("head", F.try_element_at("lines", F.lit(1))).where(F.col("head").rlike(X.UNIT_HEADER))
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    rows = rows.withColumn("body", body)
    first = lambda keep: X.first_where(F.col("body"), keep)
    name = first(lambda s: P.valid_plan_name(s) & ~s.rlike(r"(?i)\$|\d+\s*Bed|sq\.?\s*ft|waitlist") & ~F.upper(s).rlike(X.UNIT_HEADER))
    bed_line = first(lambda s: s.rlike(r"(?i)\bstudio\b|\d+\s*Bed"))
    beds = F.when(bed_line.rlike(r"(?i)\bstudio\b"), 0.0).otherwise(X.matched(bed_line, r"(?i)(\d+)\s*Bed").try_cast("double"))
    baths = X.matched(first(lambda s: s.rlike(r"(?i)\d+\s*Bath")), r"(?i)(\d+)\s*Bath").try_cast("double")
    sqft = X.number(X.matched(first(lambda s: s.rlike(r"(?i)[\d,]+\s*sq\.?\s*ft")), r"(?i)([\d,]+)\s*sq\.?\s*ft"))
    notes = F.filter("body", lambda s: s.rlike(r"(?i)available|waitlist"))

    def price(*patterns):
        line = first(lambda s: any_of([s.rlike(p) for p in patterns]))
        v = X.number(F.coalesce(*[X.matched(line, p) for p in patterns]))
        return F.when(v.between(500, 25_000), v)

    return _as_units(rows.select(
        "page_id", "pos", name.alias("plan_name"), F.regexp_replace("head", r"^(?:HOME|APT)\s+", "").alias("unit_number"),
        beds.alias("bedrooms"), baths.alias("bathrooms"), sqft.alias("size_sqft"),
        F.coalesce(price(X.RENT_BEFORE, X.RENT_AFTER), price(X.RENT_MONTH), price(X.RENT_ALONE)).alias("price"),
        F.try_element_at(notes, F.lit(-1)).alias("availability"),
    ))


SECTION_UNIT = r"(?ms)^\s*(\d{1,2}\s+\d{1,4})\s*\n\s*(.*?)\n\s*(\$\s*[\d,]+)\s*\n\s*(\d{1,2}/\d{1,2}/\d{4}|Today)\b"


def section_units(texts: DataFrame) -> DataFrame:
    """(page_id, plan, price, available, size): unit rows under "PLAN n" headers."""
    clean = F.regexp_replace("text", r"\r\n?", "\n")
    parts = texts.select("page_id", F.explode(F.split(clean, r"(?im)(?=^PLAN\s*\d+\b)")).alias("s")).where(F.col("s").rlike(r"(?i)\APLAN\s*\d+\b"))
    s = F.col("s")
    after = F.split(F.regexp_extract(s, r"(?s)\A.*?\n[ \t]*\$\s*[\d,]+[ \t]*\n(.*)\z", 1), "\n")
    sized = F.trim(X.first_where(after, lambda ln: ln.rlike(r"\d")))
    guess = F.regexp_replace(F.regexp_extract(s, r"(?m)^\s*[\d]{2,4}\s*(?:-\s*[\d]{2,4})?\s*$", 0), r"^\s+|\s+$", "")
    units = parts.select(
        "page_id", F.regexp_extract(s, r"(?i)\A(PLAN\s*\d+)\b", 1).alias("plan"),
        F.coalesce(F.nullif(sized, F.lit("")), guess).alias("size"), F.explode(F.regexp_extract_all(s, F.lit(SECTION_UNIT), F.lit(0))).alias("u"),
    )
    return units.select(
        "page_id", "plan", F.regexp_extract("u", SECTION_UNIT, 3).alias("price"), F.regexp_extract("u", SECTION_UNIT, 4).alias("available"), "size"
    )


def typed_plans(units: DataFrame) -> DataFrame:
    """Loose unit rows as plan rows: unnamed ones are "Unit", a zero price or size is unknown."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    return units.select(
        "page_id", "pos", F.coalesce(F.nullif("plan_name", F.lit("")), F.lit("Unit")).alias("name"), "unit_number", "bedrooms", "bathrooms",
        some("size_sqft").alias("size_sqft"), some("price").alias("min_price"), some("price").alias("max_price"),
        F.coalesce("availability", F.lit("Available")).alias("availability"),
    )


# --- detection and the extractor registry ----------------------------------------------------

def has_plan_links(html: Column, url: Column, min_links: int = 2) -> Column:
    """Whether a page itself names at least ``min_links`` plan pages (counted on its own row)."""
    found = F.regexp_extract_all(X.without_hidden(html), F.lit(ANCHOR), F.lit(0))
    urls = F.transform(found, lambda a: once(F.trim(F.regexp_extract(a, HREF, 1)), lambda href: U.resolve(url, href)))
    hits = F.filter(urls, _is_plan_path)
    return F.size(F.array_distinct(hits)) >= min_links


@dataclass(frozen=True)
class Extractor:
    """A page format: when it applies and its units as an array (UNITS), both of a page's own row."""

    name: str
    detect: Column
    units: Column | None = None


def _detail(plan: Callable[[Column, Column], Column]) -> Column:
    names = ("plan_name", "bedrooms", "size_sqft", "price")
    return F.transform(F.array(plan(F.col("html"), F.col("url"))), lambda p: _unit(
        pos=F.lit(0), **{c: p[c] for c in names}, availability=F.lit("available")
    ))


def default_extractors() -> list[Extractor]:
    """Formats in the order they are tried."""
    html, url = F.col("html"), F.col("url")
    has = lambda text: html.contains(text)
    return [
        Extractor("jonah_digital", has("jd-fp-floorplan-card"), _detail(nearest_bed_plan)),
        Extractor("fatwin", has("fatwin.com"), _detail(spec_line_plan)),
        Extractor("avalonbay", url.contains("avaloncommunities.com") | html.rlike(CONTENT_BLOB), content_blob(html)),
        Extractor("equity", F.lower(url).contains("equityapartments.com") & has("ea5.unitAvailability"), availability_blob(html)),
        Extractor("windsor", U.authority(url).contains("windsorcommunities.com")
                  | html.rlike(r"""(?i)https://www\.windsorcommunities\.com/properties/[^"']+/floorplans/"""), unit_tags(html)),
        Extractor("leasingstar", html.rlike(r"(?i)(?:c-leasestar-api\.realpage\.com|myleasestar\.com)")
                  & html.rlike(r"var\s+propertyId\s*=\s*'(\d+)'")),
        Extractor("sightmap", X.embed_url(html).isNotNull()),
        Extractor("greystar", url.contains("greystar.com/properties/") | F.coalesce(F.size(_place_structs()) >= 1, F.lit(False)), priced_places(html)),
        Extractor("rentcafe", html.rlike(r"(?i)(?:cdngeneralmvc|api)\.rentcafe\.com"), called_units(html)),
        Extractor("generic_detail", has_plan_links(html, url), _detail(detail_plan)),
    ]


def detect_platform(pages: DataFrame, extractors: Sequence[Extractor] | None = None, hint: str | None = "hint") -> DataFrame:
    """First format that applies, the hinted one before all others; "agent" when none does."""
    ways = default_extractors() if extractors is None else extractors
    tests = [(e.name, F.coalesce(e.detect, F.lit(False))) for e in ways]
    # A missing hint counts as another one: NULL AND d would have to evaluate d.
    branches = [F.when(F.coalesce(F.col(hint) == n, F.lit(False)) & d, n) for n, d in tests] if hint else []
    branches += [F.when(d, n) for n, d in tests]
    return pages.withColumn("platform", F.coalesce(*branches, F.lit("agent")))


def platform_coverage(pages: DataFrame, hint: str | None = "hint") -> DataFrame:
    """Pages per platform with the whole percent of all pages that have one."""
    per = detect_platform(pages, hint=hint).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    total, covered = F.sum("n"), F.coalesce(F.sum(F.when(F.col("platform") != "agent", F.col("n"))), F.lit(0))
    share = per.agg(F.floor(F.try_divide(covered * 100, total)).alias("covered_pct"))
    return per.withColumn("covered_pct", share.scalar())


def extract_all(pages: DataFrame, extractors: Sequence[Extractor] | None = None, hint: str | None = None) -> DataFrame:
    """Units of every page from the first format that applies and yields any, with its name as ``platform``.

    A page goes through its formats in order (its hinted one first).  The walk is one expression of the page's row: a fold over the formats'
    places that keeps what it has found and looks at a format only until then.  So pages are read once, whatever the number of formats,
    nothing is shuffled, and unreadable values become NULL rather than errors.
    """
    ways = [e for e in (default_extractors() if extractors is None else extractors) if e.units is not None]
    found_type = f"struct<platform:string,units:{UNITS}>"

    def tried(e: Extractor) -> Column:
        units = once(e.units.cast(UNITS), lambda u: F.when(F.size(u) > 0, F.struct(F.lit(e.name).alias("platform"), u.alias("units"))))
        return F.when(F.coalesce(e.detect, F.lit(False)), units)

    def walked(found: Column, place: Column) -> Column:
        here = F.when(place == 0, tried(ways[0]))
        for i, e in enumerate(ways[1:], 1):
            here = here.when(place == i, tried(e))
        return F.coalesce(found, here.cast(found_type))

    order = F.array(*[F.lit(i) for i in range(len(ways))])
    if hint:
        hinted = F.filter(order, lambda i: F.get(F.array(*[F.lit(e.name) for e in ways]), i) == F.col(hint))
        order = F.concat(hinted, F.array_except(order, hinted))
    found = F.aggregate(order, F.lit(None).cast(found_type), walked)
    rows = pages.select("page_id", found.alias("_f")).select("page_id", F.col("_f.platform").alias("platform"), F.explode_outer("_f.units").alias("u"))
    return rows.where(F.col("u").isNotNull()).select("page_id", "u.*", "platform")
