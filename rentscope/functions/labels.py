"""Display text and small conversions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.operators.scale import instant, once

# Dollars per million tokens read and written, per search and per detail call.
INPUT_TOKEN_PRICE, OUTPUT_TOKEN_PRICE = Decimal("0.30"), Decimal("1.10")
SEARCH_PRICE, DETAILS_PRICE = Decimal("0.003"), Decimal("0.007")


def location_label(address: Column, city: Column, state: Column) -> Column:
    """An empty address counts as missing."""
    return F.concat_ws(", ", F.when(address != "", address), city, state)


def plain_number(x: Column) -> Column:
    """2.0 as "2", 2.5 as "2.5"."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def whole(x: Column) -> Column:
    """Rounded to whole units with thousands separators."""
    return F.format_number(x, 0)


def truncated(x: Column) -> Column:
    return F.format_number(x.cast("bigint"), 0)


def plan_spec(beds: Column, baths: Column, sqft: Column) -> Column:
    """"Studio / 1 bath / 520 sqft"; NULL when nothing is known."""
    text = F.concat_ws(
        " / ",
        F.when(beds == 0, "Studio").otherwise(F.concat(plain_number(beds), F.lit(" bed"))),
        F.concat(plain_number(baths), F.lit(" bath")),
        F.when(sqft != 0, F.concat(truncated(sqft), F.lit(" sqft"))),
    )
    return F.nullif(text, F.lit(""))


def plan_spec_short(beds: Column, baths: Column, sqft: Column) -> Column:
    """"1BR · 1BA · 520 sqft", fractions cut off."""
    text = F.concat_ws(
        " · ",
        F.when(beds == 0, "Studio").otherwise(F.concat(beds.cast("bigint").cast("string"), F.lit("BR"))),
        F.concat(baths.cast("bigint").cast("string"), F.lit("BA")),
        F.when(sqft != 0, F.concat(truncated(sqft), F.lit(" sqft"))),
    )
    return F.nullif(text, F.lit(""))


def drop_pct(previous: Column, current: Column) -> Column:
    return F.round(F.try_divide((previous - current) * 100, previous), 1)


def name_slug(title: Column) -> Column:
    spaced = F.regexp_replace(F.lower(title), r"[ \-]", "_")
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", "")


def split_address(address: Column) -> dict[str, Column]:
    """City, state and zip from the last parts of a comma-separated address; empty when absent."""
    parts = F.split(address, ",")
    state_zip = F.filter(F.split(F.trim(F.try_element_at(parts, F.lit(-2))), r"\s+"), lambda w: w != "")
    both = (F.size(parts) >= 2) & (F.size(state_zip) >= 2)
    empty = F.lit("")
    return {
        "city": F.when(F.size(parts) > 2, F.trim(F.try_element_at(parts, F.lit(-3)))).otherwise(empty),
        "state": F.when(both, F.try_element_at(state_zip, F.lit(1))).otherwise(empty),
        "zipcode": F.when(both, F.try_element_at(state_zip, F.lit(2))).otherwise(empty),
    }


def _as_int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


NUMERIC_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})|(\d{4})-(\d{2})-(\d{2})"
MONTH_DATE = (
    r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:\s+(\d{4}))?"
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the parts are missing or do not make one."""
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string"))
    return F.try_to_date(text, "yyyy-M-d")


def parse_availability(text: Column, today) -> tuple[Column, Column]:
    """(is_available, available_from) of a free-text availability note.

    Numeric dates are tried first, then month names; a month name without year that lies in the past
    means next year.  Impossible dates fall through; a date not after ``today`` means now.
    """
    day0 = instant(today).cast("date")
    parts = F.struct(
        *[_as_int(F.regexp_extract(text, NUMERIC_DATE, i)).alias(f"n{i}") for i in range(1, 7)],
        F.lower(F.regexp_extract(text, MONTH_DATE, 1)).alias("name"),
        *[_as_int(F.regexp_extract(text, MONTH_DATE, i)).alias(f"m{i}") for i in (2, 3)],
    )

    def date_of(p):
        short = p["n3"]
        slashed = _date(F.when(short < 100, short + 2000).otherwise(short), p["n1"], p["n2"])
        numeric = F.when(p["n1"].isNotNull(), slashed).otherwise(_date(p["n4"], p["n5"], p["n6"]))
        month = F.when(p["name"] != "", ((F.position(p["name"], F.lit(MONTHS)) - 1) / 4 + 1).cast("int"))
        this_year = F.year(day0)
        first = _date(F.coalesce(p["m3"], this_year), month, p["m2"])
        later = F.when((first < day0) & p["m3"].isNull(), _date(this_year + 1, month, p["m2"])).otherwise(first)
        return F.coalesce(numeric, later)

    def verdict(d):
        waitlist = F.lower(text).contains("waitlist")
        empty = text.isNull() | (text == "")
        ahead = d > day0
        return F.struct(
            F.when(empty, True).when(waitlist, False).when(d.isNotNull(), ~ahead).otherwise(True).alias("now"),
            F.when(~empty & ~waitlist & ahead, d.cast("timestamp_ntz")).alias("start"),
        )

    both = once(once(parts, date_of), verdict)
    return both["now"], both["start"]


def _two_digits(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def mdy_to_iso(text: Column) -> Column:
    """M/D/YYYY as ISO text; anything without exactly three parts is NULL."""
    parts = F.split(text, "/")
    pad = lambda i: _two_digits(F.get(parts, F.lit(i)))
    return F.when(F.size(parts) == 3, F.concat_ws("-", F.get(parts, F.lit(2)), pad(0), pad(1)))


def beds_from_plan_code(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^A\d"), 1).when(name.rlike(r"^B\d"), 2).when(name.rlike(r"^C\d"), 3).when(name.rlike(r"^S\d"), 0)
    )


def plan_display_name(name: Column, beds: Column, baths: Column, sqft: Column) -> Column:
    spec = F.concat_ws(
        " / ",
        F.when(beds == 0, "Studio").when(beds.isNotNull(), F.concat(plain_number(beds), F.lit(" Bed"))).otherwise("?"),
        F.concat(plain_number(baths), F.lit(" Bath")),
        F.concat(F.call_function("format_number", sqft, F.lit("#,##0.###")), F.lit(" sqft")),
    )
    named = (name != "") & ~name.rlike(P.GENERIC_NAME_CLIENT)
    return F.when(named, name).otherwise(spec)


def availability_label(is_available: Column, starts: Column, as_of) -> Column:
    """Unavailable / Now / M/D."""
    return (
        F.when(~F.coalesce(is_available, F.lit(False)), "Unavailable")
        .when(starts.isNull() | (starts <= instant(as_of)), "Now")
        .otherwise(F.date_format(starts, "M/d"))
    )


def hours_since(ts: Column, as_of) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(instant(as_of)) - micros(ts)) / 3_600_000_000


def freshness_label(ts: Column, as_of) -> Column:
    h = hours_since(ts, as_of)
    return (
        F.when(ts.isNull(), F.lit(None).cast("string"))
        .when(h < 1, "Updated just now")
        .when(h < 24, F.concat(F.lit("Updated "), F.floor(h + 0.5), F.lit("h ago")))
        .when(h < 48, "Updated yesterday")
        .otherwise(F.concat(F.lit("Updated "), F.floor(h / 24 + 0.5), F.lit("d ago")))
    )


def market_label(price: Column, median: Column, city: Column, beds: Column) -> tuple[Column, Column]:
    """(label, tone): within $50 of the median, below or above it; tone turns at 10 % above."""
    diff = price - median
    apart = F.floor(F.abs(F.floor(diff + 0.5)))
    kind = F.when(beds == 0, "studio").otherwise(F.concat(plain_number(beds), F.lit("BR")))
    tail = F.concat(city, F.lit(" median ($"), F.format_number(F.floor(median + 0.5), 0), F.lit(") for "), kind)
    money = F.concat(F.lit("$"), F.format_number(apart, 0))
    label = (
        F.when(apart < 50, F.concat(F.lit("At "), tail))
        .when(diff < 0, F.concat(money, F.lit(" below "), tail))
        .otherwise(F.concat(money, F.lit(" above "), tail))
    )
    tone = F.when(diff <= 0, "good").when(F.try_divide(diff, median) > 0.10, "high").otherwise("neutral")
    return label, tone


def beds_label(low: Column, high: Column) -> Column:
    bd = lambda x: F.concat(plain_number(x), F.lit(" bd"))
    first = F.when(low == 0, "Studio").otherwise(bd(low))
    return F.when(low == high, first).otherwise(F.concat(first, F.lit("–"), bd(high)))


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Exact decimal arithmetic, rounded once to six places."""
    per_million = tokens_in * F.lit(INPUT_TOKEN_PRICE) + tokens_out * F.lit(OUTPUT_TOKEN_PRICE)
    return (per_million.cast("decimal(20,2)") * F.lit(Decimal("0.000001"))).cast("decimal(10,6)")


def place_cost(searches: Column, details: Column) -> Column:
    return (searches * F.lit(SEARCH_PRICE) + details * F.lit(DETAILS_PRICE)).cast("decimal(10,6)")


def with_note(text: Column, note: str) -> Column:
    """Note appended after a blank line; a missing text counts as empty."""
    return F.concat(F.coalesce(F.concat(text, F.lit("\n\n")), F.lit("")), F.lit(note))


def with_prefix(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)
