"""Alert texts as columns.  The wording is fixed; the product name is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and lines used in the texts.
BELL, CLIPBOARD, CHART = "\U0001f514", "\U0001f4cb", "\U0001f4c9"
RULE = "─" * 54


def one_decimal(c: Column) -> Column:
    """A double with one decimal, rounded by its exact binary value, ties to even."""
    tenths = F.floor(c * 10)
    high = c.cast("float").cast("double")  # 24 bits: both products below are exact
    beyond = (high * 20 - (tenths * 2 + 1)) + (c - high) * 20
    up = (beyond > 0) | ((beyond == 0) & (tenths % 2 != 0))
    return F.format_string("%.1f", (tenths + up.cast("int")) / 10)


def _usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(c, 0), 0))


def _pct(c: Column) -> Column:
    return one_decimal(c)


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _cases(drop: Column, target: Column, other: Column) -> Column:
    """Three headlines: a drop from the baseline, a crossed target, anything else."""
    fell = (F.col("drop_pct") > 0) & (F.col("baseline_price") != 0)
    return F.when(fell, drop).when(F.col("target_price").isNotNull(), target).otherwise(other)


def _columns():
    c = F.col
    return c("apartment_title"), c("latest_price"), c("baseline_price"), c("target_price"), c("drop_pct")


def alert_subject() -> Column:
    title, now, was, target, drop = _columns()
    return _cases(
        _join(BELL + " ", title, " dropped to ", _usd(now), "/mo (−", _pct(drop), "% from ", _usd(was), ")"),
        _join(BELL + " ", title, " now below your ", _usd(target), " target (", _usd(now), "/mo)"),
        _join(BELL + " Price drop alert: ", title, " (", _usd(now), "/mo)"),
    )


def _dated(prefix: str, suffix: str = ")") -> Column:
    return F.coalesce(_join(prefix, F.col("was_date"), suffix), F.lit(""))


def alert_body(
    product: str, region: str, base_url: str, unsubscribe: Column | None = None, unsubscribe_all: Column | None = None
) -> Column:
    title, now, was, target, drop = _columns()
    opening = _cases(
        _join(F.coalesce(F.nullif("plan_name", F.lit("")), title), " dropped from ", _usd(was), " to ", _usd(now), "/mo (−", _pct(drop), "%)."),
        _join(title, " is now ", _usd(now), "/mo — below your ", _usd(target), " target."),
        _join(title, " has a new price: ", _usd(now), "/mo."),
    )
    details = F.concat_ws(
        "\n",
        _join("  Property  : ", title, F.coalesce(_join(" · ", F.col("city_state")), F.lit(""))),
        F.when(F.col("plan_name") != "", _join("  Plan      : ", F.col("plan_name"), F.coalesce(_join(" · ", F.col("plan_spec")), F.lit("")))),
        F.when(was != 0, _join("  Was       : ", _usd(was), "/mo", _dated(" (your baseline, "))),
        _join("  Now       : ", _usd(now), "/mo"),
        _join("  30-day low: ", _usd(F.col("thirty_day_low")), "/mo"),
    )
    links = F.concat_ws(
        "\n", _join(f"  View in {product}  → ", F.col("url_internal")), _join("  Official listing  → ", F.col("url_external"))
    )
    why = _cases(
        _join("Why you got this: price dropped ", _pct(drop), "% from your ", _usd(was), " baseline", _dated(" (set "), "."),
        _join("Why you got this: price crossed below your ", _usd(target), " target."),
        F.lit("Why you got this: a price drop matched your alert settings."),
    )
    heading = _join("Price drop alert — ", title)
    pause = (
        "We've paused this alert so you won't get duplicate notifications.\n"
        f"To re-arm it, visit {product} Alerts: {base_url}/alerts"
    )
    leave = [
        _join(text, link) for text, link in (
            ("Unsubscribe from this alert:\n  → ", unsubscribe),
            (f"Unsubscribe from all {product} alerts:\n  → ", unsubscribe_all),
        ) if link is not None
    ]
    leaving = F.concat_ws("\n", *leave) if leave else F.lit("")
    return F.concat_ws(
        "\n", heading, F.repeat(F.lit("="), F.length(heading)), F.lit(""), opening, F.lit(""), details,
        F.when(links != "", _join("\n", links)), F.lit(""), F.lit(RULE), why, F.lit(""), F.lit(pause),
        F.when(leaving != "", _join("\n", leaving)), F.lit(RULE), F.lit(f"{product} · {region}"),
    )


def alert_short(product: str) -> Column:
    title, now, was, target, drop = _columns()
    headline = _cases(
        _join(BELL + " *", title, "* dropped to ", _usd(now), "/mo (−", _pct(drop), "%)"),
        _join(BELL + " *", title, "* now below ", _usd(target), " target (", _usd(now), "/mo)"),
        _join(BELL + " *", title, "* new price: ", _usd(now), "/mo"),
    )
    detail = F.concat_ws(" · ", "plan_spec", "city_state")
    had = F.coalesce(was != 0, F.lit(False))
    low = F.col("thirty_day_low")
    low_text = _join("30d low ", _usd(low))
    first = F.when(had, _join("Was ", _usd(was), _dated(" ("), " → now ", _usd(now))).when(
        low.isNotNull(), _join("now ", _usd(now), " → ", low_text)
    ).otherwise(_join("now ", _usd(now)))
    prices = _join(CHART + " ", first, F.coalesce(_join(" · ", low_text), F.lit("")))
    links = F.concat_ws(
        " · ", _join(f"[{product}](", F.col("url_internal"), ")"), _join("[Official listing](", F.col("url_external"), ")")
    )
    return F.concat_ws(
        "\n", headline, F.when(detail != "", _join(CLIPBOARD + " ", detail)), prices, F.when(links != "", _join("\n", links)),
        F.lit(""), F.lit(f"_Alert paused. Re-arm at {product} Alerts._"),
    )
