"""Expressions over raw page text: cleaning, signals, numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.functions import urls as U
from rentscope.operators.scale import once

# --- fixed patterns and word lists -------------------------------------------------------------
HIDDEN_TAGS = ("script", "style", "noscript")
TOKEN = r'(?i)(value|content|data-token|nonce)\s*=\s*"[A-Za-z0-9+/=_\-]{16,}"'
SESSION = r"(?i)(PHPSESSID|jsessionid|sid|_csrf|__RequestVerificationToken)[=\/][A-Za-z0-9%_\-]{8,}"
ISO_TIME = r"(?i)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
EPOCH_MS = r"\b1[0-9]{12}\b"
HOTEL_DOMAINS = (
    "hyatt.com", "marriott.com", "hilton.com", "ihg.com", "wyndham.com", "bestwestern.com", "choicehotels.com",
    "radissonhotels.com", "accor.com", "starwoodhotels.com",
)
BAD_HEADER_WORDS = (
    "hotel", "motel", " inn ", "resort", "hostel", "assisted living", "memory care", "skilled nursing", "senior living",
    "retirement community", "independent living", "short-term rental", "extended stay america", "housing authority",
    "community development corporation", "affordable housing",
)
BAD_BODY_WORDS = (
    "per night", "check-in date", "checkout date", "nightly rate", "book a room", "room reservations", "nights stayed",
    "income restricted", "income qualified", "% ami", "area median income", "section 8 voucher", "hud-funded",
    "low-income housing tax credit", "lihtc",
)
SIGNAL_TOKENS = (
    "sightmap.com", "fatwin.com", "jd-fp-floorplan-card", "cdngeneralmvc.rentcafe.com", "api.rentcafe.com",
    "fusion.globalcontent", "bozzuto.com", "entrata", "realpage",
)
PLAN_LINK_HTML = r'(?i)<a[^>]+href="[^"]*(?:floor-?plans?|residences?|/plan-)[^"]*/[a-zA-Z0-9\-]+/?"'
PRICE_NEAR_BEDS = r"(?i)\$\d[\d,]*(?:\s*[/-]\s*\$?\d[\d,]*)?\s*(?:/\s*mo)?[\s\S]{0,200}?\d+\s*bed"
EMBED = r"(?i)https://sightmap\.com/embed/([a-z0-9]{6,})"
EMBED_ATTR = r"""(?i)engrain[_-]?id=["']([a-z0-9]{6,})["']"""
PRICING_WORDS = (
    "$", "bed", "bath", "sqft", "sq ft", "sq. ft", "sq.ft", "plan", "studio", "available", "price", "rent", "floor",
    "unit", "home",
)
PRICE_OR_RANGE = r"\$([\d,]+)(?:\s*[-–]\s*\$([\d,]+))?"
BEDS = r"(?i)(\d+)\s*(?:bed(?:room)?s?)"
SQFT_DETAIL = r"(?i)([\d,]+)\s*(?:sq\.?\s*(?:ft\.?|feet)|SF)\b"
SQFT_PLAIN = r"(?i)([\d,]+)\s*(?:sq\.?\s*ft|square\s*feet)"
SPEC_LINE = r"(?is)(Studio|\d+\s*Bedroom)\s*\|\s*(\d+(?:\.\d+)?)\s*Bath.*?([\d,]+)(?:\s*-\s*([\d,]+))?\s*SF"
BASE_RENT = r"(?i)\$\s*([\d,]+)\s*\n?\s*Base\s+Rent|Base\s+Rent\s*\n?\s*\$\s*([\d,]+)"
CARD_BEDS = r"(?i)\b(\d+)\s*(?:bed(?:room)?s?|br)\b|\bstudio\b"
CARD_BATHS = r"(?i)\b(\d+(?:\.\d)?)\s*(?:bath(?:room)?s?|ba)\b"
CARD_SQFT = r"(?i)([\d,]+)\s*(?:sq\.?\s*ft\.?|sqft|square\s*feet)"
CARD_PRICE_SIGNAL = r"(?i)\$\s*([\d,]{3,6})(?:\s*[/\-]\s*\$?\s*([\d,]{3,6}))?"
CARD_RENT = r"(?i)\$\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/|\s+per\s+)\s*(?:mo|month)\b"
CARD_AMOUNT = r"\$\s*([\d,]+(?:\.\d{1,2})?)"
DEPOSIT = r"(?i)deposit(?:\s+starting\s+at)?[\s:]*\$\s*[\d,]+(?:\.\d{1,2})?"
FEE = r"(?i)(?:admin|application|app|move-?in|amenity|parking|pet|holding)\s+fee[\s:]*\$\s*[\d,]+(?:\.\d{1,2})?"
HEADING_NOISE = r"(?i)floor\s*plan|available|contact|schedule|tour|apply"
HEADING_ACTIONS = (
    r"(?i)^(favorite|tour now|view detail[s]?|schedule(?: a)? tour|contact us?|apply(?: now)?|get directions?|learn more|"
    r"see all|show more|back to)$"
)
HEADING_NOISE_WIDE = (
    r"(?i)floor\s*plans?|available|contact|schedule|pet\s*policy|book\s*a\s*tour|leasing|spaces\s*created|now\s*leasing|"
    r"our\s*amenities"
)
UNIT_HEADER = r"^(?:HOME|APT)\s+\w+"
UNIT_SPLIT = r"\n(?=(?:HOME|APT)\s+\w+)"
RENT_BEFORE = r"(?i)\$\s*([\d,]+(?:\.\d{1,2})?)\s+Base\s+Rent"
RENT_AFTER = r"(?i)Base\s+Rent\s+\$?\s*([\d,]+(?:\.\d{1,2})?)"
RENT_MONTH = r"(?i)\$\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/|\s+per\s+)\s*mo"
RENT_ALONE = r"^\$\s*([\d,]+(?:\.\d{1,2})?)\s*$"
# Link scores: in each group the first pattern that matches counts.
TEXT_GOOD = (
    (r"\bfloor\s*plans?\b", 100), (r"\bplans?\s*&?\s*pricing\b", 95), (r"\bavailability\b", 90), (r"\bresidences?\b", 80),
    (r"\blive\s+here\b", 40), (r"\bapartments?\b", 50), (r"\brentals?\b", 50), (r"\bhomes?\b", 30),
)
HREF_GOOD = (
    (r"/floor-?plans?/?$", 80), (r"/availability/?$", 70), (r"/plans?/?$", 60), (r"/apartments?/?$", 40),
    (r"/residences?/?$", 40), (r"/rentals?/?$", 40),
)
TEXT_BAD = (
    (r"\binstagram\b|\bfacebook\b|\btwitter\b|\blinkedin\b|\btiktok\b", -80),
    (r"\bprivacy\b|\bterms\b|\baccessibility\b|\bfair\s+housing\b", -60), (r"\bsitemap\b|\bcookie", -50),
    (r"\bcontact\s+us\b", -40), (r"\bschedule\s+tour\b", -30), (r"\bapply\s+now\b", -30),
    (r"\blogin\b|\bsign\s*in\b|\bresident\s+portal\b", -30),
)
HREF_BAD = (
    (r"instagram\.com|facebook\.com|twitter\.com|linkedin\.com|tiktok\.com", -90), (r"^(?:mailto|tel):", -90),
    (r"/(?:privacy|terms|accessibility|sitemap|cookies?)\b", -60), (r"/(?:login|signin|portal|resident)\b", -30),
)
WIDGET_HOSTS = ("sightmap", "rentcafe", "entrata", "yardi")
# ------------------------------------------------------------------------------------------------


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column) -> Column:
    """"1,050.5" as a double; NULL when it is not a number."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def first_where(values: Column, keep) -> Column:
    return F.try_element_at(F.filter(values, keep), F.lit(1))


def without_hidden(html: Column, tags=HIDDEN_TAGS) -> Column:
    out = html
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


def content_hash(html: Column) -> Column:
    """sha256 of the page without scripts, comments, tokens, session ids and timestamps."""
    out = without_hidden(html)
    for pattern in (TOKEN, SESSION, ISO_TIME, EPOCH_MS):
        out = F.regexp_replace(out, pattern, "")
    return F.sha2(F.trim(F.regexp_replace(out, r"\s+", " ")), 256)


def unescaped(text: Column) -> Column:
    out = text
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_text(html: Column, separator: str = "\n") -> Column:
    """Visible text, one piece per line (or joined by ``separator``)."""
    bare = F.regexp_replace(without_hidden(html, ("script", "style")), r"<[^>]*>", "\n")
    lines = F.regexp_replace(F.regexp_replace(unescaped(bare), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
    return lines if separator == "\n" else F.replace(lines, F.lit("\n"), F.lit(separator))


def inner_text(fragment: Column) -> Column:
    """Text of a small piece of HTML."""
    return F.regexp_replace(unescaped(F.regexp_replace(fragment, r"<[^>]*>", "")), r"^\s+|\s+$", "")


def page_title(html: Column) -> Column:
    return inner_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1))


def meta_description(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bname\s*=\s*["']description["'][^>]*>""", 0)
    return unescaped(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))


def first_word_in(text: Column, words) -> Column:
    """First listed word the text contains, NULL when none.  The text is computed once per row."""
    return once(text, lambda t: F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in words]))


def rejection(html: Column, url: Column) -> Column:
    """Why a page is not a listing site, NULL when it may be: host, header words, then body words."""
    host = first_word_in(U.authority(url), HOTEL_DOMAINS)
    header = first_word_in(F.lower(F.concat(page_title(html), F.lit(" "), meta_description(html))), BAD_HEADER_WORDS)
    body = first_word_in(F.lower(html_text(html, " ")), BAD_BODY_WORDS)
    return F.coalesce(
        F.concat(F.lit("domain is a hotel chain ("), host, F.lit(")")),
        F.concat(F.lit("title/meta contains '"), header, F.lit("'")),
        F.concat(F.lit("page body contains '"), body, F.lit("'")),
    )


def is_challenge(html: Column) -> Column:
    """Small bot-check page instead of content."""
    low = F.lower(html)
    marks = (low.contains("just a moment") & low.contains("cloudflare")) | low.contains("cf-chl-") | low.contains("__cf_bm")
    return F.coalesce((html != "") & (F.length(html) <= 20_000) & marks, F.lit(False))


def has_plan_signals(html: Column, min_length: int = 5_000) -> Column:
    found = P.mentions_any(html, SIGNAL_TOKENS) | html.rlike(PLAN_LINK_HTML) | html.rlike(PRICE_NEAR_BEDS)
    return F.coalesce((F.length(html) >= min_length) & found, F.lit(False))


def embed_url(html: Column) -> Column:
    return F.coalesce(matched(html, EMBED, 0), F.concat(F.lit("https://sightmap.com/embed/"), matched(html, EMBED_ATTR)))


def page_name(html: Column, url: Column) -> Column:
    title = F.trim(F.split_part(F.split_part(page_title(html), F.lit("|"), F.lit(1)), F.lit("-"), F.lit(1)))
    h1 = inner_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1", 1))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")), url)


def prioritised(text: Column, max_chars: int) -> Column:
    """Lines with a pricing word first, the others after, cut to ``max_chars``."""
    lines = F.split(text, "\n")
    wanted = lambda ln: P.mentions_any(ln, PRICING_WORDS)
    both = F.concat(F.filter(lines, wanted), F.filter(lines, lambda ln: ~wanted(ln)))
    return F.substring(F.array_join(both, "\n"), 1, max_chars)


def ladder(text: Column, rules) -> Column:
    """Weight of the first rule that matches, else 0."""
    out = F.lit(0)
    for pattern, weight in reversed(rules):
        out = F.when(text.rlike(pattern), weight).otherwise(out)
    return out


def link_score(text: Column, href: Column, page_host: Column) -> Column:
    host = U.authority(href)
    foreign = href.startswith("http") & (host != "") & (host != page_host) & ~P.mentions_any(host, WIDGET_HOSTS)
    return (
        ladder(F.lower(text), TEXT_GOOD) + ladder(F.lower(href), HREF_GOOD) + ladder(F.lower(text), TEXT_BAD)
        + ladder(F.lower(href), HREF_BAD) + F.when(foreign, -20).otherwise(0)
    )


def headings(html: Column) -> Column:
    found = F.regexp_extract_all(without_hidden(html), F.lit(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]>"), F.lit(1))
    return F.transform(found, inner_text)


def slug(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(U.path_of(url), "/+$", ""), r"([^/]*)$", 1)


def plausible_price(text: Column, low: float = 500, high: float = 20_000) -> Column:
    """First amount (the lower end of a range) inside the bounds."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(PRICE_OR_RANGE), F.lit(1)), number)
    return first_where(amounts, lambda v: v.between(low, high))


def detail_name(html: Column, url: Column) -> Column:
    good = first_where(
        headings(html),
        lambda h: (F.length(h) > 1) & (F.length(h) < 80) & ~h.rlike(HEADING_NOISE) & ~h.rlike(HEADING_ACTIONS),
    )
    head = F.trim(F.split_part(page_title(html), F.lit("|"), F.lit(1)))
    title = F.when((head != "") & (F.length(head) < 80) & ~head.rlike(HEADING_ACTIONS), head)
    return F.coalesce(good, title, slug(url))


def bed_count(text: Column, pattern: str = BEDS + r"\b") -> Column:
    return F.coalesce(matched(text, pattern).try_cast("double"), F.lit(0.0))


def match_start(text: Column, pattern: str) -> Column:
    """0-based start of the first match; the text's length when there is none."""
    return F.length(F.get(F.split(text, pattern, 2), F.lit(0)))


def nearest_beds(text: Column) -> Column:
    """Bed count whose mention ends closest to where the size begins; a studio within 60 characters wins."""
    mentions = F.regexp_extract_all(text, F.lit(BEDS), F.lit(0))
    pieces = F.arrays_zip(F.split(text, BEDS).alias("gap"), mentions.alias("hit"))
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(2_147_483_647).alias("dist"), F.lit(None).cast("string").alias("best")
    )

    def anchored(at: Column) -> Column:
        def step(acc, x):
            def next_state(end):
                dist = F.abs(at - end)
                closer = x["hit"].isNotNull() & (dist < acc["dist"])
                return F.struct(
                    end.alias("pos"), F.when(closer, dist).otherwise(acc["dist"]).alias("dist"),
                    F.when(closer, x["hit"]).otherwise(acc["best"]).alias("best"),
                )

            return once(acc["pos"] + F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit(""))), next_state)

        near = F.substring(text, F.greatest(at - 59, F.lit(1)), F.least(at, F.lit(60)) + 20)
        best = F.aggregate(pieces, start, step)["best"]
        return F.when(near.rlike(r"(?i)\bstudio\b"), 0.0).otherwise(
            F.coalesce(F.regexp_extract(best, r"(\d+)", 1).try_cast("double"), F.lit(0.0))
        )

    return F.when(text.rlike(SQFT_PLAIN), once(match_start(text, SQFT_PLAIN), anchored)).otherwise(bed_count(text, BEDS))


def card_rent(text: Column) -> Column:
    """A monthly price wins; else the first amount of at least 1000 outside deposits and fees."""
    monthly = number(matched(text, CARD_RENT))
    bare = F.regexp_replace(F.regexp_replace(text, DEPOSIT, ""), FEE, "")
    amounts = F.transform(F.regexp_extract_all(bare, F.lit(CARD_AMOUNT), F.lit(1)), number)
    return F.coalesce(F.when(monthly.between(500, 25_000), monthly), first_where(amounts, lambda v: v.between(1_000, 25_000)))


def signal_count(text: Column) -> Column:
    return sum(
        (text.rlike(p).cast("int") for p in (CARD_BATHS, CARD_SQFT, CARD_PRICE_SIGNAL)), text.rlike(CARD_BEDS).cast("int")
    )


def card_beds(text: Column) -> Column:
    hit = F.regexp_extract(text, CARD_BEDS, 0)
    return F.when(F.lower(hit).contains("studio"), 0.0).otherwise(matched(text, CARD_BEDS).try_cast("double"))
