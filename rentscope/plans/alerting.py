"""Alert evaluation."""

from pyspark.sql import functions as F

from rentscope.operators import alerts as A
from rentscope.plans.filters import AS_OF
from rentscope.plans.registry import query

_LAST = """lt AS (SELECT r.plan_id, max(CASE WHEN r.rn = 1 THEN r.price END) AS p1, max(CASE WHEN r.rn = 2 THEN r.price END) AS p2
  FROM (SELECT h.plan_id, h.price, row_number() OVER (PARTITION BY h.plan_id ORDER BY h.recorded_at DESC, h.seq DESC, h.line DESC) AS rn
  FROM price_history h) r WHERE r.rn <= 2 GROUP BY r.plan_id)"""
_AREA = """ar AS (SELECT s.id, @avg(p.price) AS price, count(p.id) AS plans FROM subscriptions s LEFT JOIN (plans p JOIN apartments a ON a.id = p.apartment_id)
  ON p.is_available {extra} AND (s.city IS NULL OR lower(a.city) = lower(s.city)) AND (s.zipcode IS NULL OR a.zipcode = s.zipcode)
  AND (s.min_bedrooms IS NULL OR p.bedrooms >= s.min_bedrooms) AND (s.max_bedrooms IS NULL OR p.bedrooms <= s.max_bedrooms)
  WHERE s.unit_id IS NULL AND s.plan_id IS NULL AND s.apartment_id IS NULL GROUP BY s.id)"""
_PRICED = _LAST + ", " + _AREA.format(extra="") + """,
mp AS (SELECT p.apartment_id, min(p.current_price) AS price FROM plans p WHERE p.is_available AND p.current_price IS NOT NULL GROUP BY 1),
pr AS (SELECT s.*, CASE WHEN s.unit_id IS NOT NULL THEN u.price WHEN s.plan_id IS NOT NULL THEN lt.p1
    WHEN s.apartment_id IS NOT NULL THEN mp.price ELSE ar.price END AS latest_price,
  CASE WHEN s.unit_id IS NULL AND s.plan_id IS NOT NULL THEN lt.p2 ELSE s.baseline_price END AS previous_price
  FROM subscriptions s LEFT JOIN units u ON u.id = s.unit_id AND u.is_available LEFT JOIN lt ON lt.plan_id = s.plan_id
  LEFT JOIN mp ON mp.apartment_id = s.apartment_id LEFT JOIN ar ON ar.id = s.id)"""
_TRIG = _PRICED + """,
tr AS (SELECT pr.*, coalesce(pr.latest_price < pr.target_price AND (pr.previous_price IS NULL OR pr.previous_price >= pr.target_price), false) AS crossed,
  coalesce((pr.baseline_price - pr.latest_price) / pr.baseline_price * 100 >= pr.price_drop_pct, false) AS fell,
  coalesce(pr.last_notified_at > @ts'2001-11-04 00:00:00', false) AS debounced FROM pr),
fi AS (SELECT tr.*, (tr.crossed OR tr.fell) AND tr.latest_price IS NOT NULL AND NOT tr.debounced AND tr.is_active AS fired,
  CASE WHEN tr.latest_price IS NULL THEN NULL WHEN tr.crossed THEN 'target_price' WHEN tr.fell THEN 'price_drop_pct' END AS trigger_type FROM tr)"""


def _priced(t):
    return A.rule_prices(t.subscriptions, t.units, t.plans, t.apartments, t.price_history)


def _evaluated(t):
    return A.evaluate(t.subscriptions, t.units, t.plans, t.apartments, t.price_history, AS_OF)


@query("j09_null_means_any", f"WITH {_AREA.format(extra='AND p.price IS NOT NULL')} SELECT ar.id, ar.price, ar.plans FROM ar")
def j09(t):
    rules = t.subscriptions.where(A.level() == "area")
    return A.area_prices(rules, t.plans, t.apartments, True).select("id", "price", F.coalesce("plans", F.lit(0)).alias("plans"))


@query("j18_target_chain", """
SELECT s.id, u.unit_number, p.name AS plan_name, a.id AS apartment_id, a.title FROM subscriptions s
LEFT JOIN units u ON u.id = s.unit_id
LEFT JOIN plans p ON p.id = CASE WHEN s.unit_id IS NOT NULL THEN u.plan_id ELSE s.plan_id END
LEFT JOIN apartments a ON a.id = CASE WHEN s.unit_id IS NOT NULL THEN p.apartment_id ELSE coalesce(s.apartment_id, p.apartment_id) END
""")
def j18(t):
    return A.targets(t.subscriptions, t.units, t.plans, t.apartments).select(
        "id", "unit_number", "plan_name", F.col("eff_apartment_id").alias("apartment_id"), "title"
    )


@query("j23_rule_enrichment", f"""
WITH {_LAST}, mp AS (SELECT p.apartment_id, min(p.price) AS price FROM plans p WHERE p.is_available AND p.price IS NOT NULL GROUP BY 1)
SELECT s.id, a.title AS apartment_title, a.city AS apartment_city, p.name AS plan_name,
  CASE WHEN s.plan_id IS NOT NULL THEN lt.p1 WHEN s.apartment_id IS NOT NULL THEN mp.price END AS latest_price
FROM subscriptions s LEFT JOIN plans p ON p.id = s.plan_id LEFT JOIN apartments a ON a.id = coalesce(s.apartment_id, p.apartment_id)
LEFT JOIN lt ON lt.plan_id = s.plan_id LEFT JOIN mp ON mp.apartment_id = s.apartment_id
""")
def j23(t):
    return A.enriched_rules(t.subscriptions, t.plans, t.apartments, t.price_history).select(
        "id", "apartment_title", "apartment_city", "plan_name", "latest_price"
    )


@query("l01_latest_price", f"WITH {_PRICED} SELECT pr.id, pr.latest_price FROM pr")
def l01(t):
    return _priced(t).select("id", "latest_price")


@query("l02_previous_price", f"WITH {_PRICED} SELECT pr.id, pr.previous_price FROM pr")
def l02(t):
    return _priced(t).select("id", "previous_price")


@query("l03_target_crossing", f"WITH {_TRIG} SELECT tr.id, tr.crossed FROM tr")
def l03(t):
    return _priced(t).select("id", A.crossed_target().alias("crossed"))


@query("l04_cumulative_drop", f"WITH {_TRIG} SELECT tr.id, tr.fell FROM tr")
def l04(t):
    return _priced(t).select("id", A.dropped_enough().alias("fell"))


@query("l05_trigger_reason", f"""
WITH {_TRIG} SELECT fi.id, fi.trigger_type, CASE WHEN fi.latest_price IS NULL THEN ''
  WHEN fi.crossed THEN 'price $' || format('{{:,.0f}}', fi.latest_price) || ' dropped below target $' || format('{{:,.0f}}', fi.target_price)
  WHEN fi.fell THEN 'price dropped ' || format('{{:.1f}}', (fi.baseline_price - fi.latest_price) / fi.baseline_price * 100) || '% — was $'
    || format('{{:,.0f}}', fi.baseline_price) || ' when you subscribed'
    || coalesce(' (' || strftime(fi.baseline_recorded_at, '%b %-d') || ')', '') || ', now $' || format('{{:,.0f}}', fi.latest_price)
  ELSE '' END AS reason FROM fi
""")
def l05(t):
    return A.trigger(_priced(t)).select("id", "trigger_type", "reason")


@query("l06_debounce", f"WITH {_TRIG} SELECT tr.id, tr.debounced FROM tr")
def l06(t):
    return t.subscriptions.select("id", A.debounced(AS_OF).alias("debounced"))


@query("l07_state_advance", f"""
WITH {_TRIG} SELECT fi.id, fi.is_active AND NOT fi.fired AS is_active,
  CASE WHEN fi.fired THEN @ts'2001-11-05 00:00:00' ELSE fi.last_notified_at END AS last_notified_at,
  CASE WHEN fi.fired THEN coalesce(fi.trigger_count, 0) + 1 ELSE fi.trigger_count END AS trigger_count FROM fi
""")
def l07(t):
    return A.advance(t.subscriptions, _evaluated(t), AS_OF).select("id", "is_active", "last_notified_at", "trigger_count")


@query("l08_fan_out", f"""
WITH {_TRIG} SELECT fi.id AS subscription_id, fi.user_id, 'email' AS channel, fi.trigger_type, fi.latest_price AS trigger_price,
  fi.baseline_price FROM fi WHERE fi.fired AND fi.notify_email
UNION ALL SELECT fi.id, fi.user_id, 'telegram', fi.trigger_type, fi.latest_price, fi.baseline_price FROM fi
WHERE fi.fired AND fi.notify_telegram AND coalesce(fi.telegram_chat_id, '') <> ''
""")
def l08(t):
    return A.fan_out(_evaluated(t)).drop("reason")


@query("l09_context", f"""
WITH {_TRIG}, lp AS (SELECT h.plan_id, min(h.price) AS low FROM price_history h WHERE h.recorded_at >= @ts'2001-10-06 00:00:00' GROUP BY 1),
la AS (SELECT p.apartment_id, min(lp.low) AS low FROM lp JOIN plans p ON p.id = lp.plan_id GROUP BY 1)
SELECT fi.id, coalesce(a.title, 'your tracked property') AS apartment_title,
  round((fi.baseline_price - fi.latest_price) / nullif(fi.baseline_price, 0) * 100, 6) AS drop_pct, p.name AS plan_name,
  a.city || ', ' || a.state AS city_state, 'https://app.example.com/apartments/' || cast(a.id AS string) AS url_internal, a.source_url AS url_external,
  CASE WHEN fi.unit_id IS NOT NULL THEN NULL WHEN fi.plan_id IS NOT NULL THEN lp.low ELSE la.low END AS thirty_day_low
FROM fi LEFT JOIN units u ON u.id = fi.unit_id LEFT JOIN plans p ON p.id = CASE WHEN fi.unit_id IS NOT NULL THEN u.plan_id ELSE fi.plan_id END
LEFT JOIN apartments a ON a.id = CASE WHEN fi.unit_id IS NOT NULL THEN p.apartment_id ELSE coalesce(fi.apartment_id, p.apartment_id) END
LEFT JOIN lp ON lp.plan_id = fi.plan_id LEFT JOIN la ON la.apartment_id = fi.apartment_id WHERE fi.fired
""")
def l09(t):
    fired = _evaluated(t).where("fired")
    return A.context(fired, t.units, t.plans, t.apartments, t.price_history, AS_OF).select(
        "id", "apartment_title", F.round("drop_pct", 6).alias("drop_pct"), "plan_name", "city_state", "url_internal", "url_external",
        "thirty_day_low",
    )


@query("l10_evaluate_alerts", f"""
WITH {_TRIG} SELECT fi.id, fi.latest_price, fi.previous_price, fi.trigger_type, fi.debounced, fi.fired FROM fi WHERE fi.is_active
""")
def l10(t):
    return _evaluated(t).select("id", "latest_price", "previous_price", "trigger_type", "debounced", "fired")


@query("l11_disable_blocked_channel", """
SELECT s.id, s.notify_telegram AND NOT EXISTS (SELECT 1 FROM notifications n WHERE n.subscription_id = s.id AND n.channel = 'telegram'
  AND n.status = 'failed' AND n.id % 2 = 0) AS notify_telegram FROM subscriptions s
""")
def l11(t):
    events = t.notifications.withColumn("blocked", (F.col("status") == "failed") & (F.col("id") % 2 == 0))
    return A.disable_blocked(t.subscriptions, events).select("id", "notify_telegram")


@query("m24_infer_baseline", f"""
WITH {_LAST}, {_AREA.format(extra='AND p.price IS NOT NULL')},
mp AS (SELECT p.apartment_id, min(p.price) AS price FROM plans p WHERE p.is_available AND p.price IS NOT NULL GROUP BY 1)
SELECT s.id, CASE WHEN s.unit_id IS NOT NULL THEN u.price WHEN s.plan_id IS NOT NULL THEN coalesce(lt.p1, p.price)
  WHEN s.apartment_id IS NOT NULL THEN mp.price ELSE ar.price END AS baseline
FROM subscriptions s LEFT JOIN units u ON u.id = s.unit_id AND u.is_available LEFT JOIN lt ON lt.plan_id = s.plan_id
LEFT JOIN plans p ON p.id = s.plan_id LEFT JOIN mp ON mp.apartment_id = s.apartment_id LEFT JOIN ar ON ar.id = s.id
""")
def m24(t):
    return A.infer_baseline(t.subscriptions, t.units, t.plans, t.apartments, t.price_history).select("id", "baseline")


@query("m24_refresh_rearmed", f"""
WITH {_PRICED} SELECT pr.id, CASE WHEN pr.is_active AND pr.id % 3 = 0 AND pr.latest_price IS NOT NULL THEN pr.latest_price
    ELSE pr.baseline_price END AS baseline_price,
  CASE WHEN pr.is_active AND pr.id % 3 = 0 AND pr.latest_price IS NOT NULL THEN @ts'2001-11-05 00:00:00' ELSE pr.baseline_recorded_at END
    AS baseline_recorded_at, CASE WHEN pr.is_active AND pr.id % 3 = 0 THEN NULL ELSE pr.last_notified_at END AS last_notified_at FROM pr
""")
def m24_rearm(t):
    before = t.subscriptions.select("id", (F.col("id") % 3 != 0).alias("is_active"))
    return A.refresh_rearmed(
        t.subscriptions, before, t.units, t.plans, t.apartments, t.price_history, AS_OF
    ).select("id", "baseline_price", "baseline_recorded_at", "last_notified_at")
