"""Boundary values of filters, alerts, cleaning, matching and suppression on tiny tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentscope.functions import labels as T
from rentscope.functions import pagetext as X
from rentscope.functions import predicates as P
from rentscope.operators import alerts as A
from rentscope.operators import backoff as B
from rentscope.operators import listings as L
from rentscope.operators import matching as M
from rentscope.operators import merge as G
from rentscope.operators import quality as Q
from rentscope.operators import stats as S

NOW = dt.datetime(2026, 5, 1, 12)
SNAP = ("apartment_id long, pos int, name string, unit_number string, bedrooms double, bathrooms double, size_sqft double, min_price double, "
        "max_price double, availability string, external_url string, floor_level int, facing string, adapter_name string")
PLAN = ("id long, apartment_id long, name string, bedrooms double, bathrooms double, area_sqft double, price double, current_price double, "
        "max_price double, is_available boolean, external_url string, floor_level int, facing string")


def snap(spark, *rows):
    """(name, price[, beds, sqft, unit, adapter]) rows of apartment 1."""
    full = []
    for i, r in enumerate(rows):
        name, price, beds, sqft, unit, adapter = (*r, *(None,) * (6 - len(r)))
        full.append((1, i, name, unit, beds, 1.0, sqft, price, price, None, None, None, None, adapter))
    return spark.createDataFrame(full, SNAP)


def plans(spark, *rows):
    """(id, name, beds, sqft[, available])"""
    return spark.createDataFrame(
        [(r[0], 1, r[1], r[2], 1.0, r[3], 2000.0, 2000.0, None, r[4] if len(r) > 4 else True, None, None, None) for r in rows], PLAN
    )


def test_three_valued_filter(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, p boolean")
    pick = lambda v: [r["id"] for r in df.where(P.is_bool(F.col("p"), v)).collect()]
    assert pick(True) == [1] and pick(False) == [2]


def test_available_before(spark):
    df = spark.createDataFrame([(1, NOW + dt.timedelta(10)), (2, NOW + dt.timedelta(60)), (3, None)], "id long, available_from timestamp_ntz")
    bound = str(NOW + dt.timedelta(30))
    assert [r["id"] for r in df.where(L.available_by(F.col("available_from"), bound)).collect()] == [1]


@pytest.mark.parametrize("ranges,want", [
    ([(2000, 4000), (1000, 1000), (5000, 5000)], 3000), ([(2000, 2000), (3000, 3000)], 2500), ([(500, 500), (1000, 1000), (9000, 9000)], 1000),
    ([(None, 2000), (1000, 1000)], 1000), ([], 0),
])
def test_median_of_midpoints(spark, ranges, want):
    rows = [(a and float(a), b and float(b)) for a, b in ranges]
    df = spark.createDataFrame(rows, "min_price double, max_price double")
    assert S.median_of_midpoints(df).collect()[0]["median"] == want


def rules(spark, **values):
    base = {"id": 1, "user_id": 1, "unit_id": None, "plan_id": 7, "apartment_id": None, "city": None, "zipcode": None, "min_bedrooms": None,
            "max_bedrooms": None, "target_price": None, "price_drop_pct": None, "baseline_price": None, "baseline_recorded_at": None,
            "notify_email": True, "notify_telegram": False, "telegram_chat_id": None, "is_active": True, "last_notified_at": None,
            "trigger_count": 0} | values
    schema = ("id long, user_id long, unit_id long, plan_id long, apartment_id long, city string, zipcode string, min_bedrooms double, "
              "max_bedrooms double, target_price double, price_drop_pct double, baseline_price double, baseline_recorded_at timestamp_ntz, "
              "notify_email boolean, notify_telegram boolean, telegram_chat_id string, is_active boolean, last_notified_at timestamp_ntz, "
              "trigger_count int")
    return spark.createDataFrame([tuple(base.values())], schema)


def evaluate(spark, prices, **values):
    history = spark.createDataFrame(
        [(7, p, NOW - dt.timedelta(days=len(prices) - i), i, 0) for i, p in enumerate(prices)],
        "plan_id long, price double, recorded_at timestamp_ntz, seq long, line int",
    )
    units = spark.createDataFrame([], "id long, price double, is_available boolean, plan_id long, unit_number string")
    apts = spark.createDataFrame([(1, "Elm", "Oslo", "NO", "1", "https://x.example.com")], "id long, title string, city string, state string, zipcode string, source_url string")
    stored = plans(spark, (7, "A1", 1.0, 600.0))
    rule = rules(spark, **values)
    out = A.evaluate(rule, units, stored, apts, history, str(NOW))
    return out.collect()[0], A.advance(rule, out, str(NOW)).collect()[0]


@pytest.mark.parametrize("prices,values,fires", [
    ([3200.0, 2800.0], {"target_price": 3000.0}, True), ([2900.0, 2800.0], {"target_price": 3000.0}, False),
    ([2800.0], {"target_price": 3000.0}, True), ([3200.0, 3000.0], {"target_price": 3000.0}, False),
    ([3000.0, 2700.0], {"price_drop_pct": 10.0, "baseline_price": 3000.0}, True),
    ([3000.0, 2701.0], {"price_drop_pct": 10.0, "baseline_price": 3000.0}, False),
    ([3000.0], {"price_drop_pct": 0.0, "baseline_price": 3000.0}, True), ([100.0], {"price_drop_pct": 0.0}, False),
    ([], {"target_price": 3000.0}, False),
])
def test_triggers(spark, prices, values, fires):
    row, state = evaluate(spark, prices, **values)
    assert bool(row["fired"]) is fires
    assert state["is_active"] is not fires and state["trigger_count"] == int(fires)


@pytest.mark.parametrize("hours,fires", [(1, False), (23, False), (25, True)])
def test_debounce(spark, hours, fires):
    row, _ = evaluate(spark, [3200.0, 2800.0], target_price=3000.0, last_notified_at=NOW - dt.timedelta(hours=hours))
    assert bool(row["fired"]) is fires


def prices_after(spark, *rows):
    return {r["name"]: r["min_price"] for r in Q.sanitise(snap(spark, *rows)).collect()}


def test_rent_floor_and_ceiling(spark):
    assert prices_after(spark, ("A1", 1500.0), ("A2", 1499.0), ("A3", 25000.0), ("A4", 25001.0)) == {
        "A1": 1500.0, "A2": None, "A3": 25000.0, "A4": None}


def test_dominant_price(spark):
    four = [(f"A{i}", 2000.0) for i in range(4)]
    assert set(prices_after(spark, *four, ("B1", 2500.0)).values()) == {None}
    two = prices_after(spark, ("A1", 2000.0), ("A2", 2000.0), ("A3", 2100.0), ("A4", 2200.0), ("A5", 2300.0))
    assert None not in two.values()
    assert None not in prices_after(spark, ("A1", 2000.0), ("A2", 2000.0), ("A3", 2000.0)).values()


def test_sibling_names(spark):
    assert set(prices_after(spark, ("Marina Playa", 2000.0), ("A1", 2100.0), ("Studio A Loft", 2200.0))) == {"A1", "Studio A Loft"}
    assert set(prices_after(spark, ("Dry Creek", 2000.0, None, None, None, "jonah_digital"))) == {"Dry Creek"}


def test_rules_compose(spark):
    assert prices_after(spark, ("Marina Playa", 2000.0), ("Studio A", 900.0), ("A1", 3500.0)) == {"Studio A": None, "A1": 3500.0}


@pytest.mark.parametrize("stored,row,tier,plan_id", [
    ([(1, "A1", 1.0, 600.0)], ("A1", 2000.0, 1.0, 600.0), 1, 1), ([(1, "A1", 1.0, 600.0, False)], ("A1", 2000.0, 1.0, 600.0), 2, 1),
    ([(1, "A1", 1.0, 600.0)], ("A9", 2000.0, 1.0, 605.0), 3, 1), ([(1, "A1", 1.0, 600.0)], ("A9", 2000.0, 1.0, 606.0), 4, None),
    ([(1, "A1", 1.0, 600.0), (2, "A2", 1.0, 602.0)], ("A9", 2000.0, 1.0, 601.0), 4, None), ([(1, "A1", 1.0, 600.0)], ("A9", 2000.0), None, None),
])
def test_match_tiers(spark, stored, row, tier, plan_id):
    got = G.match_plans(snap(spark, row), plans(spark, *stored)).collect()[0]
    assert (got["tier"], got["plan_id"]) == (tier, plan_id)


def test_apply_snapshot(spark):
    stored = plans(spark, (1, "A1", 1.0, 600.0), (2, "B2", 2.0, 900.0), (3, "C3", 3.0, 1200.0, False))
    units = spark.createDataFrame(
        [(10, 1, "101", 2000.0, 600.0, None, None, None, True), (11, 1, "102", 2000.0, 600.0, None, None, None, True)],
        "id long, plan_id long, unit_number string, price double, area_sqft double, floor_level int, facing string, available_from timestamp_ntz, is_available boolean",
    )
    apts = spark.createDataFrame([(1, "https://x.example.com")], "id long, source_url string")
    watch = rules(spark, unit_id=11, plan_id=None)
    out = G.apply_snapshot(apts, stored, units, watch, snap(
        spark, ("A1", 2100.0, 1.0, 609.0, "101"), ("A1", 2300.0, 1.0, 640.0, "103"), ("C3", 3300.0, 3.0, 1300.0), ("New", 2500.0, 2.0, 800.0),
    ), str(NOW))
    got = {r["name"]: r for r in out["plans"].collect()}
    assert (got["A1"]["price"], got["A1"]["max_price"], got["A1"]["area_sqft"]) == (2100.0, 2300.0, 600.0)
    assert (got["B2"]["is_available"], got["C3"]["is_available"], got["C3"]["area_sqft"]) == (False, True, 1300.0)
    assert got["New"]["id"] == 4 and got["New"]["max_price"] is None
    assert {(r["plan_id"], r["price"]) for r in out["history"].collect()} == {(1, 2100.0), (3, 3300.0), (4, 2500.0)}
    let = {(r["plan_id"], r["unit_number"]): r["is_available"] for r in out["units"].collect()}
    assert let == {(1, "101"): True, (1, "102"): False, (1, "103"): True, (3, None): True, (4, None): True}
    assert out["rules"].collect()[0]["is_active"] is False


def test_empty_snapshot_changes_nothing(spark):
    stored = plans(spark, (1, "A1", 1.0, 600.0))
    assert G.mark_stale_plans(stored, snap(spark, ("x", 1.0)).limit(0)).collect()[0]["is_available"] is True


def test_backoff_days(spark):
    schema = "id long, url string, run_at timestamp_ntz, outcome string"
    log = [(i, "u", NOW + dt.timedelta(days=i), "hard_fail") for i in range(4)]
    for n, days in ((1, 7), (2, 14), (3, 30), (4, 30)):
        row = B.replay(spark.createDataFrame(log[:n], schema)).collect()[0]
        assert row["retry_after"] - row["last_failed_at"] == dt.timedelta(days=days)
    cleared = [*log, (4, "u", NOW + dt.timedelta(days=5), "success"), (5, "u", NOW + dt.timedelta(days=6), "validated_fail")]
    assert B.replay(spark.createDataFrame(cleared, schema)).collect()[0]["attempt_count"] == 1
    assert B.replay(spark.createDataFrame([(0, "u", NOW, "platform_direct_static")], schema)).count() == 0


def test_content_hash_ignores_noise(spark):
    page = '<html><body><!-- a --><input value="AbCdEfGhIjKlMnOp1234"><script>x=1</script><p>A1 ${p} {a}</p></body></html>'
    one = page.replace("{p}", "2000").replace("{a}", "2026-04-16T10:32:00Z")
    noisy = one.replace("<!-- a -->", "<!-- b -->").replace("AbCdEf", "ZZZZZZ").replace("x=1", "x=2").replace("10:32", "11:00").replace("<p>", "  <p>".strip())
    other = page.replace("{p}", "2100").replace("{a}", "2026-04-16T10:32:00Z")
    rows = spark.createDataFrame([(one,), (noisy,), (other,), ("",)], "h string").select(X.content_hash(F.col("h")).alias("d")).collect()
    assert rows[0]["d"] == rows[1]["d"] != rows[2]["d"] and len(rows[3]["d"]) == 64


@pytest.mark.parametrize("text,available,start", [
    (None, True, None), ("", True, None), ("Available Now", True, None), ("Waitlist", False, None), ("Available Jun 4th", False, (2026, 6, 4)),
    ("Available 06/04/2026", False, (2026, 6, 4)), ("6-4-26", False, (2026, 6, 4)), ("Apr 2", False, (2027, 4, 2)), ("Apr 2 2026", True, None),
    ("2026-05-01", True, None), ("13/45/2026", True, None), ("13/45/2026 or Jun 9", False, (2026, 6, 9)),
])
def test_parse_availability(spark, text, available, start):
    flag, begins = T.parse_availability(F.col("t"), str(NOW))
    row = spark.createDataFrame([(text,)], "t string").select(flag.alias("a"), begins.alias("s")).collect()[0]
    assert row["a"] is available and row["s"] == (dt.datetime(*start) if start else None)


def test_card_rent(spark):
    cards = {"Deposit $500 from $2,450": 2450.0, "$1,899.50 /mo": 1899.5, "Deposit starting at $1,500": None, "$99 /mo special, $1,800": 1800.0, "$800": None}
    rows = spark.createDataFrame([(k,) for k in cards], "t string").select("t", X.card_rent(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == cards


def test_rows_without_a_name_are_found_by_size(spark):
    stored = plans(spark, (1, "A1", 1.0, 600.0), (2, None, 2.0, 900.0))
    rows = snap(spark, (None, 2500.0, 1.0, 700.0), ("", 2600.0, 3.0, 1200.0), (None, 2400.0, 2.0, 900.0), ("", 2600.0, 3.0, 1200.0), (None, 1.0), ("Unit", 2.0, 1.0, 70.0))
    matched = {r["pos"]: (r["tier"], r["plan_id"], r["made_by"]) for r in G.match_plans(rows, stored).collect()}
    assert matched == {0: (1, 2, None), 1: (4, None, 1), 2: (1, 2, None), 3: (3, None, 1), 4: (1, 2, None), 5: (1, None, 1)}
    fresh = snap(spark, (None, 2500.0, 1.0, 700.0), ("", 2600.0, 3.0, 1200.0))
    none = stored.limit(0)
    made = G.new_plans(fresh, G.match_plans(fresh, none), none).collect()
    assert sorted((r["name"], r["bedrooms"]) for r in made) == [("Unit", 1.0), ("Unit", 3.0)]
    units = spark.createDataFrame([], "id long, plan_id long, unit_number string, price double, area_sqft double, floor_level int, facing string, "
                                  "available_from timestamp_ntz, is_available boolean")
    places = spark.createDataFrame([(1, "https://x.example.com")], "id long, source_url string")
    rules = spark.createDataFrame([], "id long, user_id long, unit_id long, is_active boolean")
    out = G.apply_snapshot(places, none, units, rules, fresh, NOW)
    assert out["units"].count() == 2 and out["history"].count() == 2


def test_only_rules_of_scraped_listings_are_paused(spark):
    stored = spark.createDataFrame([(10, 1), (20, 2)], "id long, apartment_id long")
    units = spark.createDataFrame([(100, 10, False), (101, 10, True), (200, 20, False)], "id long, plan_id long, is_available boolean")
    rules = spark.createDataFrame([(1, 5, 100, True), (2, 5, 101, True), (3, 5, 200, True), (4, 5, None, True), (5, 5, 100, False)],
                                  "id long, user_id long, unit_id long, is_active boolean")
    scraped = spark.createDataFrame([(1,), (1,)], "apartment_id long")
    paused = G.pause_let_units(rules, units, stored, scraped)
    assert {r["id"]: r["is_active"] for r in paused.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}
    assert [(r["subscription_id"], r["unit_id"]) for r in G.unavailable_notices(rules, paused, NOW).collect()] == [(1, 100)]


def test_listings_without_url_know_no_url(spark):
    stored = spark.createDataFrame([("e1", None), ("e2", "https://a.example.com/")], "external_id string, source_url string")
    new = spark.createDataFrame([(1, "e1", None), (2, "n2", None), (3, "n3", "https://a.example.com"), (4, None, "")], "seq long, external_id string, source_url string")
    assert sorted(r["seq"] for r in M.not_known(new, stored).collect()) == [2, 4]


def test_rows_of_like_size_make_one_plan(spark):
    rows = snap(spark, ("N1", 2000.0, 1.0, 1000.0), ("N2", 2100.0, 1.0, 1003.0), ("N3", 2200.0, 1.0, 1006.0), ("N3", 2300.0, 1.0, 400.0), ("N2", 2400.0))
    none = plans(spark, (1, "x", 1.0, 1.0)).limit(0)
    matched = {r["pos"]: (r["tier"], r["made_by"]) for r in G.match_plans(rows, none).collect()}
    assert matched == {0: (4, 0), 1: (3, 0), 2: (4, 2), 3: (1, 2), 4: (None, None)}
    made = G.new_plans(rows, G.match_plans(rows, none), none).collect()
    assert sorted((r["name"], r["area_sqft"]) for r in made) == [("N1", 1000.0), ("N3", 1006.0)]


def test_woken_plans_are_candidates(spark):
    stored = plans(spark, (1, "Old", 1.0, 600.0, False), (2, "New", 1.0, 603.0))
    rows = snap(spark, ("X", 1.0, 1.0, 601.0), ("Old", 1.0, 9.0, 1.0), ("Y", 1.0, 1.0, 601.0), ("Old", 1.0))
    matched = {r["pos"]: (r["tier"], r["plan_id"], r["made_by"]) for r in G.match_plans(rows, stored).collect()}
    assert matched == {0: (3, 2, None), 1: (2, 1, None), 2: (4, None, 2), 3: (1, 1, None)}
