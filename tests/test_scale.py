"""The skew-safe building blocks against plain Python, with one key holding a third of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rentscope.operators import alerts as A
from rentscope.operators import matching as M
from rentscope.operators import merge as G
from rentscope.operators import pages as E
from rentscope.operators import scale as S


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = 1 if i % 3 == 0 else rng.randrange(2, 40)
        day, price = rng.randrange(20), rng.choice([None, 10.5, 20.0, 20.0, 31.25, rng.random() * 900])
        rows.append((key, day, i, price))
    return rows, spark.createDataFrame(rows, "key long, day int, seq long, price double")


def test_lag_by_segment(points):
    rows, df = points
    out = S.lag_by_segment(df, "key", F.col("day"), ["day", "seq"], "price").collect()
    got = {r["seq"]: (r["previous"], r["has_previous"]) for r in out}
    last = {}
    for key, _day, seq, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        assert got[seq] == (last.get(key), key in last)
        last[key] = price


def test_order_statistics_and_quantile(points):
    rows, df = points
    out = {r["key"]: r for r in S.order_statistics(df, ["key"], "price", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2)}).collect()}
    med = {r["key"]: r["m"] for r in S.exact_quantile(df, ["key"], "price", 0.5, "m").collect()}
    groups = {}
    for key, _, _, price in rows:
        if price is not None:
            groups.setdefault(key, []).append(price)
    assert set(out) == set(groups)
    for key, values in groups.items():
        values.sort()
        n = len(values)
        assert (out[key]["n"], out[key]["low"], out[key]["mid"]) == (n, values[0], values[n // 2])
        pos = (n - 1) * 0.5
        lo, hi = values[math.floor(pos)], values[math.ceil(pos)]
        assert med[key] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))


def test_order_statistics_negative_and_null_keys(spark):
    df = spark.createDataFrame([(None, -5.0), (None, 3.0), (None, -70.0), ("a", 0.0)], "k string, v double")
    out = {r["k"]: r["m"] for r in S.order_statistics(df, ["k"], "v", {"m": F.floor(F.col("n") / 2)}).collect()}
    assert out == {None: -5.0, "a": 0.0}


def test_running_number_and_hash_number(points):
    rows, df = points
    got = {r["seq"]: r["no"] for r in S.running_number(df, F.floor(F.col("seq") / 64), ["seq"], "no").collect()}
    assert got == {seq: seq + 1 for _, _, seq, _ in rows}
    numbers = [r["no"] for r in S.number_by_hash(df.select("seq"), ["seq"], "no").collect()]
    assert sorted(numbers) == list(range(1, len(rows) + 1))


def test_contains_join_matches_all_pairs(spark):
    rng = random.Random(3)
    hosts = ["a.com", "www.a.com", "xa.com", "b.co", "b.com", "long-name-of-a-site.org", "site.org", "m.b.com", ".com"]
    urls = [f"https://{rng.choice(['', 'www.', 'm.', 'x'])}{rng.choice(hosts)}/p/{i}?r={rng.choice(hosts)}" for i in range(80)] + ["no dots", ""]
    left = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, u string")
    right = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = sorted((r["id"], r["host"]) for r in M.contains_join(left, "u", right, "host").collect())
    assert got == sorted((i, h) for i, u in enumerate(urls) for h in hosts if h in u)


def test_rename_generic_is_first_fit(spark):
    rng = random.Random(11)
    plans = [(i, rng.randrange(3), "1 Bed / 1 Bath" if i % 4 else f"A{i}", float(rng.choice([1, 2])), float(rng.randrange(400, 900)), i % 7 != 0)
             for i in range(120)]
    snap = [(rng.randrange(3), i, f"B{i}" if i % 3 else "Studio / 1 bath", float(rng.choice([1, 2])), float(rng.randrange(400, 900)))
            for i in range(90)]
    got = M.rename_generic(
        spark.createDataFrame(snap, "apartment_id long, pos int, name string, bedrooms double, size_sqft double"),
        spark.createDataFrame(plans, "id long, apartment_id long, name string, bedrooms double, area_sqft double, is_available boolean"),
        spark.createDataFrame([(a, "https://site.example.com") for a in range(3)], "id long, source_url string"), hosts=("example",),
    ).collect()
    want = {}
    for apt in range(3):
        free = [p for p in plans if p[1] == apt and p[5] and "/" in p[2]]
        for _, _, name, beds, size in sorted((s for s in snap if s[0] == apt), key=lambda s: s[1]):
            if "/" in name:
                continue
            hit = next((p for p in free if p[3] == beds and abs(p[4] - size) / p[4] <= 0.05), None)
            if hit:
                free.remove(hit)
                want[hit[0]] = name
    assert {r["plan_id"]: r["new_name"] for r in got} == want and len(want) > 20


def test_area_prices_matches_all_pairs(spark):
    rng = random.Random(2)
    apts = [(i, rng.choice(["Oslo", "Bergen"]), rng.choice(["1", "2", "3"])) for i in range(20)]
    plans = [(rng.randrange(20), float(rng.choice([0, 1, 2, 2.5])), rng.choice([None, 100.0, 250.5, 300.0]), rng.random() > 0.2) for _ in range(200)]
    rules = [(i, rng.choice([None, "oslo", "", "Nowhere"]), rng.choice([None, "2"]), rng.choice([None, 1.0]), rng.choice([None, 2.0]))
             for i in range(40)]
    got = {r["id"]: (r["price"], r["plans"]) for r in A.area_prices(
        spark.createDataFrame(rules, "id long, city string, zipcode string, min_bedrooms double, max_bedrooms double"),
        spark.createDataFrame(plans, "apartment_id long, bedrooms double, price double, is_available boolean"),
        spark.createDataFrame(apts, "id long, city string, zipcode string"),
    ).collect()}
    place = {a[0]: a for a in apts}
    for i, city, zipcode, lo, hi in rules:
        hit = [p for p in plans if p[3] and (not city or place[p[0]][1].lower() == city.lower()) and (not zipcode or place[p[0]][2] == zipcode)
               and (lo is None or p[1] >= lo) and (hi is None or p[1] <= hi)]
        priced = [p[2] for p in hit if p[2] is not None]
        price, count = got[i]
        assert (count or 0) == len(hit)
        assert price == (pytest.approx(sum(priced) / len(priced)) if priced else None)


def sequential_match(rows, stored):
    """Rows one after the other: {(listing, pos): (tier, plan id, pos of the row that made the plan)}."""
    out = {}
    for apt in {r[0] for r in rows}:
        live = [{"id": p[0], "by": None, "name": p[2], "beds": p[3], "size": p[4], "on": p[5]} for p in sorted(stored) if p[1] == apt]
        for _, pos, name, beds, size in sorted((r for r in rows if r[0] == apt), key=lambda r: r[1]):
            same = [p for p in live if p["name"] == name and (p["by"] is None or name)]
            hit, tier = next((p for p in same if p["on"]), None), 1
            if hit is None:
                hit, tier = next(iter(same), None), 2
            if hit is None and beds is not None and size is not None:
                near = [p for p in live if p["on"] and p["beds"] == beds and p["size"] is not None and abs(p["size"] - size) <= 5]
                hit, tier = near[0] if len(near) == 1 else None, 3
            if hit is None and beds is not None:
                hit, tier = {"id": None, "by": pos, "name": name or "Unit", "beds": beds, "size": size or 0.0, "on": True}, 4
                live.append(hit)
            if hit is not None:
                hit["on"] = True
            out[apt, pos] = (tier, hit["id"], hit["by"]) if hit else (None, None, None)
    return out


def test_match_plans_is_sequential(spark):
    rng = random.Random(23)
    for seed in range(3):
        names = ["Unit", "", None, *(f"P{i}" for i in range(25))]
        stored = [(i, rng.randrange(4), rng.choice(names), rng.choice([None, 0.0, 1.0]), rng.choice([None, 0.0, float(rng.randrange(400, 520))]), rng.random() < 0.6)
                  for i in range(40)]
        rows = [(rng.randrange(4), i, rng.choice(names), rng.choice([None, 0.0, 1.0, 1.0]), rng.choice([None, 3.0, *(float(rng.randrange(400, 520)) for _ in range(4))]))
                for i in range(260)]
        got = G.match_plans(
            spark.createDataFrame(rows, "apartment_id long, pos int, name string, bedrooms double, size_sqft double").repartition(5),
            spark.createDataFrame(stored, "id long, apartment_id long, name string, bedrooms double, area_sqft double, is_available boolean"),
        ).collect()
        want = sequential_match(rows, stored)
        assert {(r["apartment_id"], r["pos"]): (r["tier"], r["plan_id"], r["made_by"]) for r in got} == want
        assert len({t for t, _, _ in want.values()}) == 5 and any(t == 3 and by is not None for t, _, by in want.values())


def test_extractors_read_pages_once(spark, tmp_path):
    """All formats and hints are tried on one scan, and none is tried after the first that yields."""
    html = "<a class='jd-fp-floorplan-card' href='/floorplans/a1/'>A1</a> fatwin.com <h2>A1</h2> Studio 1 Bed 500 sq ft $1,500"
    rows = [(1, "https://x.example.com/floorplans/a1", html, None), (2, "https://x.example.com/floorplans/a1", html, "fatwin"), (3, "u", "nothing", "fatwin"), (4, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, hint string").write.parquet(str(tmp_path / "p"))
    out = E.extract_all(spark.read.parquet(str(tmp_path / "p")), hint="hint")
    assert sorted((r["page_id"], r["platform"]) for r in out.collect()) == [(1, "jonah_digital"), (2, "fatwin")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    boom = E.Extractor("boom", F.lit(True), F.raise_error(F.lit("tried")).cast(E.UNITS))
    first = E.Extractor("first", F.lit(True), F.array(E._unit(pos=F.lit(0), plan_name=F.lit("A"))))
    assert [r["platform"] for r in E.extract_all(spark.range(1).select(F.col("id").alias("page_id")), [first, boom]).collect()] == ["first"]


def test_close_values_are_narrowed(spark):
    """Distinct values within one bucket: parts are narrowed until few are left, and no task orders them all."""
    rng = random.Random(9)
    rows = [(k, 5000 + rng.random() / 10) for k in (None, "a") for _ in range(3000)] + [("a", 5000.05)] * 900 + [("b", -1.5), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    ranks = {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1}
    got = {r["k"]: (r["n"], r["low"], r["mid"], r["high"]) for r in S.order_statistics(df, ["k"], "v", ranks, leaf=8).collect()}
    for k in (None, "a", "b", "c"):
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (len(v), v[0], v[len(v) // 2], v[-1])
    whole = sorted(x for _, x in rows if x is not None)
    assert S.order_statistics(df, [], "v", ranks, leaf=8).collect()[0]["mid"] == whole[len(whole) // 2]


def test_running_numbers_in_levels(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100_003).alias("seq")).repartition(6)
    levels = [F.floor(F.col("seq") / n) for n in (20_000, 500, 40)]
    got = {r["seq"]: r["no"] for r in S.running_number(df, levels, ["seq"], "no").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(i * 7919 % 100_003 for i in range(5000)))}
