"""Readers, sinks and streams over small files."""

import json

from pyspark.sql import functions as F

from rentscope.operators import merge as G
from rentscope.operators import refresh as E
from rentscope.sources import readers as R
from rentscope.sources import writers as W
from rentscope.streaming.alerting import alert_batch, current_rules, prepare_alert_state, start_alert_stream
from rentscope.streaming.status import batches_written, current_status, levels, read_updates, start_status_stream, status_batch
from rentscope.views import Tables

SF_DIR = "/root/testdata/sf0.001"


def test_json_readers(spark, tmp_path):
    (tmp_path / "places.json").write_text(json.dumps({"p1": {"title": "Elm", "source_url": "https://e.example.com"}, "p2": {"title": "No url"}}))
    assert [r["place_id"] for r in R.read_place_map(spark, str(tmp_path / "places.json")).collect()] == ["p1"]
    (tmp_path / "seeds.json").write_text(json.dumps([{"name": "Elm Court", "url": "u", "city": "c", "state": "s", "zip": "1"}, {"name": "Oak"}], indent=1))
    assert R.read_seed_list(spark, str(tmp_path / "seeds.json"), "elm").count() == 1
    (tmp_path / "found.json").write_text(json.dumps({"total": 2, "city_counts": {"Oslo": 2}, "apartments": [{"title": "a"}, {"title": "b"}]}))
    assert R.read_discovery(spark, str(tmp_path / "found.json")).count() == 2


def test_step_cache_and_pages(spark, tmp_path):
    (tmp_path / "steps").mkdir()
    for name, when in (("new", "2026-04-20T00:00:00+00:00"), ("old", "2026-01-01T00:00:00+00:00"), ("none", None)):
        entry = {"url": name, "steps": [{"action": "click", "args": {"text": "Floor plans"}}], "success_count": 1}
        (tmp_path / "steps" / f"{name}.json").write_text(json.dumps(entry | ({"last_success": when} if when else {})))
    got = R.read_step_cache(spark, str(tmp_path / "steps"), "2026-05-01 00:00:00").collect()
    assert [r["url"] for r in got] == ["new"] and got[0]["steps"][0]["args"] == {"text": "Floor plans"}
    (tmp_path / "p.html").write_text("<h1>a</h1>\n<p>b</p>")
    assert R.read_pages(spark, str(tmp_path / "p.html")).collect()[0]["html"].count("\n") == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("scraper", 10, 5), ("scraper", None, 1)], "source string, input_tok long, output_tok long")
    for _ in range(2):
        W.append_jsonl(rows, str(tmp_path / "log"), "2026-05-01 00:00:00")
        W.append_fact(rows, str(tmp_path / "fact"), W.COST_DEFAULTS)
    assert sorted(r["total_tok"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 1, 15, 15]
    fact = spark.read.parquet(str(tmp_path / "fact"))
    assert fact.count() == 4 and fact.where("input_tok IS NULL OR api_calls <> 0").count() == 0
    found = spark.createDataFrame([("a", "Oslo"), ("b", "Oslo"), ("c", "Bergen")], "title string, city string")
    W.write_document(found, str(tmp_path / "doc"), 0.012)
    assert spark.read.json(str(tmp_path / "doc/summary")).collect()[0]["total"] == 3
    assert spark.read.json(str(tmp_path / "doc/apartments")).count() == 3


def test_read_table(spark, tmp_path):
    spark.createDataFrame([(1, 2.5)], "plan_id long, price double").write.parquet(str(tmp_path / "h"))
    assert R.read_table(spark, str(tmp_path / "h"), "price_history").columns == ["plan_id", "price", "recorded_at"]


def test_status_stream_equals_sequential_rule(spark, tmp_path):
    state = spark.createDataFrame([("m1", "email", "sent"), ("m2", "email", "clicked"), ("m3", "telegram", "sent")], "external_id string, channel string, status string")
    updates = str(tmp_path / "updates")
    (tmp_path / "in").mkdir()
    checkpoint = str(tmp_path / "ck")
    for i, batch in enumerate([
        [("delivered", "m1.f"), ("open", "m1.f"), ("delivered", "m1.f"), ("open", "m2")], [("bounce", "m1"), ("unsubscribe", "m1.x"), ("click", "m3"), ("processed", "m2")],
    ]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps([{"event": e, "sg_message_id": m} for e, m in batch]))
        events = R.read_webhook_stream(spark, str(tmp_path / "in"))
        start_status_stream(events, state, updates, checkpoint, ["request", "place"]).awaitTermination(120)
    assert batches_written(spark, updates) == 2
    got = {r["external_id"]: r["status"] for r in current_status(state, read_updates(spark, updates, 2)).collect()}
    assert got == {"m1": "unsubscribed", "m2": "clicked", "m3": "sent"}


def test_alert_stream_fires_once(spark, tmp_path):
    t = Tables(spark, SF_DIR)
    rules = t.subscriptions.where("plan_id IS NOT NULL").withColumns({"target_price": F.lit(1e9), "last_notified_at": F.lit(None).cast("timestamp_ntz")})
    state = prepare_alert_state(str(tmp_path / "state"), rules, t.price_history.limit(0), buckets=8)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    parts = [t.price_history.where(F.col("recorded_at") < cut), t.price_history.where(F.col("recorded_at") >= cut)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        start_alert_stream(stream, state, str(tmp_path / "ck"), t.units, t.plans, t.apartments, "2001-11-05 00:00:00").awaitTermination(180)
    events = [R.read_fact(spark, state.events, "subscription_id long", [run]).select("subscription_id").distinct() for run in (1, 2)]
    active = rules.where("is_active").count()
    left = current_rules(spark, state).where("is_active").count()
    fired = events[0].count()
    assert fired > 0 and left <= active - fired
    assert events[0].join(events[1], "subscription_id").count() == 0


def test_alert_stream_follows_the_time_of_its_rows(spark, tmp_path):
    """One rule, a falling price on three days: a day's second alert is held back, two days later it may fire again."""
    t = Tables(spark, SF_DIR)
    rule = t.subscriptions.where("plan_id IS NOT NULL AND is_active").limit(1).withColumns({
        "target_price": F.lit(None).cast("double"), "price_drop_pct": F.lit(1.0), "baseline_price": F.lit(9000.0), "last_notified_at": F.lit(None).cast("timestamp_ntz"),
        "notify_email": F.lit(True),
    })
    plan = rule.first()["plan_id"]
    state = prepare_alert_state(str(tmp_path / "state"), rule, t.price_history.limit(0), buckets=8)
    stamps = []
    for i, (when, price) in enumerate([("2001-03-01 08:00:00", 5000.0), ("2001-03-01 20:00:00", 4000.0), ("2001-03-03 21:00:00", 3000.0)]):
        row = spark.createDataFrame([(plan, price, when, i, i)], "plan_id long, price double, at string, seq long, line int")
        row = row.withColumn("recorded_at", F.col("at").cast("timestamp_ntz")).select(*[F.col(c).cast(d) for c, d in t.price_history.dtypes])
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(row.schema).parquet(str(tmp_path / "in"))
        start_alert_stream(stream, state, str(tmp_path / "ck"), t.units, t.plans, t.apartments).awaitTermination(180)
        now = current_rules(spark, state).first()
        stamps.append(str(now["last_notified_at"]))
        if not now["is_active"]:
            break
    assert stamps[0] == "2001-03-01 08:00:00"
    assert len(stamps) == 1 or (stamps[1] == stamps[0] and stamps[2] == "2001-03-03 21:00:00")


def files(path):
    """Data files below a folder, by the folder they are in."""
    return {str(f.relative_to(path)) for f in path.rglob("part-*.parquet")}


def test_alert_batch_reads_and_writes_its_own_buckets(spark, tmp_path):
    """Many plans with a rule each; a batch of one plan looks at one bucket, and so does a rule whose debounce has ended."""
    t = Tables(spark, SF_DIR)
    rule = t.subscriptions.where("plan_id IS NOT NULL").limit(1).drop("id", "plan_id", "is_active").withColumn("one", F.lit(1))
    base = {"target_price": F.lit(3000.0), "price_drop_pct": F.lit(None).cast("double"), "last_notified_at": F.lit(None).cast("timestamp_ntz"), "notify_email": F.lit(True)}
    rules = spark.range(100).select("id", F.col("id").alias("plan_id"), F.lit(True).alias("is_active"), F.lit(1).alias("one")).join(rule, "one").withColumns(base)
    columns = t.price_history.dtypes
    row = lambda plan, price, when, seq: spark.createDataFrame(
        [(plan, price, when, seq, 0)], "plan_id long, price double, recorded_at string, seq long, line int").select(*[F.col(c).cast(d) for c, d in columns])
    waits = F.when(F.col("plan_id") == 7, F.lit("2001-03-01 12:00:00").cast("timestamp_ntz"))
    state = prepare_alert_state(str(tmp_path / "s"), rules.select(*t.subscriptions.columns).withColumn("last_notified_at", waits), t.price_history.limit(0), buckets=64)
    run = lambda batch, n: alert_batch(state, batch, n, t.units, t.plans, t.apartments)
    of = lambda plan: state.rules.touched(spark.createDataFrame([(plan,)], "plan_id long"), "plan_id")
    assert len(run(row(7, 3500.0, "2001-03-01 13:00:00", 0), 1)) > 20  # the first run looks at every rule
    assert run(row(7, 2500.0, "2001-03-01 20:00:00", 1), 2) == of(7)  # held back: notified eight hours before
    before = files(tmp_path / "s")
    assert run(row(9, 4000.0, "2001-03-02 13:00:00", 2), 3) == of(9) | of(7)  # a day on, rule 7 is due without a row of its own
    assert {f.split("/")[3] for f in files(tmp_path / "s") - before if f.startswith("rules/rows/home=3")} == {f"hash_bucket={b}" for b in of(9) | of(7)}
    events = lambda: [(r["subscription_id"], r["run"]) for r in R.read_fact(spark, state.events, "subscription_id long").collect()]
    assert events() == [(7, 3)]
    after = sorted(map(str, current_rules(spark, state).collect()))
    assert run(row(9, 4000.0, "2001-03-02 13:00:00", 2), 3) == of(9) | of(7)  # a repeated run gives the same
    assert sorted(map(str, current_rules(spark, state).collect())) == after and events() == [(7, 3)]


def test_status_batches_stay_logarithmic(spark, tmp_path):
    assert all(len(levels(n)) <= n.bit_length() and sum(s for _, s in levels(n)) == n for n in range(200))
    notes = spark.createDataFrame([(f"m{i}", "email", "sent") for i in range(6)], "external_id string, channel string, status string")
    kinds, path, want = ["delivered", "open", "click", "bounce"], str(tmp_path / "u"), {}
    rank = {"sent": 0, "delivered": 1, "opened": 2, "clicked": 3, "bounced": 4}
    names = dict(zip(kinds, ["delivered", "opened", "clicked", "bounced"], strict=True))

    def batch(i):
        return spark.createDataFrame([(kinds[(i * 7) % 4 if i % 3 else 0], f"m{i % 6}.x", i, 0)], "event string, sg_message_id string, request long, place int")

    for i in range(11):
        status_batch(batch(i), notes, path, i, ["request", "place"])
        kind, message = kinds[(i * 7) % 4 if i % 3 else 0], f"m{i % 6}"
        if rank[names[kind]] >= rank[want.get(message, "sent")]:
            want[message] = names[kind]
    got = lambda: {r["external_id"]: r["status"] for r in current_status(notes, read_updates(spark, path, 11)).collect()}
    assert got() == {f"m{i}": want.get(f"m{i}", "sent") for i in range(6)}
    folders = sorted({f.rsplit("/", 1)[0] for f in files(tmp_path / "u")})
    status_batch(batch(10), notes, path, 10, ["request", "place"])
    assert sorted({f.rsplit("/", 1)[0] for f in files(tmp_path / "u")}) == folders and got() == {f"m{i}": want.get(f"m{i}", "sent") for i in range(6)}


def test_facts_of_a_repeated_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 5)], "plan_id long, input_tok long")
    for run in (1, 2, 2):
        W.append_fact(rows, str(tmp_path / "f"), W.COST_DEFAULTS, run=run)
    (tmp_path / "f/run=3").mkdir()  # a writer that broke off
    back = R.read_fact(spark, str(tmp_path / "f"), "plan_id long, input_tok long, api_calls int")
    assert sorted((r["run"], r["plan_id"], r["input_tok"]) for r in back.collect()) == [(1, 1, 0), (1, 2, 5), (2, 1, 0), (2, 2, 5)]
    assert R.read_fact(spark, str(tmp_path / "none"), "plan_id long").count() == 0


def test_refresh_writes_what_a_snapshot_touches(spark, tmp_path):
    """Ten listings of the fixtures: at most ten buckets are written, the rows are those of the whole merge, and a repeated run gives the same."""
    t = Tables(spark, "/root/testdata/sf0.01")
    ids = [r[0] for r in t.snapshot.select("apartment_id").distinct().orderBy("apartment_id").limit(10).collect()]
    snapshot = t.snapshot.where(F.col("apartment_id").isin(ids))
    known = t.apartments
    store = E.new_store(str(tmp_path / "s"), known, t.plans, t.units, t.subscriptions, buckets=128)
    whole = G.apply_snapshot(known, t.plans, t.units, t.subscriptions, snapshot, "2001-11-05 00:00:00", ("host",))
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))

    def compare():
        for name, cols in (("plans", t.plans.columns), ("units", t.units.columns), ("rules", ["id", "is_active"])):
            assert rows(getattr(store, name).read(spark), cols) == rows(whole[name], cols), name
        for name in ("history", "notices"):
            kept = R.read_fact(spark, f"{store.facts}/{name}", ", ".join(f"{c} {d}" for c, d in whole[name].dtypes))
            assert rows(kept, whole[name].columns) == rows(whole[name], whole[name].columns)

    written = E.refresh(spark, store, snapshot, "2001-11-05 00:00:00", 1, ("host",))
    assert all(0 < len(b) <= 10 for b in written.values())
    compare()
    at = lambda: {f.rsplit("/", 1)[0] for f in files(tmp_path / "s")}
    folders = at()
    assert sum("plans/rows/home=1/" in f for f in folders) <= 10
    assert E.refresh(spark, store, snapshot, "2001-11-05 00:00:00", 1, ("host",)) == written
    compare()
    assert at() == folders
