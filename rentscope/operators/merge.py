"""Table-to-table merges: old table plus delta gives the new table."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentscope.functions import labels as T
from rentscope.functions import urls as U
from rentscope.operators import folds
from rentscope.operators import matching as M
from rentscope.operators import quality as Q
from rentscope.operators.alerts import area_prices
from rentscope.operators.history import last_two
from rentscope.operators.listings import min_price_by_apartment
from rentscope.operators.scale import cut_lineage, instant, lookup, newest, number_by_hash
from rentscope.operators.setops import first_seen, missing_children


def next_ids(fresh: DataFrame, key: Sequence[str], stored: DataFrame, out: str = "id") -> DataFrame:
    """Ids above the stored maximum, dense in order of the key's hash; no single task orders all rows."""
    top = F.coalesce(stored.agg(F.max("id")).scalar(), F.lit(0))
    return number_by_hash(fresh, key, "_no").withColumn(out, top + F.col("_no")).drop("_no")


# --- places ----------------------------------------------------------------------------------

SHARED = ("title", "city", "source_url")
# The plan given to a place stored for the first time.
DEFAULT_PLAN = {"name": "Default Plan", "bedrooms": 1.0, "bathrooms": 1.0, "area_sqft": 800.0, "price": 0.0, "is_available": True}


def upsert_places(target: DataFrame, incoming: DataFrame, order: str) -> dict[str, DataFrame]:
    """Update shared columns by external id, insert the rest with one default plan, count the inserts.

    The last incoming row of an id wins.
    """
    last = newest(incoming, ["external_id"], [order], list(SHARED))
    renamed = last.select("external_id", *[F.col(c).alias(f"_{c}") for c in SHARED], F.lit(True).alias("_in"))
    updated = target.join(renamed, "external_id", "left").withColumns(
        {c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) for c in SHARED}
    ).select(*target.columns)
    inserts = next_ids(last.join(target.select("external_id"), "external_id", "left_anti"), ["external_id"], target)
    places = updated.unionByName(inserts.withColumn("is_available", F.lit(True)), allowMissingColumns=True)
    plans = inserts.select(F.col("id").alias("apartment_id"), *[F.lit(v).alias(k) for k, v in DEFAULT_PLAN.items()])
    return {"places": places, "plans": plans, "inserted": inserts.agg(F.count(F.lit(1)).alias("inserted"))}


def upsert_by_key(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Full replacement of matching rows, insertion of new ones; ``incoming`` is unique by key."""
    keep = target.join(incoming.select(key), key, "left_anti")
    return keep.unionByName(incoming, allowMissingColumns=True)


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    values = [c for c in incoming.columns if c != key]
    fresh = first_seen(incoming, [key], order, values)
    return fresh.join(target.select(key), key, "left_anti")


# --- scraped plans ---------------------------------------------------------------------------

# Fixed value: the name of a plan made from rows without one.
NAMELESS = "Unit"
# Fixed value: sizes this close (in square feet) can be one plan.
SIZE_TOLERANCE = 5


def match_plans(snapshot: DataFrame, plans: DataFrame) -> DataFrame:
    """(apartment_id, pos, name, tier, plan_id, made_by) for every snapshot row, as if rows were matched one after the other by ``pos``.

    1 active plan of the name, 2 archived plan of the name, which is active from then on, 3 the only active plan of equal bedrooms and
    like size, 4 a plan to be created, NULL when nothing fits.  Plans made or woken by earlier rows of the snapshot are candidates like the
    stored ones; one that the snapshot made is named by the ``pos`` of its row in ``made_by`` instead of ``plan_id``.  Rows without a name make
    plans called NAMELESS and are found by size only.  Of several plans of one name the lowest id (or the first made) counts.

    Only rows without a stored plan of their name depend on earlier rows: by size within a run of neighbouring sizes of one listing
    and bed count, which is folded in order, and by name with other runs.  The latter is settled in rounds: each folds all runs with the names
    made elsewhere as the last round left them, until they stay.  Since a row depends on earlier rows only, what stays is the result of
    the sequential rule.
    """
    named = plans.groupBy(F.col("apartment_id").alias("_apt"), F.col("name").alias("_name")).agg(
        F.min(F.when(F.col("is_available"), F.col("id"))).alias("active_id"),
        F.min(F.when(~F.col("is_available"), F.col("id"))).alias("archived_id"),
    )
    rows = snapshot.select("apartment_id", F.col("pos").cast("long").alias("pos"), "name", "bedrooms", "size_sqft")
    rows = cut_lineage(rows.join(named, (F.col("apartment_id") == F.col("_apt")) & F.col("name").eqNullSafe(F.col("_name")), "left").drop("_apt", "_name"))
    wakes = F.col("active_id").isNull() & F.col("archived_id").isNotNull()
    woken = rows.where(wakes).groupBy("archived_id").agg(F.min("pos").alias("woken_at"))
    by_name = rows.where(F.coalesce("active_id", "archived_id").isNotNull()).join(woken, "archived_id", "left").select(
        "apartment_id", "pos", "name", F.when(wakes & (F.col("pos") == F.col("woken_at")), 2).otherwise(1).alias("tier"),
        F.coalesce("active_id", "archived_id").alias("plan_id"), F.lit(None).cast("long").alias("made_by"),
    )
    loose = rows.where(F.coalesce("active_id", "archived_id").isNull()).drop("active_id", "archived_id")
    elements = cut_lineage(_fold_elements(loose, plans, woken))
    folded = _folded(elements)
    made = folded.where("tier = 4").groupBy("apartment_id", F.col("makes").alias("name")).agg(F.min("pos").alias("known_at"))
    bedless = loose.where(F.col("bedrooms").isNull()).join(made, ["apartment_id", "name"], "left")
    seen = F.col("known_at") < F.col("pos")
    none = F.lit(None).cast("long")
    out = folded.select("apartment_id", "pos", "name", "tier", "plan_id", "made_by").unionByName(
        bedless.select("apartment_id", "pos", "name", F.when(seen, 1).alias("tier"), none.alias("plan_id"), F.when(seen, F.col("known_at")).alias("made_by"))
    )
    return by_name.unionByName(out).withColumn("pos", F.col("pos").cast(snapshot.schema["pos"].dataType))


def _fold_elements(loose: DataFrame, plans: DataFrame, woken: DataFrame) -> DataFrame:
    """What the fold goes through: rows without a plan of their name, and archived plans from the row on that wakes them, in their runs."""
    near = M.near_plans(loose, plans, SIZE_TOLERANCE).withColumnRenamed("plan_id", "near_id")
    probes = loose.where(F.col("bedrooms").isNotNull()).join(near, ["apartment_id", "pos"], "left").select(
        "apartment_id", "pos", "bedrooms", "name", F.coalesce("size_sqft", F.lit(0.0)).alias("size"), F.col("size_sqft").alias("probe"),
        F.coalesce("candidates", F.lit(0)).alias("near_n"), "near_id", F.lit(None).cast("long").alias("id"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit(NAMELESS)).alias("makes"),
    )
    arrivals = plans.where(F.col("area_sqft").isNotNull() & F.col("bedrooms").isNotNull()).join(woken, F.col("id") == F.col("archived_id")).select(
        "apartment_id", F.col("woken_at").alias("pos"), "bedrooms", F.col("area_sqft").alias("size"), "id"
    )
    both = probes.unionByName(arrivals, allowMissingColumns=True)
    return M.size_runs(both, ["apartment_id", "bedrooms"], "size", lambda s: F.floor(s / 100), lambda before, s: s - before > SIZE_TOLERANCE)


FOLD_ORDER = ("pos", "id", "name", "makes", "size", "probe", "near_n", "near_id", "known_at")
PLACED = "pos bigint, name string, makes string, tier int, plan_id bigint, made_by bigint"


class _Run:
    """What rows of one run have made or woken so far: per name the first plan, per size the first two, since a third changes no count of one."""

    def __init__(self) -> None:
        self.sizes, self.of_size, self.of_name = [], {}, {}

    def grow(self, size: float, pos: int | None, id_: int | None) -> None:
        if not math.isfinite(size):
            return
        if size not in self.of_size:
            bisect.insort(self.sizes, size)
        held = self.of_size.setdefault(size, [])
        if len(held) < 2:
            held.append((pos, id_))

    def near(self, probe: float | None) -> list[tuple]:
        """Plans of like size, all of them if there are fewer than two."""
        found = []
        if probe is None or not math.isfinite(probe):
            return found
        i = bisect.bisect_left(self.sizes, probe - SIZE_TOLERANCE)
        while i > 0 and abs(self.sizes[i - 1] - probe) <= SIZE_TOLERANCE:
            i -= 1
        while i < len(self.sizes) and len(found) < 2 and self.sizes[i] - probe <= SIZE_TOLERANCE:
            if abs(self.sizes[i] - probe) <= SIZE_TOLERANCE:
                found += self.of_size[self.sizes[i]]
            i += 1
        return found

    def placed(self, e: dict) -> tuple | None:
        """(pos, name, makes, tier, plan_id, made_by) of a probing row; nothing for an archived plan that is woken."""
        pos, name, elsewhere = e["pos"], e["name"], e["known_at"]
        if e["id"] is not None:
            self.grow(e["size"], None, e["id"])
            return None
        known = [p for p in (self.of_name.get(name), elsewhere if elsewhere is not None and pos is not None and elsewhere < pos else None) if p is not None]
        like = self.near(e["probe"])
        if known:
            return pos, name, e["makes"], 1, None, min(known)
        if e["near_n"] + len(like) == 1:
            made_by, plan_id = like[0] if like else (None, e["near_id"])
            return pos, name, e["makes"], 3, plan_id, made_by
        self.grow(e["size"], pos, None)
        if self.of_name.get(e["makes"]) is None:
            self.of_name[e["makes"]] = pos
        return pos, name, e["makes"], 4, None, pos


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places rows that come run by run, each in order; only the plans of the run at hand are held."""
    at, run = None, _Run()
    for batch in batches:
        rows = []
        for e in batch.to_pylist():
            key = e["apartment_id"], e["grp"], e["run"]
            if key != at:
                at, run = key, _Run()
            placed = run.placed(e)
            if placed:
                rows.append((e["apartment_id"], *placed))
        types = [batch.schema.field("apartment_id").type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        names = ["apartment_id", "pos", "name", "makes", "tier", "plan_id", "made_by"]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _folded(elements: DataFrame) -> DataFrame:
    """(apartment_id, pos, name, makes, tier, plan_id, made_by) of the probing rows."""
    names = elements.where(F.col("id").isNull()).groupBy("apartment_id", F.col("makes").alias("name"))
    shared = names.agg(F.count_distinct("grp", "run").alias("n")).where("n > 1").select("apartment_id", "name")
    known = cut_lineage(shared.limit(0).withColumn("known_at", F.lit(None).cast("long")))
    keys = ["apartment_id", "grp", "run"]
    schema = f"apartment_id {elements.schema['apartment_id'].dataType.simpleString()}, {PLACED}"
    while True:
        ordered = elements.join(known, ["apartment_id", "name"], "left").select(*keys, *FOLD_ORDER).repartition(*keys).sortWithinPartitions(*keys, *FOLD_ORDER)
        out = cut_lineage(ordered.mapInArrow(_fold, schema))
        now = out.where("tier = 4").groupBy("apartment_id", F.col("makes").alias("name")).agg(F.min("pos").alias("known_at")).join(
            shared, ["apartment_id", "name"], "left_semi"
        )
        now = cut_lineage(now)
        if now.exceptAll(known).isEmpty() and known.exceptAll(now).isEmpty():
            return out
        known = now


def new_plans(snapshot: DataFrame, matched: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows for the plans to be created, each described by the snapshot row that makes it; ``made_by`` is that row's ``pos``.

    Ids follow the greatest one of ``plans``, of which no other column is read.
    """
    rows = snapshot.join(matched.where(F.col("tier") == 4).select("apartment_id", "pos"), ["apartment_id", "pos"], "left_semi")
    numbered = next_ids(rows, ["apartment_id", "pos"], plans)
    return numbered.select(
        "id", "apartment_id", F.coalesce(F.nullif("name", F.lit("")), F.lit(NAMELESS)).alias("name"), "bedrooms",
        F.when(F.col("bathrooms") != 0, F.col("bathrooms")).otherwise(1.0).alias("bathrooms"),
        F.coalesce("size_sqft", F.lit(0.0)).alias("area_sqft"), F.col("min_price").alias("price"),
        F.col("min_price").alias("current_price"), F.lit(True).alias("is_available"), F.col("pos").cast("long").alias("made_by"),
    )


def refreshed_plans(matched_rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans after a scrape: price envelope and back-filled descriptors, then plans not seen go stale.

    The cheapest row speaks for the plan.  Size is taken when missing or off by more than 10, beds and
    baths when known, the name only over a placeholder; unknown values never overwrite.
    """
    values = ["name", "size_sqft", "bedrooms", "bathrooms", "external_url", "floor_level", "facing"]
    rep = matched_rows.groupBy("plan_id").agg(
        F.min_by(F.struct(*values), folds.price_rank("min_price", "pos")).alias("r"),
        F.min("min_price").alias("_min"), F.max("min_price").alias("_max"),
    ).withColumnRenamed("plan_id", "id")
    seen = matched_rows.select("apartment_id", F.lit(True).alias("_apt_seen")).distinct()
    joined = plans.join(rep, "id", "left").join(seen, "apartment_id", "left")
    hit = F.col("r").isNotNull()
    size, name = F.col("r.size_sqft"), F.col("r.name")
    take = lambda new, old: F.when(hit, F.coalesce(new, F.col(old))).otherwise(F.col(old))
    return joined.withColumns({
        "area_sqft": F.when(
            size.isNotNull() & (F.col("area_sqft").isNull() | (F.abs(F.col("area_sqft") - size) > 10)), size
        ).otherwise(F.col("area_sqft")),
        "bedrooms": take(F.col("r.bedrooms"), "bedrooms"),
        "bathrooms": take(F.col("r.bathrooms"), "bathrooms"),
        "name": F.when(hit & (name != "") & F.coalesce(F.col("name"), F.lit("")).isin("", "Unit"), name).otherwise(F.col("name")),
        "external_url": take(F.nullif(F.col("r.external_url"), F.lit("")), "external_url"),
        "floor_level": take(F.col("r.floor_level"), "floor_level"),
        "facing": take(F.nullif(F.col("r.facing"), F.lit("")), "facing"),
        "price": F.when(hit, F.col("_min")).otherwise(F.col("price")),
        "current_price": F.when(hit, F.col("_min")).otherwise(F.col("current_price")),
        "max_price": F.when(hit, F.nullif("_max", "_min")).otherwise(F.col("max_price")),
        "is_available": F.when(hit, True).when(F.col("_apt_seen"), False).otherwise(F.col("is_available")),
    }).drop("r", "_min", "_max", "_apt_seen")


def upsert_units(rows: DataFrame, units: DataFrame, today, seen_available: bool = False, numbered_after: DataFrame | None = None) -> DataFrame:
    """Units after a scrape, by (plan, unit number); the last row of a unit wins.

    Rows without a number share one anonymous unit per plan and further stored ones are archived.
    Where a plan's rows carry numbers, its other numbered units have been let.  New ids follow the greatest of ``numbered_after`` (``units``).
    """
    flag, starts = T.parse_availability(F.col("availability"), today)
    number = F.nullif("unit_number", F.lit(""))
    fields = {
        "price": F.col("min_price"), "area_sqft": F.col("size_sqft"), "floor_level": F.col("floor_level"),
        "facing": F.col("facing"), "available_from": starts,
        "is_available": F.lit(True) if seen_available else flag,
    }
    incoming = rows.select("plan_id", "pos", F.coalesce(number, F.lit("")).alias("_k"), *[c.alias(n) for n, c in fields.items()])
    last = newest(incoming, ["plan_id", "_k"], ["pos"], list(fields))
    per_plan = incoming.groupBy("plan_id").agg(
        F.bool_or(F.col("_k") == "").alias("_anon"), F.bool_or(F.col("_k") != "").alias("_numbered")
    )
    stored = units.withColumn("_k", F.coalesce("unit_number", F.lit("")))
    first_id = stored.groupBy("plan_id", "_k").agg(F.min("id").alias("id")).withColumn("_main", F.lit(True))
    fresh = last.select("plan_id", "_k", *[F.col(n).alias(f"_{n}") for n in fields], F.lit(True).alias("_hit"))
    old = (
        stored.join(first_id.select("id", "_main"), "id", "left")
        .join(fresh, ["plan_id", "_k"], "left")
        .join(per_plan, "plan_id", "left")
    )
    update = F.col("_main") & F.col("_hit")
    gone = F.when(F.col("_k") == "", F.col("_anon") & F.col("_main").isNull()).otherwise(F.col("_numbered") & F.col("_hit").isNull())
    changed = {n: F.when(update, F.col(f"_{n}")).otherwise(F.col(n)) for n in fields}
    changed["is_available"] = F.when(update, F.col("_is_available")).when(F.coalesce(gone, F.lit(False)), False).otherwise(
        F.col("is_available")
    )
    kept = old.withColumns(changed).select(*units.columns)
    added = next_ids(last.join(first_id, ["plan_id", "_k"], "left_anti"), ["plan_id", "_k"], units if numbered_after is None else numbered_after)
    return kept.unionByName(added.withColumn("unit_number", F.nullif("_k", F.lit(""))).select(*units.columns))


def pause_let_units(rules: DataFrame, units: DataFrame, plans: DataFrame, scraped: DataFrame) -> DataFrame:
    """Unit alerts are switched off whose unit belongs to a scraped listing (``scraped``: apartment_id) and can no longer be rented."""
    of_scraped = plans.join(scraped.select("apartment_id").distinct(), "apartment_id", "left_semi").select(F.col("id").alias("plan_id"))
    let = units.where(~F.col("is_available")).join(of_scraped, "plan_id", "left_semi")
    let = let.select(F.col("id").alias("unit_id"), F.lit(True).alias("_let"))
    return lookup(rules, let, "unit_id").withColumn("is_active", F.col("is_active") & F.col("_let").isNull()).drop("_let")


def unavailable_notices(rules: DataFrame, paused: DataFrame, as_of) -> DataFrame:
    """One message event for every rule that ``pause_let_units`` has just switched off."""
    now_off = paused.where(~F.col("is_active")).select("id")
    return rules.where("is_active").join(now_off, "id", "left_semi").select(
        F.col("id").alias("subscription_id"), "user_id", "unit_id", F.lit("unit_unavailable").alias("trigger_type"), instant(as_of).alias("sent_at")
    )


# Amenities that a scrape may know.
AMENITIES = ("pets_allowed", "has_parking", "has_pool", "has_gym", "has_dishwasher", "has_washer_dryer", "has_air_conditioning")


def apply_snapshot(
    apartments: DataFrame, plans: DataFrame, units: DataFrame, rules: DataFrame, snapshot: DataFrame, as_of,
    hosts=M.RENAMING_HOSTS, scraped: DataFrame | None = None, tops: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The whole refresh: amenities and special, sanitise, rename, match, update plans and units, append history, pause alerts.

    ``hosts`` are the sites whose generic plan names give way to codes.  ``scraped`` has one row of what else a scrape found for each
    listing: its id, any of AMENITIES (NULL: unknown) and ``current_special`` (NULL: none).  ``tops`` has the greatest ids of the
    whole tables where ``plans`` and ``units`` are parts of them.  Cleaned rows, renamed plans and placed rows are each read by several
    later steps, so each is written once.
    """
    clean = cut_lineage(Q.sanitise(snapshot))
    renames = M.rename_generic(clean, plans, apartments, hosts).withColumnRenamed("plan_id", "id")
    named = cut_lineage(
        plans.join(renames, "id", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")
    )
    matched = cut_lineage(match_plans(clean, named))
    tops = tops or {}
    created = cut_lineage(new_plans(clean, matched, tops.get("plans", named)))
    ids = created.select("apartment_id", "made_by", F.col("id").alias("new_id"))
    placed = matched.join(ids, ["apartment_id", "made_by"], "left").select(
        "apartment_id", "pos", F.coalesce("plan_id", "new_id").alias("plan_id")
    ).where(F.col("plan_id").isNotNull())
    rows = cut_lineage(clean.join(placed, ["apartment_id", "pos"]))
    all_plans = named.unionByName(created.drop("made_by"), allowMissingColumns=True)
    after = refreshed_plans(rows, all_plans)
    history = rows.groupBy("plan_id").agg(F.min("min_price").alias("price")).where(F.col("price").isNotNull()).withColumn(
        "recorded_at", instant(as_of)
    )
    new_units = upsert_units(rows, units, as_of, seen_available=True, numbered_after=tops.get("units"))
    paused = pause_let_units(rules, new_units, all_plans, clean)
    if scraped is not None:
        keep = [c for c in AMENITIES if c in scraped.columns]
        apartments = merge_amenities(apartments, scraped, keep, [c for c in ("current_special",) if c in scraped.columns])
    return {
        "apartments": apartments, "plans": after, "units": new_units, "history": history, "rules": paused,
        "notices": unavailable_notices(rules, paused, as_of),
    }


def mark_stale_plans(plans: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Active plans absent from a non-empty snapshot of their apartment become unavailable."""
    gone = missing_children(plans.where("is_available"), snapshot, "apartment_id", "name").select("id", F.lit(True).alias("_g"))
    return plans.join(gone, "id", "left").withColumn("is_available", F.col("is_available") & F.col("_g").isNull()).drop("_g")


def merge_amenities(apartments: DataFrame, scraped: DataFrame, keep: Sequence[str], overwrite: Sequence[str]) -> DataFrame:
    """Unknown amenities keep the stored value; the current special is always replaced."""
    fresh = scraped.select("id", *[F.col(c).alias(f"_{c}") for c in (*keep, *overwrite)], F.lit(True).alias("_in"))
    joined = apartments.join(fresh, "id", "left")
    changes = {c: F.coalesce(f"_{c}", c) for c in keep}
    changes |= {c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) for c in overwrite}
    return joined.withColumns(changes).select(*apartments.columns)


def seed_plans(plans: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Upsert by (apartment, name) from the priced rows; the last row's price and flag hold."""
    order = F.col("pos")
    live = availability(F.col("availability"))
    last_known = lambda c, ok: F.max_by(F.col(c), F.when(ok, order))
    rows = snapshot.where(F.col("min_price").isNotNull()).groupBy("apartment_id", "name").agg(
        F.max_by("min_price", order).alias("_price"), F.max_by(live, order).alias("_live"),
        last_known("size_sqft", F.col("size_sqft") != 0).alias("_size"),
        last_known("floor_level", F.col("floor_level").isNotNull()).alias("_floor"),
        last_known("facing", F.col("facing") != "").alias("_facing"),
        last_known("external_url", F.col("external_url") != "").alias("_url"),
        F.min_by("bedrooms", order).alias("_beds"), F.min_by("bathrooms", order).alias("_baths"),
    )
    main = plans.groupBy("apartment_id", "name").agg(F.min("id").alias("id"))
    hits = rows.join(main, ["apartment_id", "name"]).drop("apartment_id", "name").withColumn("_in", F.lit(True))
    joined = plans.join(hits, "id", "left")
    on = F.col("_in")
    updated = joined.withColumns({
        "price": F.when(on, F.col("_price")).otherwise(F.col("price")),
        "current_price": F.when(on, F.col("_price")).otherwise(F.col("current_price")),
        "is_available": F.when(on, F.col("_live")).otherwise(F.col("is_available")),
        "area_sqft": F.coalesce("_size", "area_sqft"), "floor_level": F.coalesce("_floor", "floor_level"),
        "facing": F.coalesce("_facing", "facing"), "external_url": F.coalesce("_url", "external_url"),
    }).select(*plans.columns)
    fresh = next_ids(rows.join(main, ["apartment_id", "name"], "left_anti"), ["apartment_id", "name"], plans).select(
        "id", "apartment_id", "name", F.coalesce("_beds", F.lit(0.0)).alias("bedrooms"),
        F.when(F.col("_baths") != 0, F.col("_baths")).otherwise(1.0).alias("bathrooms"),
        F.coalesce("_size", F.lit(0.0)).alias("area_sqft"), F.col("_price").alias("price"), F.col("_price").alias("current_price"),
        F.col("_live").alias("is_available"), F.col("_floor").alias("floor_level"), F.col("_facing").alias("facing"),
        F.col("_url").alias("external_url"),
    )
    return updated.unionByName(fresh, allowMissingColumns=True)


def availability(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~low.contains("waitlist") & ~low.contains("unavailable")


def seed_history(seeded: DataFrame, snapshot: DataFrame, as_of) -> DataFrame:
    """One history row per priced snapshot row."""
    ids = seeded.groupBy("apartment_id", "name").agg(F.min("id").alias("plan_id"))
    return snapshot.where(F.col("min_price").isNotNull()).join(ids, ["apartment_id", "name"]).select(
        "plan_id", F.col("min_price").alias("price"), instant(as_of).alias("recorded_at")
    )


# --- duplicates and repairs ------------------------------------------------------------------

def building_key(url: Column) -> Column:
    """Host and path without tracking, www, trailing slash or a floor-plan page suffix."""
    path = F.regexp_replace(U.path_of(url), "/+$", "")
    return F.concat(U.bare_domain(url), F.regexp_replace(path, "/floor-?plans$", ""))


def duplicate_map(apartments: DataFrame, plans: DataFrame) -> DataFrame:
    """(kill_id, keep_id): per building the listing with more plans stays, then the canonical url, then the lower id."""
    sizes = plans.groupBy(F.col("apartment_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    keyed = apartments.where(F.col("source_url").isNotNull()).join(sizes, "id", "left").select(
        "id", building_key(F.col("source_url")).alias("k"), F.coalesce("n", F.lit(0)).alias("n"),
        (~F.col("source_url").contains("utm_")).alias("canonical"),
    )
    keepers = keyed.groupBy("k").agg(
        F.max_by("id", F.struct("n", "canonical", (-F.col("id")).alias("low"))).alias("keep_id"), F.count(F.lit(1)).alias("c")
    ).where("c > 1").select("k", "keep_id")
    return keyed.join(keepers, "k").where(F.col("id") != F.col("keep_id")).select(F.col("id").alias("kill_id"), "keep_id")


def archive_plans(plans: DataFrame, kills: DataFrame, prefix: str = "[archived dup] ") -> DataFrame:
    hit = kills.select(F.col("kill_id").alias("apartment_id"), F.lit(True).alias("_k"))
    return plans.join(hit, "apartment_id", "left").withColumns({
        "is_available": F.col("is_available") & F.col("_k").isNull(),
        "name": F.when(F.col("_k"), T.with_prefix(F.col("name"), prefix)).otherwise(F.col("name")),
    }).drop("_k")


def archive_apartments(apartments: DataFrame, kills: DataFrame) -> DataFrame:
    hit = kills.withColumnRenamed("kill_id", "id")
    dead = F.col("keep_id").isNotNull()
    return apartments.join(hit, "id", "left").withColumns({
        "is_available": F.col("is_available") & ~dead,
        "data_source_type": F.when(dead, "unscrapeable").otherwise(F.col("data_source_type")),
        "title": F.when(dead, F.concat(F.lit("[archived dup of "), F.col("keep_id"), F.lit("] "), F.col("title"))).otherwise(F.col("title")),
    }).drop("keep_id")


def move_rules(rules: DataFrame, kills: DataFrame, plans: DataFrame) -> DataFrame:
    """Apartment rules follow the keeper with its cheapest current price as baseline."""
    low = min_price_by_apartment(plans, "current_price").select(F.col("apartment_id").alias("keep_id"), F.col("min_price").alias("_low"))
    hit = kills.withColumnRenamed("kill_id", "apartment_id").join(low, "keep_id", "left")
    moved = F.col("keep_id").isNotNull()
    return lookup(rules, hit, "apartment_id").withColumns({
        "apartment_id": F.coalesce("keep_id", "apartment_id"),
        "plan_id": F.when(~moved, F.col("plan_id")),
        "baseline_price": F.when(moved, F.col("_low")).otherwise(F.col("baseline_price")),
    }).drop("keep_id", "_low")


def move_children(children: DataFrame, kills: DataFrame) -> DataFrame:
    hit = kills.withColumnRenamed("kill_id", "apartment_id")
    return children.join(hit, "apartment_id", "left").withColumn("apartment_id", F.coalesce("keep_id", "apartment_id")).drop("keep_id")


def drop_parents(apartments: DataFrame, kills: DataFrame) -> DataFrame:
    return apartments.join(kills.select(F.col("kill_id").alias("id")), "id", "left_anti")


def backfill_baselines(rules: DataFrame, plans: DataFrame, apartments: DataFrame, history: DataFrame) -> DataFrame:
    """Baseline by level: plan history else plan price, cheapest apartment price, average of the area."""
    by_plan, by_apt = F.col("plan_id").isNotNull(), F.col("apartment_id").isNotNull()
    latest = last_two(history).select("plan_id", F.col("price").alias("_h"))
    stored = plans.select(F.col("id").alias("plan_id"), F.col("price").alias("_p"))
    low = min_price_by_apartment(plans).withColumnRenamed("min_price", "_low")
    area = area_prices(rules.where(~by_plan & ~by_apt), plans, apartments, True).select("id", F.col("price").alias("_avg"))
    by_plan_price = lookup(rules, latest.join(stored, "plan_id", "full_outer"), "plan_id")
    joined = lookup(by_plan_price, low, "apartment_id").join(area, "id", "left")
    return joined.withColumns({
        "baseline_price": F.when(by_plan, F.coalesce("_h", "_p")).when(by_apt, F.col("_low")).otherwise(F.col("_avg")),
        "baseline_recorded_at": F.col("created_at"),
    }).drop("_h", "_p", "_low", "_avg")


def backfill_current_price(plans: DataFrame, history: DataFrame) -> DataFrame:
    """Newest history price, NULL without history."""
    latest = last_two(history).select(F.col("plan_id").alias("id"), F.col("price").alias("_h"))
    return plans.join(latest, "id", "left").withColumn("current_price", F.col("_h")).drop("_h")


def deactivate_area_rules(rules: DataFrame) -> DataFrame:
    open_rule = F.col("plan_id").isNull() & F.col("apartment_id").isNull()
    return rules.withColumn("is_active", F.col("is_active") & ~open_rule)


def seed_registry(apartments: DataFrame, registry: DataFrame) -> DataFrame:
    """Domains of stored listings the registry does not know, with the defaults of a new row."""
    found = apartments.select(U.authority(F.col("source_url")).alias("domain")).where(F.col("domain") != "").distinct()
    return found.join(registry.select("domain"), "domain", "left_anti").select(
        "domain", F.lit(True).alias("is_active"), F.lit(None).cast("boolean").alias("robots_txt_allows"),
        F.lit("brand_site").alias("data_source_type"),
    )


def mirror_class(apartments: DataFrame, registry: DataFrame) -> DataFrame:
    """Class of the registry domain a listing's url contains; the longest domain decides."""
    urls = apartments.where(F.col("source_url").isNotNull()).select("id", F.lower("source_url").alias("u"))
    pairs = M.contains_join(urls, "u", registry.select("domain", F.col("data_source_type").alias("_t")), "domain")
    best = pairs.groupBy("id").agg(F.max_by("_t", F.struct(F.length("domain"), "domain")).alias("_t"))
    return apartments.join(best, "id", "left").withColumn("data_source_type", F.coalesce("_t", "data_source_type")).drop("_t")


def reclassify(apartments: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, new_type) overrides; the content hash is dropped so that the page is read again."""
    joined = apartments.join(mapping, "id", "left")
    hit = F.col("new_type").isNotNull()
    return joined.withColumns({
        "data_source_type": F.coalesce("new_type", "data_source_type"),
        "last_content_hash": F.when(~hit, F.col("last_content_hash")),
    }).drop("new_type")


def single_primary(images: DataFrame) -> DataFrame:
    """The newest primary image of an apartment stays primary."""
    top = images.where("is_primary").groupBy("apartment_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("_top"))
    return images.join(top, "apartment_id", "left").withColumn(
        "is_primary", F.coalesce(F.col("id") == F.col("_top"), F.lit(False))
    ).drop("_top")


def unsubscribe_all(rules: DataFrame, owners: DataFrame) -> DataFrame:
    hit = owners.select("user_id", F.lit(True).alias("_o")).distinct()
    return rules.join(hit, "user_id", "left").withColumn("is_active", F.col("is_active") & F.col("_o").isNull()).drop("_o")


def link_channel(rules: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, chat_id): a chat id enables chat on the owner's active rules, NULL removes it from all."""
    joined = rules.join(links.withColumn("_l", F.lit(True)), "user_id", "left")
    linked = F.col("_l") & F.col("chat_id").isNotNull() & F.col("is_active")
    removed = F.col("_l") & F.col("chat_id").isNull()
    return joined.withColumns({
        "notify_telegram": F.when(linked, True).when(removed, False).otherwise(F.col("notify_telegram")),
        "telegram_chat_id": F.when(linked, F.col("chat_id")).when(removed, None).otherwise(F.col("telegram_chat_id")),
    }).drop("_l", "chat_id")


def cascade_delete(dead: DataFrame, apartments, plans, units, history, images) -> dict[str, DataFrame]:
    """Apartments in ``dead`` (id) go with their plans, units, history and images."""
    gone = dead.select("id").distinct()
    by_apartment = gone.withColumnRenamed("id", "apartment_id")
    dead_plans = plans.join(by_apartment, "apartment_id", "left_semi").select(F.col("id").alias("plan_id"))
    return {
        "apartments": apartments.join(gone, "id", "left_anti"), "plans": plans.join(by_apartment, "apartment_id", "left_anti"),
        "units": units.join(dead_plans, "plan_id", "left_anti"), "history": history.join(dead_plans, "plan_id", "left_anti"),
        "images": images.join(by_apartment, "apartment_id", "left_anti"),
    }


# Extractors never remembered as a site's hint.
NEVER_HINTED = ("universal_dom",)


def update_hints(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest direct success per domain becomes the hint; its time moves only when the hint changes."""
    ok = runs.where(
        F.col("outcome").isin("platform_direct_static", "platform_direct_rendered") & F.col("adapter_name").isNotNull()
        & ~F.col("adapter_name").isin(*NEVER_HINTED)
    ).withColumn("domain", U.authority(F.col("url")))
    last = newest(ok, ["domain"], ["run_at", "id"], ["adapter_name", "run_at"])
    joined = registry.join(last, "domain", "left")
    changed = F.col("adapter_name").isNotNull() & ~F.col("adapter_name").eqNullSafe(F.col("last_successful_adapter"))
    return joined.withColumns({
        "last_successful_adapter": F.when(changed, F.col("adapter_name")).otherwise(F.col("last_successful_adapter")),
        "last_adapter_success_at": F.when(changed, F.col("run_at")).otherwise(F.col("last_adapter_success_at")),
    }).drop("adapter_name", "run_at")


def split_by_hash(apartments: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, unchanged) listings by page hash; a listing without a stored hash has changed."""
    joined = apartments.join(hashes.select("id", "new_hash"), "id")
    same = F.coalesce(F.col("last_content_hash") == F.col("new_hash"), F.lit(False))
    return joined.where(~same), joined.where(same)


def default_children(parents: DataFrame) -> DataFrame:
    """One default plan per parent whose four plan columns are all known."""
    cols = ["bedrooms", "bathrooms", "area_sqft", "current_price"]
    return parents.dropna(subset=cols).select(
        F.col("id").alias("apartment_id"), F.lit("Default Plan").alias("name"), "bedrooms", "bathrooms", "area_sqft",
        F.col("current_price").alias("price"), "is_available",
    )


def fold_first_child(apartments: DataFrame, plans: DataFrame) -> DataFrame:
    cols = ["bedrooms", "bathrooms", "area_sqft", "price", "available_from"]
    first = first_seen(plans, ["apartment_id"], "id", cols).withColumnRenamed("apartment_id", "id").withColumnRenamed("price", "current_price")
    return apartments.join(first, "id", "left")
