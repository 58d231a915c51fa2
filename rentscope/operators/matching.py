"""Entity matching: lookups by domain, url and name, and tolerance joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentscope.functions import predicates as P
from rentscope.functions import urls as U
from rentscope.operators.scale import cut_lineage, lag_by_segment


def not_known(candidates: DataFrame, apartments: DataFrame) -> DataFrame:
    """Candidates whose normalised url and external id are both unknown; stored listings without url know none."""
    urls = apartments.select(U.norm_url(F.col("source_url")).alias("_url")).where("_url <> ''").distinct()
    ids = apartments.where(F.col("external_id").isNotNull()).select("external_id").distinct()
    return (
        candidates.withColumn("_url", U.norm_url(F.col("source_url")))
        .join(urls, "_url", "left_anti")
        .join(ids, "external_id", "left_anti")
        .drop("_url")
    )


def first_of_new_domain(candidates: DataFrame, apartments: DataFrame, known_domains: DataFrame, order: str) -> DataFrame:
    """First candidate of each domain that neither the seed set nor the stored listings know."""
    known = (
        apartments.where(F.col("source_url").isNotNull())
        .select(U.bare_domain(F.col("source_url")).alias("domain"))
        .unionByName(known_domains.select("domain"))
        .distinct()
    )
    fresh = (
        candidates.withColumn("source_url", F.trim("source_url"))
        .where(F.col("source_url").startswith("http"))
        .withColumn("domain", U.bare_domain(F.col("source_url")))
        .join(known, "domain", "left_anti")
    )
    columns = [c for c in fresh.columns if c != "domain"]
    return fresh.groupBy("domain").agg(F.min_by(F.struct(*columns), F.struct(order)).alias("r")).select("domain", "r.*")


def registry_for(apartments: DataFrame, registry: DataFrame) -> DataFrame:
    """Active registry row of each listing's domain.  The registry is small; Spark sizes it and decides."""
    keyed = apartments.where(F.col("source_url").isNotNull()).withColumn("domain", U.authority(F.col("source_url")))
    return keyed.join(registry.where("is_active").drop("is_active"), "domain")


ANCHOR = 12


def contains_join(left: DataFrame, text: str, right: DataFrame, part: str) -> DataFrame:
    """Pairs where ``left.text`` contains ``right.part`` (a host name: it must hold a dot).

    Each host is anchored at the characters before its last dot; a text offers the same anchors at
    each of its own dots.  An equi join on anchors proposes pairs and ``contains`` decides, so the
    number of comparisons follows the matches rather than the product of both sides.  A host has one
    anchor and a text offers each anchor once, so no pair appears twice.
    """
    head = F.regexp_extract(F.col(part), r"^(.*)\.[^.]*$", 1)
    anchored = right.where(F.col(part).contains(".")).withColumn("_a", F.right(head, F.lit(ANCHOR)))
    dots = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(1)) == "."
    )
    lengths = F.array(*[F.lit(n) for n in range(0, ANCHOR + 1)])
    anchors = F.array_distinct(F.flatten(F.transform(
        dots,
        lambda d: F.transform(
            F.filter(lengths, lambda n: n < d), lambda n: F.substring(F.col(text), d - n, n)
        ),
    )))
    offered = left.where(F.col(text).isNotNull()).withColumn("_a", F.explode(anchors))
    return offered.join(anchored, "_a").where(F.col(text).contains(F.col(part))).drop("_a")


def near_plans(snapshot: DataFrame, plans: DataFrame, tolerance: int = 5) -> DataFrame:
    """(apartment_id, pos, candidates, plan_id): number and lowest id of the active plans of equal bedrooms and sqft within ``tolerance``.

    Plans are first counted per distinct (apartment, bedrooms, sqft); a row probes its own and the two
    neighbouring buckets of width ``tolerance``.  Rows without a candidate are left out.
    """
    width = float(tolerance)
    sized = (
        plans.where(F.col("is_available") & F.col("area_sqft").isNotNull())
        .groupBy("apartment_id", "bedrooms", "area_sqft")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
        .withColumn("_b", F.floor(F.col("area_sqft") / width))
    )
    probes = (
        snapshot.where(F.col("bedrooms").isNotNull() & F.col("size_sqft").isNotNull())
        .select("apartment_id", "pos", "bedrooms", "size_sqft")
        .withColumn("_b0", F.floor(F.col("size_sqft") / width))
        .withColumn("_b", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1)))
    )
    close = F.abs(F.col("area_sqft") - F.col("size_sqft")) <= tolerance
    return (
        probes.join(sized, ["apartment_id", "bedrooms", "_b"])
        .where(close)
        .groupBy("apartment_id", "pos")
        .agg(F.sum("_n").alias("candidates"), F.min("_id").alias("plan_id"))
    )


def unique_within(snapshot: DataFrame, plans: DataFrame, tolerance: int = 5) -> DataFrame:
    """Plan of a snapshot row by equal bedrooms and sqft within ``tolerance``, only when it is the only one."""
    return near_plans(snapshot, plans, tolerance).where(F.col("candidates") == 1).select("apartment_id", "pos", "plan_id")


def size_runs(rows: DataFrame, keys: Sequence[str], size: str, segment: Callable[[Column], Column], apart: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows with ``grp`` (their keys) and ``run``: sizes of one key in a row, cut where ``apart(previous, size)``.

    Only distinct sizes are put in order, per ``segment`` of them.
    """
    keyed = rows.withColumn("grp", F.concat_ws(":", *keys))
    sizes = keyed.select("grp", F.col(size).alias("_size")).distinct()
    gaps = lag_by_segment(sizes, "grp", segment(F.col("_size")), ["_size"], "_size", "_before")
    starts = gaps.where(F.col("_before").isNull() | apart(F.col("_before"), F.col("_size"))).groupBy("grp").agg(
        F.array_sort(F.collect_set("_size")).alias("_starts")
    )
    return keyed.join(starts, "grp").withColumn("run", F.size(F.filter("_starts", lambda s: s <= F.col(size)))).drop("_starts")


def name_or_near_size(snapshot: DataFrame, plans: DataFrame, base: str = "stored", tolerance: float = 0.10) -> DataFrame:
    """Plan id of each snapshot row: smallest id of the same name, else smallest id of like size.

    The relative difference is taken on the stored or the incoming size.  Sizes are bucketed on a log
    scale whose step exceeds the tolerance, so a row probes three buckets of distinct sizes.
    """
    by_name = plans.groupBy("apartment_id", "name").agg(F.min("id").alias("name_id"))
    step = float(F_LOG_STEP)
    bucket = lambda c: F.floor(F.log(c) / step)
    sized = (
        plans.where(F.col("area_sqft") > 0)
        .groupBy("apartment_id", "bedrooms", "area_sqft")
        .agg(F.min("id").alias("_id"))
        .withColumn("_b", bucket(F.col("area_sqft")))
    )
    probes = (
        snapshot.where(F.col("bedrooms").isNotNull() & (F.col("size_sqft") > 0))
        .select("apartment_id", "pos", "bedrooms", "size_sqft")
        .withColumn("_b0", bucket(F.col("size_sqft")))
        .withColumn("_b", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1)))
    )
    divisor = F.col("area_sqft") if base == "stored" else F.col("size_sqft")
    near = (
        probes.join(sized, ["apartment_id", "bedrooms", "_b"])
        .where(F.abs(F.col("area_sqft") - F.col("size_sqft")) / divisor < tolerance)
        .groupBy("apartment_id", "pos")
        .agg(F.min("_id").alias("size_id"))
    )
    return (
        snapshot.select("apartment_id", "pos", "name")
        .join(by_name, ["apartment_id", "name"], "left")
        .join(near, ["apartment_id", "pos"], "left")
        .select("apartment_id", "pos", F.coalesce("name_id", "size_id").alias("plan_id"),
                F.when(F.col("name_id").isNotNull(), "name").when(F.col("size_id").isNotNull(), "size").alias("matched_by"))
    )


# Step of the log-scale size buckets; ln(1.12), above the 10 % tolerance measured on either side.
F_LOG_STEP = 0.1133

# Hosts whose stored plans may carry generic names.
RENAMING_HOSTS = ("avaloncommunities.com", "eavesbyavalon.com", "avabyavalon.com")


def rename_generic(
    snapshot: DataFrame, plans: DataFrame, apartments: DataFrame, hosts=RENAMING_HOSTS, tolerance: float = 0.05
) -> DataFrame:
    """(plan_id, new_name): generically named plans take the code of a snapshot row of like size.

    Rows take, in order, the first free plan that fits.  Since all rows would rather have the lower plan id and all plans the earlier
    row, that is the one pairing in which no row and plan would rather have each other: a row and a plan that are each other's first choice
    pair off, and the rest choose again.  Rows and plans compete within runs of sizes of one listing and bed count only; where all of a
    run fit each other, the n-th row takes the n-th plan at once.
    """
    sites = apartments.where(P.mentions_any(F.col("source_url"), hosts)).select(F.col("id").alias("apartment_id"))
    generic = F.col("name").rlike(P.GENERIC_NAME)
    stored = plans.where(F.col("is_available") & generic & (F.col("area_sqft") > 0)).select(
        "apartment_id", "bedrooms", F.col("area_sqft").alias("size"), F.col("id").cast("long").alias("ord"), F.lit(None).cast("string").alias("name"),
    )
    fresh = snapshot.where(F.col("name").isNotNull() & (F.col("name") != "") & ~generic & (F.col("size_sqft") > 0)).select(
        "apartment_id", "bedrooms", F.col("size_sqft").alias("size"), F.col("pos").cast("long").alias("ord"), "name"
    )
    rows = stored.unionByName(fresh).join(sites, "apartment_id", "left_semi")
    placed = size_runs(
        rows, ["apartment_id", "bedrooms"], "size", lambda s: F.floor(F.log(s) / 0.1), lambda before, s: (s - before) / s > tolerance / (1 - tolerance)
    )
    old, new = F.when(F.col("name").isNull(), F.col("size")), F.when(F.col("name").isNotNull(), F.col("size"))
    both = placed.groupBy("grp", "run").agg(
        F.min(old).alias("_old0"), F.max(old).alias("_old1"), F.min(new).alias("_new0"), F.max(new).alias("_new1")
    ).where("_old0 IS NOT NULL AND _new0 IS NOT NULL")
    # the farthest pairs of a run fit: the smallest plan with the largest row, the largest plan with the smallest row
    all_fit = (F.abs(F.col("_old0") - F.col("_new1")) / F.col("_old0") <= tolerance) & (F.abs(F.col("_old1") - F.col("_new0")) / F.col("_old1") <= tolerance)
    work = cut_lineage(placed.join(both.select("grp", "run", all_fit.alias("whole")), ["grp", "run"]).select("grp", "run", "size", "ord", "name", "whole"))

    ranked = work.where("whole").withColumn(
        "_no", F.row_number().over(Window.partitionBy("grp", "run", F.col("name").isNull()).orderBy("ord"))
    )
    plan_side = ranked.where(F.col("name").isNull()).select("grp", "run", "_no", F.col("ord").alias("plan_id"))
    found = ranked.where(F.col("name").isNotNull()).join(plan_side, ["grp", "run", "_no"]).select("plan_id", F.col("name").alias("new_name"))
    rest = work.where(~F.col("whole")).drop("whole")
    while not rest.isEmpty():
        pairs = cut_lineage(_first_choices(rest, tolerance))
        if pairs.isEmpty():
            break
        found = found.unionByName(pairs.select("plan_id", F.col("name").alias("new_name")))
        taken = pairs.select("grp", F.col("plan_id").alias("ord"), F.lit(True).alias("_old")).unionByName(
            pairs.select("grp", F.col("row").alias("ord"), F.lit(False).alias("_old"))
        )
        rest = cut_lineage(rest.withColumn("_old", F.col("name").isNull()).join(taken, ["grp", "ord", "_old"], "left_anti").select(*rest.columns))
    return found


def _first_choices(rest: DataFrame, tolerance: float) -> DataFrame:
    """(grp, row, name, plan_id): rows and plans that are each other's first choice.

    Only the first of each distinct size can be chosen, so sizes meet rather than rows; a size probes three buckets of a log scale.
    """
    step = -math.log(1 - tolerance) * 1.01
    bucket = F.floor(F.log("size") / step)
    at = rest.groupBy("grp", "run", "size", F.col("name").isNull().alias("old")).agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"))
    olds = at.where("old").select("grp", "run", F.col("size").alias("plan_size"), F.col("ord").alias("plan_id"), bucket.alias("_b"))
    news = at.where("NOT old").select("grp", "run", "size", F.col("ord").alias("row"), "name", bucket.alias("_b0"))
    probes = news.withColumn("_b", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1))).drop("_b0")
    fits = probes.join(olds, ["grp", "run", "_b"]).where(F.abs(F.col("plan_size") - F.col("size")) / F.col("plan_size") <= tolerance)
    of_row = fits.groupBy("grp", "row").agg(F.min("plan_id").alias("plan_id"), F.first("name").alias("name"))
    of_plan = fits.groupBy("grp", "plan_id").agg(F.min("row").alias("row"))
    return of_row.join(of_plan, ["grp", "row", "plan_id"]).select("grp", "row", "name", "plan_id")
