"""Page jobs read a page once and work out each of its texts once: what counts is how often a pattern stands in the optimized plan."""

import pytest
from pyspark.sql import functions as F

from rentscope.functions import pagetext as X
from rentscope.operators import pages as E
from rentscope.views import LEAST_TASKS, Tables


def mentions(df, pattern):
    # Longer than any plan, so that none is cut short.
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(2**31 - 1000))
    return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)


@pytest.fixture(scope="module")
def pages(spark):
    html = "<title>t</title><a href='/floorplans/a1'>A &amp; 1</a><a href=\"plans/b2/?x#y\"> B <b>2</b></a><a href='/floorplans/a1'></a>"
    rows = [(1, "https://h.example.com/x/y?q", html, None), (1, "https://h.example.com/", html, "rentcafe"), (None, "https://h.example.com/x", html, "x"),
            (2, None, html, None), (3, "https://h.example.com/x", None, None), (4, "https://h.example.com", "no links", "sightmap")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, hint string").where("coalesce(page_id, 0) >= 0")


def test_pages_are_dealt_out(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    for view in (tables.detail_pages, tables.blob_pages):
        assert view.rdd.getNumPartitions() >= LEAST_TASKS and view.count() == tables.part.count()


def test_links_once(pages):
    got = sorted((r["page_id"] or 0, r["page_url"] or "", r["pos"], r["href"], r["text"], r["url"] or "") for r in E.links(pages).collect())
    assert len(got) == 12 and got[3:5] == [
        (1, "https://h.example.com/", 0, "/floorplans/a1", "A & 1", "https://h.example.com/floorplans/a1"),
        (1, "https://h.example.com/", 1, "plans/b2/?x#y", "B 2", "https://h.example.com/plans/b2/?x#y"),
    ]
    scored = E.scored_links(pages)
    assert mentions(scored, ".*?</a") == 1 and mentions(scored, "(.*)</a$") == 1


def test_plan_links_read_pages_once(pages):
    got = sorted((r["page_id"], r["url"], r["pos"]) for r in E.plan_links(pages).collect())
    assert got == [(1, "https://h.example.com/floorplans/a1", 0), (1, "https://h.example.com/plans/b2/?x#y", 1), (1, "https://h.example.com/x/plans/b2/?x#y", 1)]
    assert mentions(E.plan_links(pages), ".*?</a") == 1


def test_detection_reads_a_link_once(pages):
    assert [r["platform"] for r in E.detect_platform(pages).orderBy("page_id", "url").collect()].count("generic_detail") == 3
    # Once for the hinted format, once for the walk.
    assert mentions(E.detect_platform(pages), "href") <= 2 * 2


def test_named_prices_read_the_text_once(spark):
    html = ("<script type=\"application/ld+json\">{\"@type\":\"LodgingBusiness\",\"containsPlace\":[{\"@type\":\"Accommodation\",\"name\":\"Ash\"},"
            "{\"@type\":\"Accommodation\",\"name\":\"Elm\"}]}</script><p>$1,500</p><p>$99</p><p>$2,000</p>")
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html + "<p>Elm $1,800</p>"), (3, "u", "")], "page_id long, url string, html string").where("page_id > 0")
    priced = E.structured_places_priced(pages)
    assert sorted((r["page_id"], r["plan_name"], r["price"]) for r in priced.collect()) == [
        (1, "Ash", 1500.0), (1, "Elm", 2000.0), (2, "Ash", None), (2, "Elm", 1800.0)]
    assert mentions(priced, "<!--") == 1 and mentions(priced, "ld\\+json") == 1


def test_nearest_beds_cut_the_text_once(pages):
    text = pages.select(F.lit("2 bed 900 sq ft 3 beds").alias("t")).where("t > ''")
    assert {r["n"] for r in text.select(X.nearest_beds(F.col("t")).alias("n")).collect()} == {2.0}
    assert mentions(E.nearest_bed_plans(pages), f"{X.SQFT_PLAIN}, 2") == 1


def test_extractor_walk_reads_each_format_once(pages):
    walk = E.extract_all(pages, hint="hint")
    # Page text: three formats of one plan and the priced places.  Links: one format.
    assert mentions(walk, "<[^>]*>, \n") == 4 and mentions(walk, "href") <= 2 and mentions(walk, "ld\\+json") <= 4
