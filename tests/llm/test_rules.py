"""Text statistics against brute force; learned lists on held-out labels."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from __spark_entry__ import queries
from rentscope.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries()["op5_quality_rules"](spark, sf).collect()}
    assert {d: tuple(r[c] for c in COUNTS) for d, r in rows.items()} == want
    assert all(r.base_failed == (r.n_words < 50 or r.n_repeat_words * 100 > 50 * r.n_words) for r in rows.values())
    assert not any(r.kept and (r.base_failed or r.rule is not None) for r in rows.values())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    tried = [(r.quality, rows[r.doc_id].kept) for r in labels if not rows[r.doc_id].base_failed]
    assert sum((q == 1) == kept for q, kept in tried) > 0.95 * len(tried)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    counts = rules.statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.learn(rules.labelled(counts, labels.filter("doc_id % 4 <> 0")))
    rest = counts.join(labels.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "id"), "id")
    rest = rest.select("quality", *rules.shares(rest)).withColumn("rule", rules.verdict(learned))
    table = {(r.quality, r.good): r["count"] for r in rest.groupBy("quality", F.col("rule").isNull().alias("good")).count().collect()}
    assert table.get((1, False), 0) <= 0.01 * table[1, True]
    assert table.get((0, True), 0) <= 0.1 * table[0, False]


def test_odd_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \n \n", "a", "a b", "a a a a", "x y z\nx y z\n\nx y z", "#*$%&|<> <>", "é ü 漢字 😀", "w " * 20_000, " ".join(str(rng.randrange(30)) for _ in range(9000))]
    docs = spark.createDataFrame([(i, t, "a", 1.5) for i, t in enumerate([*texts, "again", "again"])], "doc_id long, text string, id string, n_words double")
    got = {r.id: tuple(r[c] for c in COUNTS) for r in rules.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate([*texts, "again", "again"])}
    labels = spark.createDataFrame([(3, 0, 0), (3, 0, 0), (4, None, 1), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    out = rules.judged(docs, labels)
    assert out.count() == docs.count() and out.filter("kept").count() == 0
    assert rules.judged(docs.limit(0), labels.limit(0)).count() == 0
