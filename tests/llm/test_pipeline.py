"""The pipeline against a brute-force version of its stages, and the SQL of the corpus queries."""

import base64
import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from rentscope.llm.queries import QUERIES
from tests.llm import test_decontaminate, test_line_dedup
from tests.llm.test_simhash import brute_components, shingles
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def brute(docs, items):
    """(doc_id, n_tokens, ids, sha256) of documents that have a letter; all of them have a language."""
    rows = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    lines = [(d, t, gone) for d, t, gone in test_line_dedup.brute(rows, 16)]
    rows = [(d, t) for d, t, gone in lines if not gone or t.strip(" \t\n\x0b\x0c\r")]
    sets = {d: set(shingles(t, 5)) for d, t in rows}
    linked = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = brute_components(sets, linked)
    rows = [(d, t) for d, t in rows if group[d] == d]
    leaked = {d for d, _ in test_decontaminate.brute(rows, items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in rows:
        if d not in leaked:
            ids = np.array(coder.encode_ordinary(t), "<u4")
            yield d, len(ids), ids.tobytes(), hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_pipeline(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in queries()["pipeline"](spark, sf).collect()}
    assert got == set(brute(docs, items)) and len(got) > 100


def test_stages_on_odd_rows(spark):
    text = "the committee met on tuesday and talked for three hours about the new bridge over the river"
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "123 ###", "en", "s", 7), (4, text, "en", "s", 9), (5, text, "en", None, 9), (5, text, "en", None, 9),
            (None, text + " again", None, "s", 1), (8, (text + "\n") * 2000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("ids", F.lit("x"))
    for first in (docs, docs.limit(0)):
        out = first
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            assert name == "byte_bpe" or out.columns == docs.columns
        ids = sorted(out.select("doc_id").collect(), key=lambda r: (r[0] is None, r[0]))
        assert [r[0] for r in ids] == ([] if first is not docs else [4, None])


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(oracle_sql())))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), oracle_sql()[name]) is None
