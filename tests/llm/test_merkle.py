"""Merkle manifest against a direct construction."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from rentscope.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, tree string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root and, for each node, its siblings by level: (those to the left, those to the right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            first = at[i] // 3 * 3
            p.append((nodes[first : at[i]], nodes[at[i] + 1 : first + 3]))
            at[i] //= 3
        nodes = [H("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for name in names:
        part = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        parts.append((part, *climb([leaf_of(r, r[1]) for r in part])))
    root, above = climb([subroot for _, subroot, _ in parts])
    out = []
    for (part, subroot, paths), up in zip(parts, above, strict=True):
        for r, p in zip(part, paths, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf_of(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            siblings = ""
            for left, right in p + up:
                h = H("".join(left) + h + "".join(right))
                siblings += "".join(left + right)
            out.append((r[0], leaf_of(r, r[1]), subroot, root, H(siblings), h, h == root))
    return sorted(out, key=repr)


def rows_of(n, sources):
    made = [(i * 7 % (n - 1) - 3, f"tëxt {i}\n\nend" * (i % 5), "en" if i % 3 else None, sources[i * i % len(sources)], i if i % 4 else None) for i in range(n)]
    made += [(None, None, None, None, None), (None, "a\n", "x", "", 1), (5, "", None, sources[0], 2), (5, "", None, sources[0], 2), (6, "word " * 50_000 + "\n", "de", "lone", 3)]
    return [(*r, "clash", "clash", "clash") for r in made]


@pytest.mark.parametrize(("n", "sources", "levels"), [(60, ["b", None, "é", "a"], 1), (60, ["a"], 2), (90, [f"s{i}" for i in range(40)], 1), (30, ["a", "b"], 7)])
def test_manifest(spark, tmp_path, monkeypatch, n, sources, levels):
    rows = rows_of(n, sources)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda df: whole(df, levels))
    found = queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect() == []


def test_proofs_verify_and_forgeries_do_not(spark):
    rows = spark.range(500).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("_order"), merkle.group_key(F.col("id") % 7).alias("tree"),
        merkle.leaf_digest(F.col("id")).alias("leaf"), merkle.leaf_digest(F.when(F.col("id") != 13, F.col("id"))).alias("seen"),
    )
    found = merkle.manifest(rows, 2).collect()
    assert len(found) == 500 and len({r["root"] for r in found}) == 1
    assert [r["id"] for r in found if not r["verified"]] == ["13"]
    assert all(merkle.fold(r["leaf"], r["slots"], r["others"]) == r["root"] for r in found)


def test_has_sql():
    assert "op12_merkle_manifest" in oracle_sql()
