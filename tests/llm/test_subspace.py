"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from __spark_entry__ import queries
from rentscope.llm import subspace

SCHEMA = "vec_id long, embedding array<float>, label int, links long, v string, k int"


def brute(rows, least=0.95):
    """(id, n_links, component) by all pairs, in double precision."""
    fine = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    names = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return sorted(((rows[i][0], links[i], names[root(i)]) for i in range(len(rows))), key=repr)


def planted(n=260, dims=64, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dims))
    rows = [rng.standard_normal(dims) for _ in range(n // 2)]
    rows += [base[i % 12] * rng.uniform(0.1, 9) + rng.standard_normal(dims) * rng.uniform(0, 0.4) for i in range(n // 2)]
    rows += [base[0]] * 30  # copies
    return [[float(np.float32(x)) for x in v] for v in rows]


def found(df, **kwargs):
    return sorted((tuple(r) for r in subspace.near_vectors(df, **kwargs).collect()), key=repr)


@pytest.mark.parametrize(("tile", "least", "dims"), [(1 << 16, 0.95, 64), (40, 0.95, 64), (60, 0.8, 21), (50, 0.99, 5), (60, 0.5, 3)])
def test_all_pairs(spark, tile, least, dims):
    rows = [(i * 37 % 1000, v) for i, v in enumerate(planted(dims=dims))]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)
    assert found(df, tile=tile, least=least) == brute(rows, least)


def test_odd_vectors(spark, tmp_path):
    v = [0.5, 0.25, -1.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 0.0, 1.0])]
    rows += [(9, v), (8, v), (8, v), (None, [0.5, 0.25, -1.01]), (None, [-3.0, 9.0, 1.0]), (None, [-3.0, 9.0, 1.0]), (7, [0.5, 0.25]), (10, [1e-30, 2e-30, 0.0]), (11, [1e30, 2e30, 1e25]), (12, [-0.5, -0.25, 1.0])]
    spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries()["op13_embedding_near_dedup"](spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_doubles(spark):
    rows = [(i, [float(np.cos(i / 40)), float(np.sin(i / 40))]) for i in range(120)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16) == brute(rows)


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = queries()["op13_embedding_near_dedup"](spark, sf_dir).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == brute(rows)
