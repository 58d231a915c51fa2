"""SimHash operator against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from __spark_entry__ import queries
from rentscope.llm import simhash
from rentscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []


def brute_fingerprint(text, width=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 24])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    queries_ = base[:40].copy()
    for i in range(40):
        for b in rng.integers(0, 64, i % 9):
            queries_[i] ^= np.uint64(1) << np.uint64(b)
    q, lane = simhash.within(queries_, simhash.planes_of(base), len(base), radius)
    want = {(i, j) for i in range(40) for j in range(130) if int(queries_[i] ^ base[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), lane.tolist(), strict=True)) == want


def test_blocks_cover_the_radius():
    rng, keys = random.Random(1), simhash.blocks(3)
    for _ in range(300):
        flipped = set(rng.sample(range(64), 3))
        assert any(not flipped & set(bits) for bits in keys)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 30)]
    edges = spark.createDataFrame(path + star + path[:5] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}}
    assert components(edges.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = {d: brute_fingerprint(t) for d, t in docs}
    linked = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = {(d, f"{fps[d]:016x}", c) for d, c in brute_components(fps, linked).items()}
    assert {tuple(r) for r in queries()["op1_simhash_near_dedup"](spark, sf).collect()} == want


ODD = "doc_id long, text string, fp string, id string, component string"


def test_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None, "x", "y", "z"), (2, "", None, None, None), (3, " \n", "", "", ""), (None, "a b c d", "", "", ""), (5, "A b\tC d", "", "", ""),
            (6, "a b c d", "", "", ""), (6, "a b c d", "", "", ""), (8, long, "", "", ""), (9, long + " tail", "", "", "")]
    out = simhash.near_groups(spark.createDataFrame(rows, ODD)).collect()
    assert len(out) == len(rows)
    assert sorted((r.id, r.component) for r in out if r.id is not None) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (6, 5), (8, 8), (9, 8)]
    assert [r.component for r in out if r.id is None] == [None]
    near = simhash.similar_groups(spark.createDataFrame(rows, ODD)).collect()
    assert sorted((r.id, r.component) for r in near if r.id is not None) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (6, 5), (8, 8), (9, 8)]
    assert simhash.near_groups(spark.createDataFrame([], ODD)).count() == 0
    assert simhash.similar_groups(spark.createDataFrame([], ODD)).count() == 0


def test_tiles_give_the_same_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{rng.randrange(9000)}" for _ in range(100))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, cut = simhash.similar_groups(docs), simhash.similar_groups(docs, most=3000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    linked = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert dict(map(tuple, whole.collect())) == brute_components(sets, linked)
    small = simhash.near_groups(docs, radius=6, most=16)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, simhash.near_groups(docs, radius=6).collect()))


def test_a_repeated_phrase_does_not_part_similar_sets(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " spam" * 300)], "doc_id long, text string")
    assert {r.id: r.component for r in simhash.similar_groups(docs).collect()} == {1: 1, 2: 1}


def test_key_rows_are_not_broadcast(spark, monkeypatch):
    tiles, edges = [], simhash._edges
    monkeypatch.setattr(simhash, "_edges", lambda rows, *a: tiles.append(rows) or edges(rows, *a))
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(200)) + " tail" * (i % 2)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 200
    assert tiles[0].collect()
    plan = tiles[0]._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan
    assert "Broadcast" not in plan
