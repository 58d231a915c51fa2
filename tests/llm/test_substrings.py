"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from __spark_entry__ import queries
from rentscope.llm import substrings


def brute(rows, width):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                covered[i : i + width] = [True] * width
            seen.add(window)
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out.append((doc_id, len(words), sum(covered), b" ".join(kept)))
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, n, r, hashlib.sha256(k).hexdigest()) for d, n, r, k in brute(rows, 20)}
    assert {tuple(r) for r in queries()["op9_substring_dedup"](spark, sf).collect()} == want
    assert sum(r[2] for r in want) > 1000


def test_random_windows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [rng.choice("ab") for _ in range(rng.randrange(0, 60))]
        rows.append((i * 3 % 151, " ".join(words)))
    got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=8).collect()
    assert sorted((r.id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == sorted(brute(rows, 8))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "few words"), (5, long), (6, long), (7, "a " * 500), (None, long)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, once string")
    got = {r.id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substrings.drop_repeats(docs).collect()}
    want = {d: (n, r, k) for d, n, r, k in brute([r for r in rows if r[0] is not None], 20)}
    want[None] = (40_000, 0, long.encode())
    assert got == want
    twice = docs.filter("doc_id = 5").unionAll(docs.filter("doc_id = 5"))
    assert [r.n_removed for r in substrings.drop_repeats(twice).collect()] == [want[5][1]] * 2
    assert substrings.drop_repeats(docs.limit(0)).count() == 0


def test_windows_of_a_batch_are_worked_out_together(monkeypatch):
    """Words of all texts of a batch are hashed in one call; windows stay inside their texts, in sliced batches too, and ties go to the first place."""
    rng = random.Random(3)
    texts = ["cut off", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(30)), None, "", "a b " * 30]
    ids = [None if i == 5 else 7 * i for i in range(len(texts))]
    rows = pa.record_batch({"text": pa.array(texts), "id": pa.array(ids, pa.int64())}).slice(1)
    calls, real = [], substrings._hashed
    monkeypatch.setattr(substrings, "_hashed", lambda words: calls.append(len(words)) or real(words))
    found = substrings.Windows(rows, 8, 8)
    assert calls == [sum(len((t or "").split()) for t in texts[1:])]
    owner, start = found.by_text(found.start)
    assert list(zip(owner.tolist(), start.tolist(), strict=True)) == [
        (d, i) for d, t in zip(ids[1:], texts[1:], strict=True) if d is not None for i in range(len((t or "").split()) - 7)
    ]
    words = found.words.to_pylist()
    keys = list(zip(*(k.tolist() for k in found.keys()), strict=True))
    assert len(set(keys)) == len({tuple(words[s : s + 8]) for s in found.start.tolist()})
    for size in (1, 5, 7, 16):
        values = np.array([rng.randrange(4) for _ in range(50)], np.uint64)
        want = [i + int(values[i : i + size].argmin()) for i in range(51 - size)]
        assert substrings._lowest(values, size).tolist() == want
