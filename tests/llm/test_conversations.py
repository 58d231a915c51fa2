"""Conversation repair against a search over all edits that keeps whole audits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from __spark_entry__ import queries
from rentscope.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, c string, t int, digest string, copies int"
BLANK, STEP = re.compile(r"[\x20\x09-\x0D]*"), {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GOES = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's damaged rows, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        """(cost, audit, lines as links) of the least repair of rows i.. from a state."""
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", None))
        if inserted < 3:
            role, to = GOES[state]
            c, a, rest = best(i, to, inserted + 1)
            found.append((c + 2, "I" + a, (role + ":", rest)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, rest = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, rest))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                if (to := STEP.get(role[:1], {}).get(state)) is not None:
                    c, a, rest = best(i + 1, to, 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", rest)))
                new, to = GOES[state]
                c, a, rest = best(i + 1, to, 0)
                found.append((c + extra + 2, "R" + a, (f"{new}:{text}", rest)))
        return min(found, key=lambda f: f[:2], default=(1 << 40, "", None))

    for i in reversed(range(len(rows))):
        for s in range(4):
            best(i, s, 0)
    cost, audit, link = best(0, 0, 0)
    lines = []
    while link is not None:
        lines.append(link[0])
        link = link[1]
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    names = {r[0] for r in rows}
    return sorted(((n, *repair(damage([r for r in rows if r[0] == n]))) for n in names), key=repr)


def made(seed, n=160, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "users"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t\x0b", None, "Öl?\n", " ", f"text {turn}."])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.randint(1, 2), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1, "y", 9) for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries()["op11_conversation_repair"](spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("batch", [10_000, 3, 1])
def test_all_edits(spark, tmp_path, batch):
    """Batches of a few rows cut nearly every conversation into several segments."""
    rows = made(batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert run(spark, tmp_path, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_and_hot(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"line {t}" + rng.choice([".", "", "!"])) for t in range(700)]
    rows += [(2, 5, "user", "the same.")] * 900 + [(3, 1, "user", "word " * 60_000 + "."), (3, 2, "assistant", "Fine.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 90)
    try:
        assert run(spark, tmp_path, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_ranks_follow_the_least_word():
    """Random acyclic automata: the doubled pointers spell the least word of each node."""
    rng = np.random.default_rng(2)
    n = 200
    letters, targets = np.full((n, 4), conversations.BOUND), np.zeros((n, 4), np.int64)
    for i in range(n - 1):
        for a in rng.choice(4, rng.integers(1, 4), replace=False):
            letters[i, a], targets[i, a] = a + 1, rng.integers(i + 1, min(n, i + 9))
    words = [()] * n
    for i in reversed(range(n - 1)):
        words[i] = min((int(letters[i, a]), *words[targets[i, a]]) for a in range(4) if letters[i, a] < conversations.BOUND)
    letter, _, pointers = conversations.ranked(letters, targets)
    for i in range(n):
        spelt = []
        for t in range(len(words[i])):
            at = i
            for k, p in enumerate(pointers):
                at = p[at] if t >> k & 1 else at
            spelt.append(int(letter[at]))
        assert tuple(spelt) == words[i]


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries()["op11_conversation_repair"](spark, sf_dir).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows)
