"""Decontamination against brute force over all windows."""

import random
from collections import Counter

from __spark_entry__ import queries
from rentscope.llm import decontaminate
from tests.llm.test_simhash import WORD, lower


def shingles(words, width):
    width = min(width, 5)
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else Counter()


def brute(docs, items):
    """Best similarity of all item-sized windows, where 0.8 or more."""
    found = {}
    targets = [(i, w, shingles(w, len(w))) for i, t in items if (w := WORD.findall(lower(t or "")))]
    for doc_id, text in docs:
        words = WORD.findall(lower(text or ""))
        have = {n: set(shingles(words, n)) for n in range(1, 6)}
        for item_id, target, want in targets:
            if not have[min(5, len(target))] & set(want):
                continue
            for s in range(max(1, len(words) - len(target) + 1)):
                own = shingles(words[s : s + len(target)], len(target))
                similarity = sum((own & want).values()) / sum((own | want).values())
                if similarity >= 0.8:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), similarity)
    return found


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in queries()["op8_decontaminate"](spark, sf).collect()}
    assert got == brute(docs, items) and len(got) > 5


def test_edited_passages_and_joined_seeds(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 12, 40, 60])))) for i in range(30)]
    items += [(100, None), (101, " "), (102, items[0][1]), (103, "a a a a a a a a")]
    docs = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        _, passage = items[i % 30]
        passage = passage.upper().split() if i % 3 == 0 else passage.split()
        if i % 4 == 1 and len(passage) > 30:
            passage[rng.randrange(len(passage))] = "changed"
        if i % 4 == 2 and len(passage) > 30:
            passage.insert(3, "extra")
        at = rng.randrange(len(words) + 1)
        docs.append((i, " ".join(words[:at] + passage + words[at:])))
    docs += [(200, None), (201, ""), (202, "a " * 4000), (203, docs[0][1]), (203, docs[0][1])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for bound in (decontaminate.SET_BOUND, 10):
        got = {(r.id, r.item_id): r.similarity for r in decontaminate.leaks(table, bench, set_bound=bound).collect()}
        assert got == want
    clean = decontaminate.without_leaks(table, bench)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i not in {d for d, _ in want})
    assert decontaminate.without_leaks(table, bench.limit(0)).count() == len(docs)
    assert decontaminate.leaks(table.limit(0), bench).count() == 0


def test_windows_at_other_offsets(spark):
    """Halves swapped, a rotated item, an item at either end or longer than its document: all windows are judged."""
    rng = random.Random(9)
    one, two, fill = ([f"{k}{i}" for i in range(60)] for k in "abc")
    items = [(1, " ".join(one + two)), (2, " ".join(one[:14])), (3, " ".join(fill[:9]))]
    passages = [one + two, two + one, one[3:] + two + one[:3], (one + two)[:-7], (one + two)[9:], one[:14], one[1:14], fill[:8], fill[1:9]]
    docs = []
    for i, passage in enumerate(p for p in passages for _ in range(4)):
        noise = [[f"n{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 30]))] for _ in range(2)]
        docs.append((i, " ".join(noise[0] + passage + noise[1])))
    docs.append((100, " ".join(two + one + fill + one + two)))
    got = {(r.id, r.item_id): r.similarity for r in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and {d for d, i in want if i == 1} >= {*range(8), 100}
