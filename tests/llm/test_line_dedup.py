"""Line dedup against brute force; the query's SQL is compared in test_queries."""

import random

from rentscope.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, least):
    """From every line the longest run that starts at an earlier place too goes, if it holds ``least`` characters."""
    filled, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        filled[doc_id] = [(i, x.strip(BLANKS)) for i, x in enumerate((text or "").split("\n")) if x.strip(BLANKS)]
    starts = {}  # earlier places by their first line
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        mine, gone, reach = [x for _, x in filled[doc_id]], set(), {}  # how far a match goes on, by the distance of the places
        for k, first in enumerate(mine):
            longest = 0
            for other, j in starts.get(first, ()):
                theirs, m = filled[other], max(0, reach.get((other, j - k), 0) - k)
                while k + m < len(mine) and j + m < len(theirs) and theirs[j + m][1] == mine[k + m]:
                    m += 1
                reach[other, j - k], longest = k + m, max(longest, m)
            if sum(map(len, mine[k : k + longest])) >= least:
                gone.update(i for i, _ in filled[doc_id][k : k + longest])
            starts.setdefault(first, []).append((doc_id, k))
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append((doc_id, kept, sorted(gone)))
    return out


def test_random_lines(spark):
    rng = random.Random(6)
    for alphabet, least in ((["a", "b", "", " "], 5), (["a", "bb", "ccc", "dddd"], 16), (["xy", "long line of text", " xy"], 7)):
        rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for i in range(40)]
        got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=least).collect()
        assert sorted((r.doc_id, r.text, list(r.removed_lines)) for r in got) == sorted(brute(rows, least))


def test_odd_rows(spark):
    long = "\n".join(f"this is line number {i % 3000}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \n\n"), (4, "one line of some length"), (5, "one line of some length\nshort"), (6, long), (6, long), (7, long + "\nan end of its own")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, row string, id string, removed_lines int")
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "row", "id", "removed_lines"]
    out = [(r.doc_id, r.text, list(r.removed_lines)) for r in got.collect()]
    want = brute([r for i, r in enumerate(rows) if i != 6], 16)
    assert sorted(out, key=lambda r: r[0]) == sorted([*want, want[5]], key=lambda r: r[0])
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "one line of some length"), (1, "one line of some length")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(null_id).collect()} == {None: "one line of some length", 1: ""}


def test_whole_runs_go(spark):
    foot = "All rights reserved by the owner\nShare\nPrint"
    rows = [(1, f"one\n{foot}\nfirst"), (2, f"two\n{foot}\nsecond"), (3, f"three\n{foot}"), (4, "Share\nPrint"), (5, "a\nb\n" * 30 + "c"), (6, "a\nb\n" * 9)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, list(r.removed_lines)) for r in got) == sorted(brute(rows, 16))
    assert {r.doc_id: r.text for r in got if r.doc_id in (2, 3, 4)} == {2: "two\nsecond", 3: "three", 4: "Share\nPrint"}
