"""Language identification: parsing against brute force, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from __spark_entry__ import queries
from rentscope.llm import langid


def brute_phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_parse_against_search():
    rng = random.Random(2)
    samples = {name: ["".join(rng.choice(letters) for _ in range(300)) for _ in range(2)] for name, letters in (("x", "abcd "), ("y", "cdef "))}
    languages, starts, steps = langid.parser(samples)
    texts = ["".join(rng.choice("abcdefz ") for _ in range(rng.randrange(1, 250))) for _ in range(60)]
    made = [langid.symbols(t) for t in texts]
    assert all(len(m) <= langid.CHUNK for m in made)
    got = langid.phrases(made, starts, steps)
    known = {n: "".join(map(chr, np.concatenate([[0], *(langid.symbols(t) for t in samples[n])]))) for n in languages}
    for m, row in zip(made, got, strict=True):
        if len(m):
            assert row.tolist() == [brute_phrases("".join(map(chr, m)), known[n]) for n in languages]


def test_query_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op10_language_id"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "12 ## !", "en", ""), (4, "the cat and the dog " * 5000, "en", ""), (5, "le chat et la souris", "fr", ""),
            (5, "le chat et la souris", "fr", ""), (None, "the dog and the cat", "en", ""), (8, "日本語 漢字", None, "")]
    docs = spark.createDataFrame(rows, schema)
    learned = langid.samples(docs)
    assert set(learned) == {"en", "fr"}
    got = langid.predict(docs, learned, ["doc_id", "score"]).collect()
    assert len(got) == len(rows) and all(isinstance(r.score, float) for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[k] for k in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "en", "fr", "en"]
    assert by_id[8] in ("en", "fr")
    assert langid.accepted(langid.predict(docs, learned, ["doc_id"])).count() == 5
    assert langid.samples(docs.limit(0)) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), learned, ["doc_id"]).count() == 0


def test_strange_texts_are_rejected(spark):
    """Keyboard junk, encoded data and other scripts go, clean documents of any length stay; the decision agrees with a plain search."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.samples(docs.filter(~langid.held_out(docs)))
    rng = random.Random(5)
    junk = ["".join(rng.choice("asdfghjklqwertyuiopzxcvbnm ") for _ in range(n)) for n in (60, 200, 1000, 5000)]
    junk += ["Россия великая страна и мы все любим ее очень сильно каждый день", "日本語の文章はとても長いです漢字とひらがな",
             "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(400))]
    clean = [r.text for r in docs.filter(langid.held_out(docs)).select("text").collect()]
    texts = junk + clean + ["Zyx.", "ok", None, "", "12 %%"]
    table = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id int, text string, lang_pred string, score double")
    got = langid.in_known_language(table, learned).collect()
    assert all(r.text == texts[r.doc_id] and r.lang_pred == "x" and r.score == 0.5 for r in got)
    ids = {r.doc_id for r in got}
    assert ids == {i for i in range(len(junk), len(texts) - 3) if any(map(str.isalpha, texts[i]))}

    rates = langid.usual_rates(learned)
    known = {n: "".join(map(chr, np.concatenate([[0], *(langid.symbols(t) for t in learned[n])]))) for n in learned}
    for i in [*range(len(junk)), *range(len(junk), len(junk) + 25)]:
        made = "".join(map(chr, langid.symbols(texts[i])))[:2560]
        if len(made) < 2560:
            pieces = [made[at : at + langid.CHUNK] for at in range(0, len(made), langid.CHUNK)]
            fits = any(sum(brute_phrases(p, known[n]) for p in pieces) <= 2 * rates[n] * len(made) + 3 for n in known)
            assert fits == (i in ids)

    nothing = langid.in_known_language(table, {})
    assert nothing.count() == sum(any(map(str.isalpha, t or "")) for t in texts)
    assert langid.in_known_language(table.limit(0), learned).count() == 0
    assert langid.in_known_language(table, {"en": [clean[0][:90]]}).count() == nothing.count()
