"""LM scoring: base against brute force, gradients, a proper distribution, held-out gain."""

import copy
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from rentscope.llm import lm
from rentscope.llm.words import lowered_words

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: WORD.findall((r.text or "").encode().lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    counts = Counter(t for d, w in docs.items() if not out[d] for t in [*w, None])
    total, distinct = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in queries()["op4_lm_scores"](spark, sf).collect()}
    assert set(rows) == set(docs)
    for d, w in docs.items():
        r = rows[d]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in [*w, None])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(w) + 1, sum(counts[t] > 0 for t in [*w, None]), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    """On 25 MB, over texts without a new word: the base gives every new word half a count, however many there may be."""
    rows = queries()["op4_lm_scores"](spark, "/root/testdata/sf0.1").filter("held_out").collect()
    print("all held out:", sum(r.score for r in rows), sum(r.base_score for r in rows))
    rows = [r for r in rows if r.n_known == r.n_tokens]
    ours, base = (sum(getattr(r, c) for r in rows) for c in ("score", "base_score"))
    print("known words only:", ours, base, len(rows))
    assert ours > base


@pytest.fixture(scope="module")
def small():
    sub = lm.Subwords(PATH, P.PATTERN)
    words = [b"the", b"bridge", b"is", b"red", b"and", b"blue"]
    rng = np.random.default_rng(1)
    texts = [[words[i] for i in rng.integers(0, 6, rng.integers(0, 60))] for _ in range(200)]
    counts, pairs = np.zeros(sub.size), Counter()
    for w in (w for t in texts for w in t):
        last = -1
        for i in sub.word(w):
            counts[i] += 1
            pairs[last, i] += 1
            last = i
        pairs[last, -1] += 1

    def by_class(m):
        cells = Counter()
        for (a, b), n in pairs.items():
            cells[m.row_of[a] if a >= 0 else -1, m.class_of[b] if b >= 0 else -1] += n
        return np.array([(*k, v) for k, v in cells.items()])

    model = lm._tables(counts, by_class, 200, sum(map(len, texts)), sub)
    return sub, lm.texts_as_subwords(model, sub, texts), model


def chances(model, ids, end):
    return lm.log_probabilities(model, ids, end, np.ones(sum(map(len, ids)), bool))[0]


def test_training_helps(small):
    sub, ids, model = small
    assert np.exp(model.share).sum() == pytest.approx(len(np.unique(model.class_of)))
    before = chances(model, ids, sub.end).mean()
    lm.train(model, ids, sub.end, epochs=3)
    assert chances(model, ids, sub.end).mean() > before


def test_windows_are_causal_and_score_once(small):
    sub, _, model = small
    text = lm.texts_as_subwords(model, sub, [[b"the", b"bridge", b"is", b"red"] * 20])[0]
    whole = chances(model, [text], sub.end)
    assert len(whole) == len(text)
    np.testing.assert_allclose(whole[:37], chances(model, [text[:37]], sub.end), rtol=1e-4, atol=1e-5)
    changed = text.copy()
    changed[50:] = text[0]
    np.testing.assert_allclose(chances(model, [changed], sub.end)[:50], whole[:50], rtol=1e-4, atol=1e-5)


def test_a_word_is_spelt_once_a_batch(small, monkeypatch):
    sub, _, model = small
    asked = []
    real = lm.Subwords.word
    monkeypatch.setattr(lm.Subwords, "word", lambda self, word: asked.append(word) or real(self, word))
    model = replace(model, top={}, top_ids=[], top_count=np.zeros(0), top_share=np.zeros(0))
    logs, places, _, _ = lm.word_scores(model, sub, [[b"zebra", b"the"] * 50, [], [b"zebra"] * 7])
    assert sorted(asked) == [b"the", b"zebra"] and len(logs) == 110 and (places == -1).all()
    flat = lm.texts_as_subwords(model, sub, [[b"the", b"zebra"], [], [b"the"]])
    assert [f.tolist() for f in flat] == [[*real(sub, b"the"), *real(sub, b"zebra"), sub.end], [sub.end], [*real(sub, b"the"), sub.end]]


def test_lowered_words_of_odd_texts():
    texts = [" a  b\tc\n", "", "   ", "A\x1cB\x85  x　 Ä ÉZ\x0b\x0cq\r", None, "x", "\x00 Y\x00z", "İ Σ"]
    found, n = lowered_words(pa.array(["cut off", *texts]).slice(1))
    want = [t.encode().lower().split() if t else [] for t in texts]
    assert found.to_pylist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_first_words_share_out_one(small):
    """What can come first in a text: the chances of all classes that start words sum to one, and so do the words of each."""
    sub, _, model = small
    lm.with_top(model, sub, {b"the": 5, b"bridge": 3, b"is": 2})
    assert model.words.sum() == pytest.approx(sum(n for n in model.words)) and (0 < model.old).all() and (model.old < 1).all()
    total = 0.0
    for w in (b"the", b"bridge", b"is", b"red", b"and", b"blue", b"zebra"):
        log, place, _, of_one = (x[0] for x in lm.word_scores(model, sub, [[w]]))
        total += math.exp(log) if place >= 0 else math.exp(log + of_one)
    assert 0 < total <= 1 + 1e-6


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Some words, here."), (4, "Some words, here."), (None, "no id"), (7, "long text " * 30_000), (8, "\xa0 x　y 漢字 \x1c")]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, id string, score double")
    out = lm.score(docs, PATH, P.PATTERN).collect()
    assert len(out) == len(rows) and all(r.score < 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert sorted(r.n_tokens for r in out) == sorted(len(WORD.findall((t or "").encode())) + 1 for _, t in rows)
    assert lm.score(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_borders_and_weights_cover_all_texts(spark, small):
    sub, _, model = small
    rng = np.random.default_rng(8)
    texts = [[w.decode() for w in rng.choice([b"the", b"bridge", b"is", b"red", b"zebra"], rng.integers(0, 9))] for _ in range(90)]
    docs = spark.createDataFrame([(" ".join(t) or None,) for t in texts], "text string").repartition(7)
    want = np.zeros(model.start.shape)
    for t in texts:
        ids = [sub.word(w.encode()) for w in t] + [[sub.end]]
        for a, b in zip([[sub.end], *ids], ids):
            want[model.row_of[a[-1]], model.class_of[b[0]]] += 1
    np.testing.assert_array_equal(lm._borders(docs, model, PATH, P.PATTERN), want)
    one, two = (copy.deepcopy(model) for _ in range(2))
    docs = docs.selectExpr("text", "xxhash64(text) AS place")
    lm.fit(docs, one, PATH, P.PATTERN, groups=3)
    lm.fit(docs.filter("text NOT LIKE '%zebra%'"), two, PATH, P.PATTERN, groups=3)
    row = model.row_of[sub.word(b"zebra")[0]]
    assert row == 0 or (one.query[row] != model.query[row]).any()
    assert any((getattr(one, k) != getattr(two, k)).any() for k in lm.WEIGHTS)
    lm.fit(docs.limit(0), two, PATH, P.PATTERN)


def test_long_unseen_words_cost_what_they_spell(spark):
    """A word of random letters, which nothing has shown: each further letter makes the text less likely."""
    rng = np.random.default_rng(4)
    taught = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))
    lengths = [50, 400, 2_000, 20_000]
    rows = [(i, "the bridge over the river is red and the river is wide") for i in taught]
    rows += [(i, f"the bridge is red {letters[:n]}") for i, n in zip(held, lengths, strict=True)]
    out = {r.id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN).collect()}
    scores = [out[i] for i in held]
    assert all(math.isfinite(s) for s in scores)
    assert all(later < earlier - (m - n) / 10 for (earlier, later), (n, m) in zip(zip(scores, scores[1:], strict=False), zip(lengths, lengths[1:], strict=False), strict=False))


def test_weights_depend_on_the_rows_alone(spark, small):
    _, _, model = small
    rng = np.random.default_rng(9)
    texts = [" ".join(w.decode() for w in rng.choice([b"the", b"bridge", b"is", b"red"], 20)) for _ in range(300)]
    docs = spark.createDataFrame([(t, i * 7919) for i, t in enumerate(texts)], "text string, place long")
    one, two = (copy.deepcopy(model) for _ in range(2))
    lm.fit(docs.repartition(7), one, PATH, P.PATTERN, groups=130)  # more than one step of the tree of sums
    lm.fit(docs.repartition(2).orderBy(F.desc("place")), two, PATH, P.PATTERN, groups=130)
    for k in lm.WEIGHTS:
        np.testing.assert_array_equal(getattr(one, k), getattr(two, k))
    assert (one.out != model.out).any()


def test_the_table_of_words_makes_no_difference(spark, monkeypatch):
    rows = [(i, "the bridge over the river is red and the river is wide" + " blue" * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for bound in (100_000, 3):
        monkeypatch.setattr(lm, "TOP_WORDS", bound)
        scores.append({r.id: r.score for r in lm.score(docs, PATH, P.PATTERN).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_texts_are_spelt_once_for_all_steps(spark, small):
    """Subwords, places and other words as kept between the steps; weights and borders from them are those of the texts."""
    sub, _, model = small
    model = copy.deepcopy(model)
    lm.with_top(model, sub, {b"the": 5, b"bridge": 3})
    texts = ["The zebra\tis the BRIDGE ", None, "", " \n", "\xa0 漢字 the\x1c", "red " * 40]
    docs = spark.createDataFrame([(t, i * 7919) for i, t in enumerate(texts)], "text string, place long").repartition(3)
    cut = lm.spelt(docs, model, PATH, P.PATTERN)
    for r in cut.collect():
        text = (texts[r.place // 7919] or "").encode()
        words = [w.lower() for w in WORD.findall(text)]
        flat = np.frombuffer(r.ids, sub.stored)
        assert flat.tolist() == [i for w in words for i in sub.word(w)] + [sub.end] and r.bytes == len(text)
        assert np.nonzero(sub.starts[flat])[0].tolist() == np.cumsum([0, *(len(sub.word(w)) for w in words)]).tolist()
        assert np.frombuffer(r.places, "<i4").tolist() == [model.top.get(w, -1) for w in words]
        assert [bytes(w) for w in r.rare] == [w for w in words if w not in model.top]
    np.testing.assert_array_equal(lm._borders(cut, model, PATH, P.PATTERN), lm._borders(docs, model, PATH, P.PATTERN))
    one, two = (copy.deepcopy(model) for _ in range(2))
    lm.fit(cut, one, PATH, P.PATTERN, groups=3)
    lm.fit(docs, two, PATH, P.PATTERN, groups=3)
    for k in lm.WEIGHTS:
        np.testing.assert_array_equal(getattr(one, k), getattr(two, k))


def test_many_words_are_spelt_in_one_call(small, monkeypatch):
    sub, _, _ = small
    words = [b"the", b"it's", b"'s", b"x'll,", b"--", b"12345", b"a1b2!?", b"\x1cq\x00", b"<|endoftext|>", "né".encode(), "　x\xa0".encode(), b"...''", b"(don't)", b"Q" * 300] * 3
    rng = np.random.default_rng(6)
    words += [bytes(b for b in rng.integers(0, 127, 9).tolist() if b not in b" \t\n\x0b\x0c\r") + b"." for _ in range(2000)]
    want = [sub.packed(w) for w in words]
    asked, real = [], lm.Subwords.word
    monkeypatch.setattr(lm.Subwords, "word", lambda self, word: asked.append(word) or real(self, word))
    assert sub.all_packed(words) == want and all(not w.isascii() for w in asked) and len(asked) == 6
    assert sub.all_packed(words[:3]) == want[:3] and sub.all_packed([]) == []


def test_words_that_the_corpus_surely_has_are_not_spelt_out(small, monkeypatch):
    sub, _, model = small
    model = replace(model, top={}, top_ids=[], top_count=np.zeros(0), top_share=np.zeros(0))
    texts = [[b"zxqvkzebra", b"the"], [], [b"zxqvkzebra"]]
    flat, sizes, places, totals = lm._spelt(model, sub, texts)
    first = np.cumsum(sizes) - sizes
    whole = lm._scored(model, sub, flat, first, places, totals)
    asked, real = [], lm.log_probabilities
    monkeypatch.setattr(lm, "log_probabilities", lambda m, ids, end, need: asked.append(int(need.sum())) or real(m, ids, end, need))
    less = lm._scored(model, sub, flat, first, places, totals, np.array([False] * 4 + [True, True]))
    assert asked == [len(first) + sizes[4] - 1] and sizes[4] > 1
    for a, b in zip(whole[:2], less[:2], strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-6)
    assert less[2][0] == less[2][1] == 0 and less[2][4] == pytest.approx(whole[2][4], rel=1e-6)


def test_sums_of_rows():
    rng = np.random.default_rng(5)
    rows, values = rng.integers(0, 40, (8, 30)), rng.normal(size=(8, 30, 6)).astype(np.float32)
    met, sums = lm._sum_rows(rows, values)
    assert met.tolist() == sorted(set(rows.ravel().tolist())) and sums.dtype == np.float32
    np.testing.assert_allclose(sums, [values[rows == r].sum(axis=0) for r in met], rtol=1e-4, atol=1e-5)
