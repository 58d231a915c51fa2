"""Merge replay and the token store against the public libraries."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import queries
from rentscope.llm import bpe, token_store

SF = "/root/testdata/sf0.01"
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a  b   c \n\n d"), (5, "naïve café x　y ́z"), (6, "it's we'll I'D 'twas"),
    (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30), (8, "😀😀 漢字かな 12345 ###$$$ <|endoftext|>"), (9, "x" * 5000 + " end "), (9, "x" * 5000 + " end "), (None, "no id"),
    (11, " lead"), (12, "trail "), (13, "tab\t next\n line \r\n"), (14, "\x1c\x1d\x85"), (15, "ΣΑΣ ΣΑΣ. Ǆ İ"),
]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_of_random_pieces(tik):
    rng = random.Random(3)
    alphabets = ["ab", "ation", "the réèau", "_-=*", "一二三", "0123456789"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 60))) for _ in range(3000)] + [t for _, t in ODD]
    got = bpe.Encoder(MULTI, P.PATTERN).encode([None if t is None else t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (tik.encode_ordinary(text) if text else []), text


def test_lower_rank_made_by_a_merge_comes_first(tmp_path):
    """With "ab" < "abc" < "bc" a merge of b+c makes a pair of a lower rank than its own."""
    tokens = [bytes([b]) for b in range(256)] + [b"xa", b"abc", b"bc", b"bcb", b"cb"]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    enc = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    got = bpe.Encoder(str(path), r"\S+").encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]


def test_replay_holds_little_for_a_symbol():
    rng = np.random.default_rng(5)
    pieces = [bytes(row) for row in rng.integers(97, 123, (40_000, 10), np.uint8)]
    merges = bpe.merges(MULTI)
    tracemalloc.start()
    symbols, ends = merges._merge_all(pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ends[-1] == len(symbols) and peak < 60 * sum(map(len, pieces))


def test_pipeline_tokens_take_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string")
    out = corpus_pipeline.tokens(spark, docs, SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in out.collect()) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)


def digests(tik, text):
    ids = np.array(tik.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query(spark, tik):
    want = {(r.doc_id, *digests(tik, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {tuple(r) for r in queries()["op7_byte_bpe"](spark, SF).collect()} == want


def test_bpe_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, id string, ids string")
    out = bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI).collect()
    assert sorted(((r.id or 0), bytes(r.bytes)) for r in out) == sorted((i or 0, (t or "").encode()) for i, t in ODD)
    assert bpe.encode(docs.limit(0), MULTI, P.PATTERN).count() == 0


def reference_rows(rows):
    tok = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def by_place(rows):
    return sorted(rows, key=lambda r: r[1])


def test_store_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_place(map(tuple, queries()["op6_token_store"](spark, SF).collect())) == reference_rows(rows)


def test_store_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 50)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, id string, part string")
    token_store.write(docs, str(tmp_path / "a"), WORDS)
    assert by_place(map(tuple, token_store.documents(token_store.read(spark, str(tmp_path / "a"))).collect())) == reference_rows(ODD)
    token_store.write(docs.limit(0), str(tmp_path / "b"), WORDS)
    assert token_store.documents(token_store.read(spark, str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_random_access(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    ends = np.unique(np.r_[rng.integers(0, n + 1, 4), n])
    segment = token_store.Segment(token_store.pack(ids, ends))
    assert segment.ids().tolist() == ids.tolist()
    for i in rng.integers(0, n, min(n, 200)):
        assert segment.token(int(i)) == ids[i]
    assert sum((segment.document(k) for k in range(len(ends))), []) == ids[: ends[-1]].tolist()


def test_strings_of_special_tokens():
    encoder, tok = token_store.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = ["hello <|endoftext|> world", "hello <|ENDOFTEXT|> World.", "a<|startoftext|>b\n\nc", "<|endoftext", "it's 12,5% <| x |>", ""]
    for _ in range(2):  # new words, then known ones
        assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert tok.encode(texts[0]).ids == [3306, 49407, 1002]
