"""Token ids in directly addressable codes.

A value is cut into 8-bit chunks, lowest first. Level k holds chunk k of every value that has one, and a bitmap that tells
whether the value goes on at level k + 1; the directory counts the set bits before every 512th, so one rank gives the place of the
next chunk. Any token is read by at most one byte, one bit and one rank a level, without decoding its neighbours.

A segment is one run of documents: ``DAC1``, then 32-bit little-endian counts (documents, tokens, levels), the documents' end
positions, and for each level its length, chunks, bitmap and directory. Segments are rows of a Parquet folder, in ascending document
order, so that any store that Spark writes to can hold them and a task that runs again replaces its own files.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentscope.llm.words import split_words, texts_of

MAGIC = b"DAC1"
RANK_STEP = 512
SEGMENT_TOKENS = 1 << 20
CACHED = 600_000
BATCH_BYTES = 2 << 20
WORD = np.dtype("<u4")

SEGMENT = "part int, inside long, doc_ids array<long>, n_tokens long, payload binary"


# ---- one segment ----


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A segment of token ids (unsigned 32-bit) of documents that end at ``ends``."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
        directory = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts
        levels.append(b"".join([WORD.type(len(rest)).tobytes(), rest.astype(np.uint8).tobytes(), bitmap.tobytes(), directory.astype(WORD).tobytes()]))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = np.array([len(ends), len(ids), len(levels)], WORD)
    return b"".join([MAGIC, head.tobytes(), ends.astype(WORD).tobytes(), *levels])


class Segment:
    """Reads a packed segment: any token, any document, or all."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_docs, self.n_tokens, n_levels = np.frombuffer(payload, WORD, 3, 4).tolist()
        self.ends = np.frombuffer(payload, WORD, n_docs, 16)
        self.levels, at = [], 16 + 4 * n_docs
        for _ in range(n_levels):
            n = int(np.frombuffer(payload, WORD, 1, at)[0])
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            bitmap = np.frombuffer(payload, np.uint8, -(-n // 8), at + 4 + n)
            directory = np.frombuffer(payload, WORD, -(-n // RANK_STEP), at + 4 + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += 4 + n + len(bitmap) + 4 * len(directory)

    def token(self, i: int) -> int:
        """The id at position i, without decoding others."""
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_STEP
            between = np.unpackbits(bitmap[block * RANK_STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_STEP]
            i = int(directory[block]) + int(between.sum())
        raise ValueError("a value goes on after the last level")

    def document(self, k: int) -> list[int]:
        """The ids of document k."""
        return [self.token(i) for i in range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))]

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        values, place = np.zeros(self.n_tokens, WORD), np.arange(self.n_tokens)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            values[place] |= chunks.astype(WORD) << WORD.type(8 * k)
            place = place[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return values


# ---- encoding ----


PUNCTUATION = b".,!?*$%&#;:|"
PLAIN_LETTERS = re.compile(rb"[a-z]+")
LATIN_END = "\u0250"


def _byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in this kind of vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(others)}


BYTE_ALPHABET = _byte_alphabet()


class WordEncoder:
    """Encodes texts word by word: this kind of vocabulary lowers case and drops white space, so a text's ids are those of its words.

    Punctuation at the end of a word is a run of its own to the tokenizer and is looked up apart. New words of letters that neither lower case nor
    normal form changes go straight to its merge model, spelt in the byte alphabet, which is all that is left to do for them; other new words
    go to the whole tokenizer. What is known is not encoded again.

    The tokenizer finds the strings of its special tokens in a text before it lowers case and cuts words, so a text that may hold one, in any case,
    goes to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        model, known, other = self.tokenizer.model, self.known, []
        for w in words:
            if PLAIN_LETTERS.fullmatch(w):
                known[w] = array("I", [t.id for t in model.tokenize(w.decode())]).tobytes()
            elif (text := w.decode()).isalpha() and text.lower() == text and max(text) < LATIN_END and is_normalized("NFC", text):
                known[w] = array("I", [t.id for t in model.tokenize(w.decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()
            else:
                other.append(w)
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            for w, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = array("I", found.ids).tobytes()

    def _meet(self, new: list[bytes]) -> None:
        known, split, parts = self.known, [], set()
        for w in new:
            if w[-1] in PUNCTUATION:
                s = w.rstrip(PUNCTUATION)
                # a stem that ends with a letter: no character of its own can join the punctuation that follows
                if s and s.decode()[-1].isalpha():
                    split.append((w, s, e := w[len(s) :]))
                    parts.add(s)
                    parts.add(e)
                    continue
            parts.add(w)
        self._learn([w for w in parts if w not in known])
        for w, s, e in split:
            known[w] = known[s] + known[e]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        low = [t.lower() if t else b"" for t in texts]
        special = {i for i, t in enumerate(low) if any(m in t for m in self.marks)}
        cut = [[] if i in special else split_words(t) for i, t in enumerate(low)]
        words = list(set().union(*cut))
        ids = dict(zip(words, map(self.known.get, words), strict=True))  # smaller, so quicker to look up in, than all that is known
        new = [w for w, known in ids.items() if known is None]
        self._meet(new)
        ids.update(zip(new, map(self.known.__getitem__, new), strict=True))
        out = [
            np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, WORD).tobytes() if i in special
            else b"".join(map(ids.__getitem__, found))
            for i, found in enumerate(cut)
        ]
        if len(self.known) > CACHED:  # what is frequent is in every batch
            self.known = ids
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """A Python worker's encoder: the tasks it runs one after the other share the words it has met, ``CACHED`` and a batch's at most."""
    return WordEncoder(path)


def _segments(path: str, end_id: int, text_col: str, id_col: str):
    end = WORD.type(end_id).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, inside = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, packed, total = [], [], 0

        def segment():
            ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
            payload = pack(np.frombuffer(b"".join(packed), WORD), ends)
            row = [[part], [inside], [doc_ids], [total], [payload]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "inside", "doc_ids", "n_tokens", "payload"])

        for texts, ids in texts_of(batches, text_col, id_col, limit=BATCH_BYTES):
            for doc_id, made in zip(ids, encoder.encode(texts), strict=True):
                doc_ids.append(doc_id)
                packed.append(made + end)
                total += len(packed[-1]) // 4
                if total >= SEGMENT_TOKENS:
                    yield segment()
                    inside += total
                    doc_ids, packed, total = [], [], 0
        if doc_ids:
            yield segment()

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append the end id, and write segments in ascending id order (nulls first) to ``folder``.

    Null and blank texts hold the end id alone. Rows with one id follow each other in the order of their text's hash; nothing is
    dropped. Ranges are sampled from ids and hashes only, and texts are shuffled once. Other columns are not read.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    dealt.mapInArrow(_segments(path, end_id, "text", "id"), SEGMENT).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder, each with ``start``: the number of ids in all segments before it."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # a segment knows how many ids its own task wrote before it; one row for each task gives what earlier tasks wrote
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return segments.join(before, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before")


def documents(segments: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the packed segments that ``read`` gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["payload"])
                ids, ends = segment.ids(), segment.ends.astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("doc_ids", "start", "payload").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
