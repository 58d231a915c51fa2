"""LM scoring: a causal self-attention model, trained in numpy on subword ids.

Subwords are predicted by class: the commonest ones are classes of their own, the others share classes by kind and frequency, and a subword's
share of its class comes from the whole corpus. Class logits start from how often a class follows the last subword (corpus counts, inside
words and across their borders) and add what attention over the last 16 to 32 subwords gives. The attention weights are fitted on every
text, in rounds: groups of texts train from the same weights, and the mean of what they come to is the next round's. Texts are cut into blocks of 16; the window of a block is the block before and itself,
masked to what lies before each place, so windows overlap and every subword is scored once. A word's probability is that of its first
subword's class, among those that start words, times its share among the corpus's words of that class; a word that the corpus doesn't have is
spelt out. Of each class, what the corpus has met once is the chance of a new word; the spelling's mass on words that the corpus has is left unused.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentscope.llm.words import lowered_words, release_memory, runs_of, text_bytes, written

CLASSES = 128
SHARED = 8  # classes for the rest of the subwords that start a word, and as many for those that don't
BLOCK = 16
SIZE = 16  # width of embeddings, queries, keys and values
EMBEDDED = 1024
#: Bound: words that tasks hold as a table.
TOP_WORDS = 100_000
#: The weights of groups are averaged so many times while the texts are gone through once; how many weights are added up in a step; words of
#: a group in a round, about.
ROUNDS = 4
FAN = 64
GROUP_WORDS = 500_000
BATCH_BYTES = 2 << 20
AT_ONCE = 16  # words that are not worth a call of their own each
SLICE = 1024  # places whose class probabilities are worked out at a time, so that they stay near the core


class Subwords:
    """Ids of words, each with a blank before it; one more id ends a text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.stored = np.dtype("<u2" if self.size <= 1 << 16 else "<i4")  # how ids are kept between steps
        self.starts = np.zeros(self.size, bool)
        self.starts[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.starts[self.end] = True

    def word(self, word: bytes) -> list[int]:
        return self.coder.encode_ordinary(" " + word.decode())

    def packed(self, word: bytes) -> bytes:
        """The word's ids as 32-bit integers."""
        return array("i", self.word(word)).tobytes()

    def all_packed(self, words: list[bytes]) -> list[bytes]:
        """``packed`` of every word. Many ASCII words go in one call: a match has a blank at its front alone, and so has a subword."""
        plain = [w for w in words if w.isascii()]
        if len(plain) > AT_ONCE:
            flat = np.array(self.coder.encode_ordinary(" " + b" ".join(plain).decode()), np.int32)
            first = np.nonzero(self.starts[flat])[0]
            if len(first) == len(plain):
                raw, cuts = flat.tobytes(), (4 * np.r_[first, len(flat)]).tolist()
                spelt = iter([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
                return [next(spelt) if w.isascii() else self.packed(w) for w in words]
        return list(map(self.packed, words))


def _listed(words: pa.Array) -> list[bytes]:
    """The words one by one; by way of numpy, which takes a tenth of the time of Arrow's own list."""
    return words.to_numpy(zero_copy_only=False).tolist()


# ---- corpus counts ----


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each A-Z-lowered word occurs in all texts. Batches are counted before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, text_col, limit=4 * BATCH_BYTES):
            found = lowered_words(part.column(0))[0].dictionary_encode()
            counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _commonest(counts: DataFrame) -> dict[bytes, int]:
    """Words above a count that at most TOP_WORDS reach, commonest first; found from a histogram, without a sort of all words."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    total, cut = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["words"]
        if total > TOP_WORDS:
            break
        cut = r["least"]
    if cut is None:
        return {}
    found = counts.filter(F.col("n") >= cut).toArrow()
    return dict(sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0])))


def _subword_pairs(counts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(a, b, n): how often subword b follows a inside words of the whole corpus; a is -1 where b starts the word, b is -1 where a ends it;
    with a = -3, how many words that b starts occur once.

    Each task adds up its words first; a vocabulary bounds the number of pairs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(path, pattern)
        width = sub.size + 1
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            parts = sub.all_packed(_listed(batch.column(0)))
            if not parts:
                continue
            n, sizes = batch.column(1).to_numpy(), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            flat, ends = np.frombuffer(b"".join(parts), np.int32).astype(np.int64), np.cumsum(sizes)
            last = np.r_[-1, flat[:-1]]
            last[ends - sizes] = -1
            once = flat[(ends - sizes)[n == 1]]
            a = np.concatenate([last, flat[ends - 1], np.full(len(once), -3)])
            b = np.concatenate([flat, np.full(len(ends), -1), once])
            keys, at = np.unique(np.concatenate([keys, (a + 3) * width + b + 1]), return_inverse=True)
            more = np.concatenate([sums, np.repeat(n, sizes), n, np.ones(len(once), np.int64)])
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, more)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys // width - 3, pa.int32()), pa.array(keys % width - 1, pa.int32()), pa.array(sums, pa.int64())], names=["a", "b", "n"]
        )

    return written(counts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "subword-pairs")


def _by_class(pairs: DataFrame, m: Model) -> np.ndarray:
    """(row, class, n), at most rows times classes: pairs by the model's rows and classes; class -1 is the end of the word, row -1 its start,
    row -3 words met once."""
    spark = pairs.sparkSession
    known = spark.createDataFrame(pa.table({"id": pa.array(range(len(m.class_of)), pa.int32()), "class": pa.array(m.class_of, pa.int32()), "row": pa.array(m.row_of, pa.int32())}))
    rows = pairs.join(known.select(F.col("id").alias("a"), "row"), "a", "left").join(known.select(F.col("id").alias("b"), "class"), "b", "left")
    cells = rows.groupBy(F.coalesce("row", "a").alias("row"), F.coalesce("class", F.lit(-1)).alias("class")).agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    return np.stack([found[c].to_numpy().astype(np.int64) for c in ("row", "class", "n")], axis=1)


# ---- the model ----


@dataclass
class Model:
    class_of: np.ndarray  # by subword
    share: np.ndarray  # log share of its class, by subword
    begins: np.ndarray  # whether a class's subwords start words, by class
    row_of: np.ndarray  # row of the tables below, by last subword
    start: np.ndarray  # (rows, CLASSES) class logits after a subword, from corpus counts
    key: np.ndarray  # (rows, SIZE), as query and value
    query: np.ndarray
    value: np.ndarray
    distance: np.ndarray  # attention bias by distance
    out: np.ndarray  # (SIZE, CLASSES)
    top: dict[bytes, int]  # place of each of the commonest words in the next three
    top_count: np.ndarray
    top_ids: list[bytes]  # subwords, as 32-bit integers
    top_share: np.ndarray  # log share among all words whose first subword is of the same class
    words: np.ndarray  # how many words of the corpus start with each class
    old: np.ndarray  # chance that a word of a class is one of the corpus's


PAD = -1


def blocks(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, next, window) of all texts in blocks: the subword before each place, the one at it, and the last ones of the block before too.

    Padding is PAD in all three. A text's first subword follows the end of another.
    """
    n_blocks = np.array([-(-len(t) // BLOCK) for t in ids])
    firsts = np.r_[0, np.cumsum(n_blocks)]
    following = np.full((int(firsts[-1]), BLOCK), PAD, np.int64)
    flat = following.reshape(-1)
    for t, f in zip(ids, firsts[:-1].tolist(), strict=True):
        flat[f * BLOCK : f * BLOCK + len(t)] = t
    last = np.full_like(following, PAD)
    last.reshape(-1)[1:] = flat[:-1]
    last[firsts[:-1][n_blocks > 0], 0] = end
    last[following == PAD] = PAD
    before = np.full_like(last, PAD)
    before[1:] = last[:-1]
    before[firsts[:-1][n_blocks > 0]] = PAD
    return last, following, np.concatenate([before, last], axis=1)


_PLACE = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far back
_LATER = np.where(_PLACE < 0, np.float32(-1e9), np.float32(0))
_BACK = np.maximum(_PLACE, 0)
_ONES = np.ones(2 * BLOCK, np.float32)


def _attend(m: Model, last: np.ndarray, window: np.ndarray):
    """Rows of the tables and attention weights of blocks; what is later or padding has none."""
    rows, wide = m.row_of.take(last), m.row_of.take(window)
    scores = m.query.take(rows, axis=0) @ m.key.take(wide, axis=0).transpose(0, 2, 1)
    scores *= np.float32(SIZE**-0.5)
    scores += m.distance[_BACK] + _LATER
    scores += np.where(window < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    np.exp(scores, out=scores)
    scores /= (scores @ _ONES + np.float32(1e-30))[:, :, None]
    return rows, wide, scores


def log_probabilities(m: Model, ids: list[np.ndarray], end: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all subwords of all texts in a row: natural log probability of its class, and of the event that a word starts there.

    Attention covers every subword; class probabilities are worked out where ``need`` says, and are zero elsewhere.
    """
    last, following, window = blocks(ids, end)
    real = (following != PAD).ravel()
    wanted = np.zeros(following.size, bool)
    wanted[real] = need
    chance, starts = np.zeros(following.size), np.zeros(following.size)
    sums = np.stack([np.ones(CLASSES), m.begins], axis=1).astype(np.float32)
    for at in range(0, len(last), 64):
        part = np.nonzero(wanted[at * BLOCK : (at + 64) * BLOCK])[0]
        rows, wide, weights = _attend(m, last[at : at + 64], window[at : at + 64])
        z = (weights @ m.value.take(wide, axis=0)).reshape(-1, SIZE).take(part, axis=0) @ m.out
        z += m.start.take(rows.reshape(-1).take(part), axis=0)
        hit = z[np.arange(len(z)), m.class_of[following[at : at + 64].reshape(-1)[part]]]
        whole, begun = np.log(np.exp(z, out=z) @ sums).T
        chance[at * BLOCK + part], starts[at * BLOCK + part] = hit - whole, begun - whole
    return chance[real], starts[real]


def _tables(counts: np.ndarray, by_class, n_texts: int, n_words: int, sub: Subwords, borders=None) -> Model:
    """The model before any training: classes, shares and start logits from corpus counts.

    ``counts`` has each subword's; ``by_class(model)`` gives the pairs by rows and classes, ``borders(model)`` those across word borders;
    without it what follows a word is taken to be independent of it.
    """
    counts = counts + 0.5
    counts[sub.end] += n_texts
    order = np.argsort(-counts, kind="stable")
    row_of = np.zeros(sub.size, np.int64)  # row 0: a rare subword, row 1: the end
    common = order[order != sub.end][:EMBEDDED]
    row_of[common] = np.arange(2, len(common) + 2)
    row_of[sub.end] = 1
    size = len(common) + 2
    class_of = np.zeros(sub.size, np.int64)
    own = CLASSES - 2 * SHARED
    order = np.r_[sub.end, order[order != sub.end]]  # the end of a text is a class of its own
    class_of[order[:own]] = np.arange(own)
    for kind in (0, 1):
        rest = order[own:][sub.starts[order[own:]] == bool(kind)]
        if len(rest):
            part = np.cumsum(counts[rest]) / counts[rest].sum()
            class_of[rest] = own + SHARED * kind + np.minimum((part * SHARED).astype(int), SHARED - 1)
    share = np.log(counts) - np.log(np.bincount(class_of, weights=counts, minlength=CLASSES))[class_of]
    begins = np.zeros(CLASSES, bool)
    begins[class_of[sub.starts]] = True
    rng = np.random.default_rng(7)
    key, query, value = (rng.normal(0, 0.3, (size, SIZE)).astype(np.float32) for _ in range(3))
    distance = np.linspace(0, -1, 2 * BLOCK + 1).astype(np.float32)
    out = rng.normal(0, 0.05, (SIZE, CLASSES)).astype(np.float32)
    m = Model(class_of, share, begins, row_of, np.zeros((size, CLASSES), np.float32), key, query, value, distance, out, {}, np.zeros(0), [], np.zeros(0), np.zeros(CLASSES), np.full(CLASSES, 0.5))
    row, kind, n = by_class(m).T
    inside, ends, first = np.zeros((size, CLASSES)), np.zeros(size), np.full(CLASSES, 0.1)
    within, starting = (row >= 0) & (kind >= 0), (row == -1) & (kind >= 0)
    np.add.at(inside, (row[within], kind[within]), n[within])
    np.add.at(ends, row[(kind < 0) & (row >= 0)], n[(kind < 0) & (row >= 0)])
    np.add.at(first, kind[starting], n[starting])
    once = np.bincount(kind[row == -3], weights=n[row == -3], minlength=CLASSES)
    m.words = first - 0.1
    m.old = 1 - (once + 0.5) / (m.words + 1)
    after_text = first / first.sum()
    stop = n_texts / max(1, n_texts + n_words)
    after_word = after_text * (1 - stop)
    after_word[class_of[sub.end]] += stop
    backed = inside.sum(axis=0) + 0.1
    backed /= backed.sum()
    across = None if borders is None else borders(m)
    chance = inside + (ends[:, None] * after_word if across is None else across) + 20 * (0.5 * backed + 0.5 * after_word)
    chance[1] = after_text + 1e-4 if across is None else across[1] + 20 * (after_text + 1e-4)
    m.start = np.log(chance / chance.sum(axis=1, keepdims=True)).astype(np.float32)
    return m


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that occur, and the sums of the ``values``, an even number of 32-bit floats each, that belong to each."""
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.int16), kind="stable")  # by digits, as there are few rows
    flat = flat[order]
    starts = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0]
    pairs = values.reshape(-1, values.shape[-1]).take(order, axis=0).view(np.complex64)  # numpy goes column by column: two at a time
    return flat[starts], np.add.reduceat(pairs, starts, axis=0).view(np.float32)


WEIGHTS = ("key", "query", "value", "distance", "out")


def _gradients(m: Model, x: np.ndarray, following: np.ndarray, w: np.ndarray) -> dict[str, tuple[np.ndarray | slice, np.ndarray]]:
    """Of the mean cross-entropy of the next class over blocks: by weight, the rows that the blocks touch and their gradients."""
    real = np.nonzero(following.reshape(-1) >= 0)[0]
    rows, wide, weights = _attend(m, x, w)
    v, k, q = m.value.take(wide, axis=0), m.key.take(wide, axis=0), m.query.take(rows, axis=0)
    seen = weights @ v
    flat, after, kind = seen.reshape(-1, SIZE), rows.reshape(-1), m.class_of.take(following.reshape(-1))
    d_seen, d_out = np.zeros_like(seen), np.zeros_like(m.out)
    d_flat, ones = d_seen.reshape(-1, SIZE), np.ones(CLASSES, np.float32)
    for at in range(0, len(real), SLICE):
        part = real[at : at + SLICE]
        mine = flat.take(part, axis=0)
        p = mine @ m.out
        p += m.start.take(after.take(part), axis=0)
        np.exp(p, out=p)
        whole = p @ ones
        p[np.arange(len(p)), kind[part]] -= whole  # chances less what came, still to be divided by the whole
        by = (1 / (whole * np.float32(len(real))))[:, None]
        d_flat[part] = (p @ m.out.T) * by
        d_out += (mine * by).T @ p
    d_weights = d_seen @ v.transpose(0, 2, 1)
    d_weights -= ((d_weights * weights) @ _ONES)[:, :, None]
    d_scores = np.multiply(weights, d_weights, out=d_weights)
    d_distance = np.bincount(_BACK.ravel(), weights=d_scores.sum(axis=0).ravel(), minlength=len(m.distance))
    d_scores *= np.float32(SIZE**-0.5)
    asked, d_query = _sum_rows(rows, d_scores @ k)
    d_wide = np.empty((*wide.shape, 2 * SIZE), np.float32)
    np.matmul(weights.transpose(0, 2, 1), d_seen, out=d_wide[..., :SIZE])
    np.matmul(d_scores.transpose(0, 2, 1), q, out=d_wide[..., SIZE:])
    met, d_met = _sum_rows(wide, d_wide)
    d_value, d_key = d_met[:, :SIZE], d_met[:, SIZE:]
    return {"out": (_ALL, d_out), "distance": (_ALL, d_distance.astype(np.float32)), "query": (asked, d_query), "value": (met, d_value), "key": (met, d_key)}


_ALL = slice(None)


class Adam:
    """Moments of the gradients of a model's weights; a row's move when it is touched."""

    def __init__(self, m: Model):
        self.state = {k: (np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))) for k in WEIGHTS}
        self.t = 0

    def step(self, m: Model, grads: dict[str, tuple[np.ndarray | slice, np.ndarray]], rate: float) -> None:
        self.t += 1
        wide, narrow = np.float32(rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.99**self.t))
        for name, (rows, found) in grads.items():
            one, two = self.state[name]
            was, were = one[rows], two[rows]
            first = found - was
            first *= np.float32(0.1)
            first += was
            second = found * found
            second -= were
            second *= np.float32(0.01)
            second += were
            one[rows], two[rows] = first, second
            second *= narrow
            np.sqrt(second, out=second)
            second += np.float32(1e-6)
            first *= wide
            first /= second
            getattr(m, name)[rows] -= first


def train(
    m: Model, ids: list[np.ndarray], end: int, epochs: int = 1, rate: float = 0.02, batch: int = 256, adam: Adam | None = None, fall: float = 1.0,
) -> int:
    """Fit the attention tables and output weights to the next class, by Adam on cross-entropy; batches in a fixed random order.

    The start logits stay what the corpus says. The rate falls by the share ``fall`` on the way. Gives the number of blocks.
    """
    last, following, window = blocks(ids, end)
    adam, rng, done = adam or Adam(m), np.random.default_rng(3), 0
    steps = max(1, epochs * -(-len(last) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(last))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            done += 1
            adam.step(m, _gradients(m, last[pick], following[pick], window[pick]), rate * (1 - fall * done / (steps + 1)))
    return len(last)


Words = list[list[bytes]] | tuple[pa.Array, np.ndarray]  # of texts: by text, or all in a row and how many each text has


def _spelt(m: Model, sub: Subwords, texts: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(subwords, size of each word, place of each word among the commonest or -1), with the end after each text as a word of its own;
    and the number of subwords of each text. A word that occurs several times is spelt once."""
    if isinstance(texts, list):
        texts = pa.array([w for words in texts for w in words], pa.binary()), np.array([len(words) for words in texts], np.int64)
    words, n = texts
    found = words.dictionary_encode()
    distinct = _listed(found.dictionary)
    at = np.fromiter((m.top.get(w, -1) for w in distinct), np.int64, len(distinct))
    others = iter(sub.all_packed([w for k, w in zip(at.tolist(), distinct, strict=True) if k < 0]))
    parts = [m.top_ids[k] if k >= 0 else next(others) for k in at.tolist()]
    parts.append(np.int32(sub.end).tobytes())
    long = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    stops = np.cumsum(n + 1)
    order = np.full(len(words) + len(n), len(distinct))
    inside = np.ones(len(order), bool)
    inside[stops - 1] = False
    order[inside] = found.indices.to_numpy()
    sizes = long[order]
    ends = np.cumsum(sizes)
    from_ = np.repeat((np.cumsum(long) - long)[order] - (ends - sizes), sizes)
    from_ += np.arange(len(from_))
    return np.frombuffer(b"".join(parts), np.int32)[from_].astype(np.int64), sizes, np.r_[at, -1][order], np.diff(ends[stops - 1], prepend=0)


def texts_as_subwords(m: Model, sub: Subwords, texts: Words) -> list[np.ndarray]:
    flat, _, _, totals = _spelt(m, sub, texts)
    return np.split(flat, np.cumsum(totals)[:-1])


def word_scores(m: Model, sub: Subwords, texts: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words and ends of all texts in a row: natural log probability, the word's place among the commonest or -1, and for others
    than these (log probability of their class alone) what is still to be added: with the log of its count for a word of the corpus, and
    for a new one. The first is what the commonest words have, so that it makes no difference which words the table holds."""
    if not len(texts if isinstance(texts, list) else texts[1]):
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    flat, sizes, places, totals = _spelt(m, sub, texts)
    logs, of_count, of_one = _scored(m, sub, flat, np.cumsum(sizes) - sizes, places, totals)
    return logs, places, of_count, of_one


def _scored(
    m: Model, sub: Subwords, flat: np.ndarray, first: np.ndarray, places: np.ndarray, totals: np.ndarray, may_be_new: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_scores`` without the places, of texts that are spelt: all subwords, where words begin, and how many subwords each text has.

    Words that the corpus surely has (not ``may_be_new``) are not spelt out; what new ones would add is 0 for them.
    """
    ends = flat[first] == sub.end
    common = places >= 0
    new = ~common & ~ends if may_be_new is None else ~common & ~ends & may_be_new
    sizes = np.diff(first, append=len(flat))
    need = np.repeat(new, sizes)
    need[first] = True
    chance, starts = log_probabilities(m, np.split(flat, np.cumsum(totals)[:-1]), sub.end, need)
    head = chance[first] - starts[first]
    spelt = chance + m.share[flat]
    spelt[first] = m.share[flat[first]]
    spelt = np.add.reduceat(spelt, first) + np.r_[starts[first[1:]], 0.0]
    kind = m.class_of[flat[first]]
    old = np.log(m.old)[kind]
    share = np.r_[m.top_share, 0.0][places]
    return head + np.where(common, old + share, 0.0), old - np.log(np.maximum(m.words, 1))[kind], np.where(new | common | ends, np.log1p(-m.old)[kind] + spelt, 0.0)


def with_top(m: Model, sub: Subwords, top: dict[bytes, int]) -> None:
    """The commonest words: their counts, subwords and shares of the class of their first subword."""
    m.top = {w: k for k, w in enumerate(top)}
    ids = [sub.word(w) for w in top]
    m.top_ids = [array("i", i).tobytes() for i in ids]
    m.top_count = np.array(list(top.values()), np.float64)
    kind = m.class_of[np.array([i[0] for i in ids], np.int64)]
    m.top_share = np.log(m.top_count) - np.log(np.maximum(m.words, 1))[kind]


# ---- operator ----


def held_out(id_col: Column) -> Column:
    """True for one document of five, by the crc32 of the id's text; such documents teach nothing. Null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def spelt(texts: DataFrame, m: Model, path: str, pattern: str) -> DataFrame:
    """The rows with their subwords in place of their ``text``, so that each text is split and spelt once, whatever goes through it later.

    ``bytes`` of the text; ``ids`` with the end; ``places`` of the words among the commonest, or -1, as 32-bit integers; the ``rare`` other words.
    Where words begin is seen from the ids.
    """
    kept = [c for c in texts.columns if c != "text"]
    schema = T.StructType([*texts.drop("text").schema.fields, *T.StructType.fromDDL("bytes int, ids binary, places binary, rare array<binary>").fields])
    sent = texts.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sub = sent.value, Subwords(path, pattern)
        for part in runs_of(batches, "text", *kept, limit=BATCH_BYTES):
            words, n = lowered_words(part.column(0))
            flat, _, places, totals = _spelt(m, sub, (words, n))
            ends = np.cumsum(n + 1) - 1
            inside = np.delete(places, ends)
            others = np.r_[0, np.cumsum(inside < 0)][np.r_[0, np.cumsum(n)]]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], text_bytes(part.column(0)).cast(pa.int32()), _packed(flat.astype(sub.stored), totals), _packed(inside.astype("<i4"), n),
                 pa.ListArray.from_arrays(pa.array(others, pa.int32()), words.filter(pa.array(inside < 0)))],
                names=schema.names,
            )
        release_memory()

    return texts.select("text", *kept).mapInArrow(run, schema)


def _packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The numbers of each row as bytes."""
    stops = np.r_[0, np.cumsum(sizes)] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(flat)])


def _unpacked(rows: pa.Array, kind: np.dtype | str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and how many each row has."""
    parts = rows.to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind).astype(np.int64), sizes


def _borders(texts: DataFrame, m: Model, path: str, pattern: str) -> np.ndarray:
    """(rows, CLASSES): how often a class follows the last subword of a word, or the end of a text (row 1), over all of ``texts``, spelt or not."""
    if "ids" not in texts.columns:
        texts = spelt(texts.select("text"), m, path, pattern)
    sent = texts.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sub = sent.value, Subwords(path, pattern)
        cells = np.zeros(m.start.size, np.int64)
        for part in runs_of(batches, "bytes", "ids", limit=BATCH_BYTES, sized=True):
            flat, _ = _unpacked(part.column(1), sub.stored)
            first = np.nonzero(sub.starts[flat])[0]
            before = np.r_[sub.end, flat[first[1:] - 1]]  # a text's end stands before the next one's first word
            cells += np.bincount(m.row_of[before] * CLASSES + m.class_of[flat[first]], minlength=len(cells))
        found = np.nonzero(cells)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(cells[found], pa.int64())], names=["cell", "n"])
        release_memory()

    found = texts.select("bytes", "ids").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m.start.size)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    sent.destroy()
    return out.reshape(m.start.shape)


def fit(texts: DataFrame, m: Model, path: str, pattern: str, groups: int = 1, rounds: int = ROUNDS, rate: float = 0.02) -> None:
    """Fit the attention weights on all of ``texts``, (text, place) rows, spelt or not; every text is gone through once, in the round its place says.

    In a round the texts are dealt by place into ``groups``; each group trains from the same weights, and the next ones are the mean of the
    groups', by their blocks. So what is learnt depends on the rows alone, not on files or cores. Weights are added up in a tree of
    FAN groups a step, in the order of the groups; the driver gets FAN at most. The rate falls from one round to the next.
    """
    if "ids" not in texts.columns:
        texts = spelt(texts.select("text", "place"), m, path, pattern)
    fixed = texts.sparkSession.sparkContext.broadcast(replace(m, top={}, top_ids=[]))  # training needs no words
    shapes = [getattr(m, k).shape for k in WEIGHTS]
    *cuts, size = np.cumsum([getattr(m, k).size for k in WEIGHTS]).tolist()

    def put(m: Model, flat: np.ndarray) -> None:
        for name, part, shape in zip(WEIGHTS, np.split(flat, cuts), shapes, strict=True):
            setattr(m, name, part.reshape(shape).astype(np.float32))

    def flat(m: Model) -> np.ndarray:
        return np.concatenate([getattr(m, k).ravel() for k in WEIGHTS])

    def row(group: int, n: int, weights: np.ndarray) -> pa.Table:
        return pa.table({"place": pa.array([group], pa.int32()), "blocks": pa.array([n], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for k in np.argsort(rows["place"].to_numpy(), kind="stable").tolist():
            total += np.frombuffer(rows["weights"][k].as_buffer())
        return row(rows["place"][0].as_py() // FAN, sum(rows["blocks"].to_pylist()), total)

    for now in range(rounds):
        start, slower = flat(m), rate * (1 - now / rounds)

        def run(batches: Iterable[pa.RecordBatch], start: np.ndarray = start, rate: float = slower) -> Iterator[pa.RecordBatch]:
            m, sub, n = replace(fixed.value), Subwords(path, pattern), 0
            put(m, start)
            adam = Adam(m)
            for part in runs_of(batches, "bytes", "ids", limit=BATCH_BYTES, sized=True):
                whole, sizes = _unpacked(part.column(1), sub.stored)
                ids = np.split(whole, np.cumsum(sizes)[:-1])
                n += train(m, ids, sub.end, 1, rate, adam=adam, fall=0.0)
            if n:
                yield from row(TaskContext.get().partitionId(), n, n * flat(m).astype(np.float64)).to_batches()
            release_memory()

        mine = texts.filter(F.pmod("place", F.lit(rounds)) == now).select("place", "bytes", "ids").repartition(groups, "place").sortWithinPartitions("place", "ids")
        sums, left = mine.select("bytes", "ids").mapInArrow(run, "place int, blocks long, weights binary"), groups
        while True:
            sums = sums.groupBy(F.floor(F.col("place") / FAN)).applyInArrow(added, "place int, blocks long, weights binary")
            left = -(-left // FAN)
            if left <= FAN:
                break
        found = sums.toArrow().sort_by("place")
        if found.num_rows:
            put(m, sum(np.frombuffer(w.as_buffer()) for w in found["weights"]) / sum(found["blocks"].to_pylist()))
    fixed.destroy()


def score(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are A-Z-lowered words and one end. ``base_score`` is the base's log10 probability (counts plus one half), ``score`` the model's.
    Counts cover all texts that are not held out, and attention weights are fitted on all of them. A null or blank text is its end
    alone. Words outside the commonest TOP_WORDS meet their counts in a join. Rows that repeat an
    id come out one for one; with no text to learn from, counts are zero and all weights as they start.
    """
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id")).withColumn("held_out", held_out(F.col("id")))
    taught = source.filter(~F.col("held_out"))
    counts = written(word_counts(taught), "word-counts")
    n_texts = taught.count()
    n_words, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = n_words + n_texts
    top = _commonest(counts)
    sub = Subwords(path, pattern)
    pairs = _subword_pairs(counts, path, pattern)
    met = np.zeros(sub.size)
    found = pairs.filter("b >= 0 AND a <> -3").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    met[found["b"].to_numpy()] = found["n"].to_numpy()

    cut = []

    def borders(m: Model) -> np.ndarray:
        with_top(m, sub, top)
        cut.append(written(spelt(source.withColumn("place", F.xxhash64("id", "text")), m, path, pattern), "subwords", "zstd"))
        return _borders(cut[0].filter(~F.col("held_out")), m, path, pattern)

    model = _tables(met, lambda m: _by_class(pairs, m), n_texts, n_words, sub, borders)
    fit(cut[0].filter(~F.col("held_out")), model, path, pattern, 1 + n_words // (ROUNDS * GROUP_WORDS))
    distinct = vocabulary + (n_texts > 0)
    below = float(np.log10(total + 0.5 * (distinct + 1)))
    sent = source.sparkSession.sparkContext.broadcast(replace(model, top={}, top_ids=[]))  # words are spelt already

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        sub = Subwords(path, pattern)
        end = float(np.log10(n_texts + 0.5))
        for part in runs_of(batches, "bytes", "ids", "places", "rare", "id", "held_out", limit=BATCH_BYTES, sized=True):
            flat, totals = _unpacked(part.column(1), sub.stored)
            inside, n = _unpacked(part.column(2), "<i4")
            ends = np.cumsum(n + 1) - 1
            starts = ends - n
            places = np.insert(inside, np.cumsum(n), -1)
            held = part.column(5).to_numpy(zero_copy_only=False)  # the corpus has all words of the other texts
            logs, of_count, of_one = _scored(model, sub, flat, np.nonzero(sub.starts[flat])[0], places, totals, np.repeat(held, n + 1))
            found = np.r_[model.top_count, 0.0][places]
            scores = np.add.reduceat(logs, starts) / np.log(10)
            bases = np.add.reduceat(np.where(found > 0, np.log10(found + 0.5), 0.0), starts) + end
            knowns = np.add.reduceat((found > 0).astype(np.int64), starts) + (n_texts > 0)
            others = places < 0
            others[ends] = False
            rare = pa.StructArray.from_arrays(
                [part.column(3).flatten(), pa.array(of_count[others]), pa.array(of_one[others])], names=["word", "a", "b"]
            )
            stops = pa.array(np.r_[0, np.cumsum(others)[ends]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(4), part.column(5), pa.array(n + 1, pa.int64()), pa.array(knowns, pa.int64()), pa.array(bases), pa.array(scores),
                 pa.ListArray.from_arrays(stops, rare)],
                names=["id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
            )

    schema = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, a: double, b: double>>"
    rows = cut[0].mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scored", "zstd")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    met = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def total_of(c: Column) -> Column:  # in whole numbers and parts of 2**-40, as integers: the same whatever the order
        return F.sum(F.floor(c)).cast("double") + F.sum(F.floor((c - F.floor(c)) * float(1 << 40) + 0.5)).cast("double") / float(1 << 40)

    # a word of the corpus has its share among these, as in the tasks' table; the chance of a new word is spelt out
    logged = F.when(F.col("n") > 0, F.col("a") + F.log("n")).otherwise(F.col("b")) / math.log(10)
    added = met.groupBy("row").agg(
        total_of(F.log10(F.col("n") + 0.5)).alias("more"), total_of(logged).alias("more_score"), F.count_if(F.col("n") > 0).alias("more_known")
    )
    out = rows.drop("rare").join(added, "row", "left")
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
