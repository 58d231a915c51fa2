"""Substring dedup by level-wise doubling.

A window of ``width`` words can only repeat if the words inside it do. Level one looks at windows of a quarter of the width: of the
quarters inside each full window the one with the lowest hash stands for it (the same in every copy), so about one in eight positions is
counted. What occurs once is dropped; what repeats is extended to half the width and counted again; the survivors alone are looked
at in full width. Hashes double too: H(2n) at i is H(n) at i times a power plus H(n) at i + n. The words of many texts lie in a row and
are hashed together; windows that reach into the next text are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import runs_of, words_in_a_row

FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
ONCE = "key long, id long, code int"
FULL = "key long, more int, id long, start int"


def _hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _ladder(h: np.ndarray, base: int, width: int, top: int) -> Iterator[np.ndarray]:
    """Hashes of all windows of width/4, width/2, ... up to top words, modulo 2**64, from those of the words."""
    n = width // 4
    level = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        level *= np.uint64(base)
        level += h[k : k + len(level)]
    yield level
    while n < top:
        level = level[:-n] * np.uint64(pow(base, n, 1 << 64)) + level[n:]
        yield level
        n *= 2


def _lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the lowest value of every run of ``size``, the first one of equal ones."""
    place, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)  # the last two runs may overlap
        right = values[step:] < values[:-step]
        place = np.where(right, place[step:], place[:-step])
        values = np.where(right, values[step:], values[:-step])
        span += step
    return place


class Windows:
    """The full windows of some texts (by start, among the words of all texts in a row), and what stands for each at the lower levels.

    Texts without an id have none. Windows whose representatives are among ``once`` or ``half_once``, lists by text, are left out.
    """

    def __init__(self, rows: pa.RecordBatch, width: int, top: int):
        """``rows`` has text, id and such lists; ``top`` is the size of the widest hashes that are asked for."""
        self.words, self.n = words_in_a_row(rows.column("text"))
        self.id = pc.fill_null(rows.column("id"), 0).to_numpy()
        self.first, self.quarter, self.width = np.cumsum(self.n) - self.n, width // 4, width
        count = np.where(rows.column("id").is_valid().to_numpy(zero_copy_only=False), np.maximum(self.n - width + 1, 0), 0)
        self.start = np.arange(count.sum()) + np.repeat(self.first - (np.cumsum(count) - count), count)
        if not len(self.start):
            return
        self.hashes = _hashed(self.words)
        self.low, *self.wider = _ladder(self.hashes, FIRST, width, top)
        self.anchor = _lowest((self.low ^ (self.low >> np.uint64(29))) * np.uint64(SECOND), width - self.quarter + 1)
        # the half that holds the anchor and lies inside the window: to its right if there is room, else ending with it
        self.code = self.anchor * 2 + (np.arange(len(self.anchor)) < self.anchor - width // 2)
        for name, codes, wide in (("once", self.anchor, 1), ("half_once", self.code, 2)):
            if name in rows.schema.names:
                self.start = self.start[~self.marked(rows.column(name), wide)[codes[self.start]]]

    def marked(self, lists: pa.Array, wide: int = 1) -> np.ndarray:
        """Whether a code, ``wide`` of them a word, is in its text's list, where codes count from the text's first word."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        out = np.zeros(wide * len(self.words) + 1, bool)
        out[lists.flatten().to_numpy() + np.repeat(wide * self.first, sizes)] = True
        return out

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, id, code) of the distinct representatives at level 0 or 1 of the windows left; codes count from the text's first word."""
        if not len(self.start):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        met = np.zeros((k + 1) * len(self.words), bool)
        met[(self.anchor, self.code)[k][self.start]] = True
        code = np.nonzero(met)[0]
        key = self.wider[0][(code >> 1) - (code & 1) * self.quarter] if k else self.low[code]
        return key, *self.by_text(code, k + 1)

    def by_text(self, code: np.ndarray, wide: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(id, code counted from the text's first word)."""
        text = np.repeat(np.arange(len(self.n)), self.n)[code // wide]
        return self.id[text], (code - wide * self.first[text]).astype(np.int32)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that tell the full windows left apart."""
        *_, more = _ladder(self.hashes, SECOND, self.width, self.width)
        return self.wider[-1][self.start], (more[self.start] >> np.uint64(32)).astype(np.uint32)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _level_rows(k: int, width: int, lists: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "text", "id", *("once", "half_once")[:lists]):
            key, owner, code = Windows(rows, width, width // 4 << k).level(k)
            yield pa.RecordBatch.from_arrays([_long(key), pa.array(owner), pa.array(code)], names=["key", "id", "code"])

    return run


def _full_rows(width: int):
    """Keys of the full windows that are left; of equal windows in one batch of texts the earliest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "text", "id", "once", "half_once"):
            found = Windows(rows, width, width)
            if len(found.start):
                (key, more), (owner, start) = found.keys(), found.by_text(found.start)
                order = np.lexsort((start, owner, more, key))
                new = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (more[order[1:]] != more[order[:-1]])]
                first = np.sort(order[new])  # in text order: neighbours share most bytes of their shuffled rows
                yield pa.RecordBatch.from_arrays(
                    [_long(key[first]), pa.array(more[first].view(np.int32)), pa.array(owner[first]), pa.array(start[first])], names=["key", "more", "id", "start"]
                )

    return run


def _first_of_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, start) of the first row of every run of equal keys in sorted rows."""
    last = None
    for batch in batches:
        key, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.r_[last != (key[0], more[0]), (key[1:] != key[:-1]) | (more[1:] != more[:-1])]
        last = (key[-1], more[-1])
        yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(new)), batch.column(3).filter(pa.array(new))], names=["id", "start"])


def _removed(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "text", "id", "once", "half_once", "firsts"):
            found = Windows(rows, width, width // 4)
            later = found.start[~found.marked(rows.column("firsts"))[found.start]]
            edge = np.zeros(len(found.words) + 1, np.int64)
            edge[later] = 1
            edge[later + width] -= 1
            kept = np.cumsum(edge[:-1]) == 0
            stops = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(found.n)]]
            left = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), found.words.filter(pa.array(kept)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(found.n, pa.int64()), pa.array(found.n - np.diff(stops), pa.int64()), pc.binary_join(left, b" ")],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def _by_document(once: DataFrame, name: str, column: str = "code") -> DataFrame:
    return once.groupBy("id").agg(F.collect_list(column).alias(name))


def _counted_once(rows: DataFrame, name: str) -> DataFrame:
    """Representatives of which there is one; counts are combined before the shuffle."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("code").alias("code"))
    return _by_document(counts.filter("n = 1"), name)


def drop_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): words covered by a window of ``width`` words that also starts earlier are removed.

    Earlier is a smaller id, or a smaller start in the same document; windows are judged on the input. ``kept`` is the rest, joined by
    one space, as UTF-8 bytes. Null and short texts lose nothing. Rows with a null id neither lose words nor make others lose them.
    Rows that repeat an id and its text come out alike; rows that repeat an id with another text may keep words that an equal place in
    the other row keeps. ``width`` is a multiple of four. Other columns are not read.
    """
    if width % 4:
        raise ValueError("width must be a multiple of four")
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    # every pass joins the same exchange of the texts, which is written once
    once = _counted_once(source.mapInArrow(_level_rows(0, width, 0), ONCE), "once")
    first_pass = source.join(once, "id", "left").select("text", "id", "once")
    lower = first_pass.mapInArrow(_level_rows(1, width, 1), ONCE)
    second_pass = first_pass.join(_counted_once(lower, "half_once"), "id", "left").select("text", "id", "once", "half_once")
    full = second_pass.mapInArrow(_full_rows(width), FULL)
    ordered = full.repartition("key").sortWithinPartitions("key", "more", "id", "start")
    firsts = _by_document(ordered.mapInArrow(_first_of_runs, "id long, start int"), "firsts", "start")
    last_pass = second_pass.join(firsts, "id", "left").select("text", "id", "once", "half_once", "firsts")
    return last_pass.mapInArrow(_removed(width), "id long, n_words long, n_removed long, kept binary")
