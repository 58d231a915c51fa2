"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of a whole batch of documents are laid out as one symbol row. An inverted index holds, for every rank, the
positions whose pair merges to it; ranks are taken in order and each merge is applied to all its positions at once, which
touches only the neighbours: their new pairs enter the index, stale entries are recognised when their rank comes up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import release_memory, texts_of

CACHED = 150_000
BATCH_BYTES = 6 << 20
SLICE = 1 << 17


@lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    """Token bytes by id; empty where no token has an id."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [found.get(rank, b"") for rank in range(max(found) + 1)]


class Merges:
    """Ranks of a byte-level vocabulary: token bytes by id, and the id that a pair of ids merges to."""

    def __init__(self, path: str):
        self.tokens = tokens(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.size = len(self.tokens)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.width = np.array([*map(len, self.tokens), -self.size], np.int32)  # a dead symbol (-1) is never part of a pair
        pairs = [
            (self.ranks[token[:k]] * self.size + self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.merged = np.r_[table[:, 0], np.iinfo(np.int64).max], np.r_[table[:, 1], -1]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs; -1 where they don't merge or the left side is missing (-1)."""
        key = left.astype(np.int64) * self.size + right
        at = self.keys.searchsorted(key)
        found = self.merged[at]
        found[self.keys[at] != key] = -1
        return found

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each (non-empty) piece as little-endian 32-bit integers; a piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None:
                todo.append(k)
            else:
                out[k] = whole.to_bytes(4, "little")
        if todo:
            symbols, ends = self._merge_all([pieces[k] for k in todo])
            packed, at = symbols.astype("<u4").tobytes(), 0
            for k, end in zip(todo, (ends * 4).tolist(), strict=True):
                out[k], at = packed[at:end], end
        return out

    def _merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Remaining symbols of all pieces in a row, and where each piece's symbols end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        symbol = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        following[ends - 1] = -1
        before[ends - sizes] = -1

        # the index: for every rank the positions whose pair merges to it, taken in order of rank; those of the start stay packed, by rank
        first_ranks, first_at = self._pairs(symbol, following)
        first_end = np.searchsorted(first_ranks, np.arange(self.size), "right").tolist()
        del first_ranks
        index: dict[int, list[int]] = {}

        def enter(positions: np.ndarray) -> int:
            ranks = self.rank(symbol[positions], symbol[following[positions]])
            merging = ranks >= 0
            ranks = ranks[merging].tolist()
            for r, p in zip(ranks, positions[merging].tolist(), strict=True):
                index.setdefault(r, []).append(p)
            return min(ranks, default=self.size)

        rank, taken = 0, 0
        while rank < self.size:
            if taken >= first_end[rank] and rank not in index:
                rank += 1
                continue
            at = np.array(index.pop(rank, ()), np.int32)
            if taken < first_end[rank]:
                at = np.concatenate([first_at[taken : first_end[rank]], at])
                taken = first_end[rank]
            at.sort()
            # the bytes from an entry's position on don't change, so its pair still merges to this rank if it is as long
            after = following[at]
            valid = (after >= 0) & (self.width[symbol[at]] + self.width[symbol[after]] == self.width[rank])
            valid[1:] &= at[1:] != at[:-1]
            at, after = at[valid], after[valid]
            if len(at) > 1:
                chained = np.zeros(len(at), bool)
                chained[1:] = after[:-1] == at[1:]
                if chained.any():  # in a run of overlapping pairs (a a a a) every second one merges, from the left
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
                at, later = self._in_turn(at, rank, symbol, following, before, owner)
                if len(later):
                    index[rank] = later.tolist()
            gone = following[at]
            after = following[gone]
            symbol[at], symbol[gone] = rank, -1
            following[at] = after
            linked = after >= 0
            before[after[linked]] = at[linked]
            left = before[at]
            left = left[left >= 0]
            rank = min(rank, enter(np.concatenate([left, at[linked]])))

        left_over = symbol >= 0
        return symbol[left_over], np.cumsum(np.add.reduceat(left_over.astype(np.int64), ends - sizes))

    def _pairs(self, symbol: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks that the pairs at the start merge to, ascending, and their positions; looked up in slices."""
        ranks, places = [], []
        for start in range(0, len(symbol), SLICE):
            positions = np.nonzero(following[start : start + SLICE] >= 0)[0].astype(np.int32) + np.int32(start)
            found = self.rank(symbol[positions], symbol[following[positions]])
            ranks.append(found[found >= 0].astype(np.int32))
            places.append(positions[found >= 0])
        found = np.concatenate(ranks)
        order = np.argsort(found, kind="stable")
        return found[order], np.concatenate(places)[order]

    def _in_turn(self, at, rank, symbol, following, before, owner):
        """(positions to merge now, positions to look at again).

        Where a merge makes a pair of a lower rank, that pair comes before the piece's next pair of this rank: such pieces
        merge their first position only.
        """
        own = owner[at]
        again = np.zeros(len(at), bool)
        again[1:] = own[1:] == own[:-1]
        if not again.any():
            return at, at[:0]
        gone = following[at]
        beyond = following[gone]
        left = np.where(before[at] >= 0, symbol[before[at]], -1)
        joined = np.r_[False, beyond[:-1] == at[1:]]  # the left neighbour has just become this rank's token
        left[joined] = rank
        merged = np.full(len(at), rank)
        made = np.stack([
            self.rank(left, merged), np.where(beyond >= 0, self.rank(merged, symbol[beyond]), -1),
            np.where(np.r_[joined[1:], False], self.rank(merged, merged), -1),
        ])
        low = ((made >= 0) & (made < rank)).any(axis=0)
        if not low.any():
            return at, at[:0]
        wait = again & np.isin(own, own[low])
        return at[~wait], at[wait]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Encodes texts; pieces it has met are kept up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern = merges(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers; null gives none."""
        pieces: dict[str, str] = {}  # one string object for equal pieces
        cut = []
        for t in texts:
            found = self.pattern.findall(t.decode()) if t else []
            cut.append(list(map(pieces.setdefault, found, found)))
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.merges.replay([p.encode() for p in new]), strict=True))
        out = [b"".join(map(self.known.__getitem__, found)) for found in cut]
        if len(self.known) > CACHED:  # what is frequent is in every batch
            self.known = {p: self.known[p] for p in pieces}
        return out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every whole text as little-endian 32-bit integers in one binary value.

    Null and empty texts have no ids. Rows come out one for one, in any number per id; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        encoder = Encoder(path, pattern)
        for texts, ids in texts_of(batches, text_col, id_col, limit=BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(encoder.encode(texts), pa.binary())], names=["id", "ids"])
        encoder = None
        release_memory()

    return docs.select(F.col(text_col).cast("string"), F.col(id_col).cast("long")).mapInArrow(run, "id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, bytes) for the rows of ``encode``: the bytes that the ids stand for, empty for none."""

    def run(batches: Iterable[pa.RecordBatch]):
        known = tokens(path)
        for packed, ids in texts_of(batches, "ids", "id", limit=2 << 20):
            made = [b"".join([known[i] for i in np.frombuffer(p or b"", "<u4").tolist()]) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(made, pa.binary())], names=["id", "ids", "bytes"]
            )
        made = packed = None
        release_memory()

    return encoded.select("ids", "id").mapInArrow(run, "id long, ids binary, bytes binary")
