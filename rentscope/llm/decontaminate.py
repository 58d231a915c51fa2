"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window of an item's length is laid wherever enough of its shingles occur in items of that length to reach the similarity. It may begin
with such a shingle, or be the document's last: any other is no more similar than the window one word on, which swaps its first, foreign shingle for
another. The windows' 64-bit SimHash meets the items' of that length in an index of radius + 1 bit blocks: two fingerprints within the
radius agree on one block at least. What is within the radius is compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import ascii_lower, words, written
from rentscope.operators.scale import once

WIDTH = 5
BITS = 64
#: Most distinct item shingles that are sent along with the plan as a set (some 16 MB); more are joined.
SET_BOUND = 200_000


def _shingle_at(parts: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(parts, i + k) for k in range(width)))


def _shingles(parts: Column, width: Column) -> Column:
    """Shingles of a word array, repeats included, joined by spaces; fewer words than ``width`` make one; none make none."""
    n = F.greatest(F.size(parts) - width, F.lit(0))
    made = F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, i + 1, width), " "))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(made)


def _simhash(shingles: Column) -> Column:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""

    def bits(hashes: Column) -> Column:
        def bit(value: Column, b: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
            return value.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), bit)

    return once(F.transform(shingles, lambda s: F.xxhash64(s)), bits)


def _weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger shingle counts of two arrays."""

    def count(of: Column, s: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == s))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(count(a, s), count(b, s)))
    return once(common, lambda c: c / (F.size(a) + F.size(b) - c))


def _block_keys(fp: Column, radius: int) -> Column:
    cuts = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    keys = []
    for k in range(radius + 1):
        mask = sum(1 << b for b in range(cuts[k], cuts[k + 1]))
        keys.append(F.struct(F.lit(k).alias("block"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, length, width, parts, shingles, fp) of items with a word; equal texts stay apart."""
    parts = words(ascii_lower(F.col(text_col).cast("string")))
    rows = items.select(F.col(item_col).alias("item_id"), parts.alias("parts")).filter(F.size("parts") > 0)
    rows = rows.withColumn("length", F.size("parts")).withColumn("width", F.least(F.lit(WIDTH), F.col("length")))
    rows = rows.withColumn("shingles", _shingles(F.col("parts"), F.col("width")))
    return rows.withColumn("fp", _simhash(F.col("shingles")))


def _seeds(items: DataFrame) -> DataFrame:
    """(width, h, length): which shingle stands in items of which length, however many items share it."""

    def of_width(w: int) -> DataFrame:
        made = F.transform(F.sequence(F.lit(0), F.col("length") - w), lambda i: _shingle_at(F.col("parts"), i, w))
        return items.filter(F.col("width") == w).select(F.lit(w).alias("width"), "length", F.explode(made).alias("h"))

    return reduce(DataFrame.unionAll, map(of_width, range(1, WIDTH + 1))).distinct()


def _starts(hits: DataFrame, similarity: float) -> DataFrame:
    """(row, start, length, width) of the windows that can reach the similarity; hits are (row, n, width, length, pos) with n words in the row.

    A window of b shingles and an item of a with c in common have the similarity c / (a + b - c), so c must be at least
    similarity * (a + b) / (1 + similarity). The places of a window at which any item of the length has the shingle bound c from above.
    """
    own = F.least(F.col("n"), F.col("length"))
    rows = hits.groupBy("row", "n", "width", "length").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    rows = rows.withColumn("own", F.greatest(F.lit(1), own - F.col("width") + 1)).withColumn("last", F.col("n") - own)
    of_item = F.col("length") - F.col("width") + 1
    # a hair less: rounding must not lose a window that just reaches it
    rows = rows.withColumn("need", F.greatest(F.lit(1), F.ceil((of_item + F.col("own")) * similarity / (1 + similarity) - 1e-9).cast("int")))

    def full(p: Column, i: Column) -> Column:
        return (p < F.col("last")) & (F.get(F.col("at"), i + F.col("need") - 1) < p + F.col("own"))

    at_end = F.get(F.col("at"), F.size("at") - F.col("need")) >= F.col("last")
    starts = F.concat(F.filter("at", full), F.when(at_end, F.array("last")).otherwise(F.array().cast("array<int>")))
    return rows.select("row", F.explode(starts).alias("start"), "length", "width")


def _touched(docs: DataFrame, seeds: DataFrame, set_bound: int) -> DataFrame:
    """(row, id, parts, hits) of documents that share a shingle with an item; hits are (pos, width, h).

    Up to ``set_bound`` distinct shingles go to the tasks as a set; beyond it shingles of documents are joined with those of items. Both
    give the same rows.
    """
    distinct = seeds.select("width", "h").distinct()
    known = [tuple(r) for r in distinct.limit(set_bound + 1).collect()]
    widths = sorted({w for w, _ in known}) if len(known) <= set_bound else range(1, WIDTH + 1)

    def all_of(parts: Column, width: int) -> Column:
        places = F.when(F.size(parts) >= width, F.sequence(F.lit(0), F.size(parts) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("width"), _shingle_at(parts, i, width).alias("h")))

    def in_items(rows: Column, hashes: list[int]) -> Column:
        return F.filter(rows, lambda x: x["h"].isin(hashes))

    def hits(parts: Column) -> Column:
        found = [in_items(all_of(parts, w), [h for v, h in known if v == w]) for w in widths]
        return F.concat(*found) if found else F.array().cast("array<struct<pos:int,width:int,h:bigint>>")

    lowered = words(ascii_lower(F.col("text")))
    if len(known) <= set_bound:
        made = docs.select("row", "id", once(lowered, lambda parts: F.struct(parts.alias("parts"), hits(parts).alias("hits"))).alias("found"))
        return written(made.filter(F.size("found.hits") > 0).select("row", "id", "found.parts", "found.hits"), "touched")
    rows = docs.select("row", F.explode_outer(once(lowered, lambda parts: F.concat(*(all_of(parts, w) for w in widths)))).alias("x"))
    found = rows.select("row", "x.*").join(distinct, ["width", "h"]).distinct()
    grouped = found.groupBy("row").agg(F.collect_list(F.struct("pos", "width", "h")).alias("hits"))
    return written(docs.join(grouped, "row").select("row", "id", lowered.alias("parts"), "hits").dropDuplicates(["row", "id"]), "touched")


def leaks(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, radius: int = 22, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", set_bound: int = SET_BOUND,
) -> DataFrame:
    """(row, id, item_id, start, n_words, similarity): the best window of each document that is similar enough to an item.

    Words are lowered A-Z; shingles take five words, or all of a shorter item. A window has the item's length, or what the document has of
    it, and starts at word ``start``. ``row`` is a hash of id and text. ``radius`` is 22 of 64 bits: at a similarity of 0.8 fingerprints
    differ by 10 in the mean, by more than 22 in some 4 of 100,000 cases. Null and blank texts, of documents or items, match nothing; rows that repeat
    an id and its text give one; ids may be null. Ties go to the first window laid. Other columns are not read.
    """
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).withColumn("row", F.xxhash64("id", "text"))
    known = written(_items(items, item_col, item_text_col), "items")
    seeds = _seeds(known)
    touched = _touched(source, seeds, set_bound).dropDuplicates(["row"])
    hits = touched.select("row", F.size("parts").alias("n"), F.explode("hits").alias("x")).select("row", "n", "x.*")
    starts = _starts(hits.join(seeds, ["width", "h"]), similarity)
    windows = starts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "width")).alias("windows"))
    # one window a row before its words are cut out
    laid = touched.join(windows, "row").select("row", "id", "parts", F.explode("windows").alias("w")).select("row", "id", "parts", "w.*")
    laid = laid.withColumn("parts", F.slice(F.col("parts"), F.col("start") + 1, F.col("length")))
    laid = laid.select("row", "id", "start", "length", "width", F.size("parts").alias("n_words"), _shingles(F.col("parts"), F.col("width")).alias("own"))
    laid = written(laid.withColumn("own_fp", _simhash(F.col("own"))), "windows")
    keys = laid.select("row", "start", "length", "own_fp", F.explode(_block_keys(F.col("own_fp"), radius)).alias("key"))
    index = known.select("item_id", "length", "fp", F.explode(_block_keys(F.col("fp"), radius)).alias("key"))
    near = keys.join(index, ["length", "key"]).filter(F.bit_count(F.col("own_fp").bitwiseXOR(F.col("fp"))) <= radius)
    near = near.select("row", "start", "length", "item_id").distinct()
    compared = near.join(laid, ["row", "start", "length"]).join(known.select("item_id", "shingles"), "item_id")
    scored = compared.withColumn("similarity", _weighted_jaccard(F.col("own"), F.col("shingles"))).filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy("row", "id", "item_id").agg(best.alias("best")).select("row", "id", "item_id", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of ``docs`` that hold no window similar to an item."""
    found = leaks(docs, items, id_col=id_col, text_col=text_col, **options).select("row").distinct()
    own = F.xxhash64(docs[id_col], docs[text_col].cast("string"))
    return docs.join(found, own == found["row"], "left_anti")
