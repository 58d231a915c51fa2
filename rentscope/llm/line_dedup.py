"""Line dedup: repeated runs of lines from a suffix array over line ids, by distributed prefix doubling.

Lines that occur once end every run, so only lines that occur again take part; they form segments of neighbouring lines. A suffix is
known by the id of its first line (two 64-bit hashes) and its rank among the suffixes that start with that line; ids order the
array's buckets, ranks order each bucket. A doubling step sorts suffixes of equal rank by the rank of the suffix 2**k lines on: each one's
new rank is its old one plus the number of equals that come before, so no global sort is needed.

Suffixes whose ranks agree on a window are one interval of the longest-common-prefix array. Deleted is the whole common prefix with an earlier
place wherever it holds a least number of characters. Such a maximal run is the union of its windows from the shortest one that holds
the least number of characters up to the one whose rest, without its first line, does so for the first time: a longer window is
covered by the windows from its next line on, which an earlier place has too. A line that is not blank has one character at least, so no
window is longer than the least number of characters, which bounds the depth of the doubling whatever the length of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentscope.llm.words import BLANKS, written

NEVER = -1


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_rows(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: its document, place, place among these lines, size and id."""

    def line(raw, pos):
        trimmed = F.btrim(raw, F.lit(BLANKS))
        return F.struct(
            pos.alias("pos"), F.length(trimmed).alias("size"), F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b")
        )

    found = F.filter(F.transform(_lines(F.col("text")), line), lambda x: x["size"] > 0)
    rows = docs.select("row", "id", F.posexplode(found).alias("ord", "line"))
    return rows.select("row", "id", "ord", "line.*")


def _suffixes(lines: DataFrame, min_chars: int) -> DataFrame:
    """Lines that occur again, by segments, with the windows to compare from here on: ``need`` lines, the fewest that hold ``min_chars``
    characters (null if all that follow don't), up to ``upto`` lines, the most whose last ones are not in a window from the next line on."""
    again = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    rows = lines.join(again, ["a", "b"])
    by_row = Window.partitionBy("row", "id").orderBy("ord")
    # rows that repeat a document whole share its places: they are one document here
    rows = rows.dropDuplicates(["row", "id", "ord"]).withColumn("segment", F.col("ord") - F.row_number().over(by_row))
    ahead = Window.partitionBy("row", "id", "segment").orderBy("ord")
    sizes = F.collect_list("size").over(ahead.rowsBetween(0, min_chars - 1))
    sums = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda x, y: x + y))
    need = F.array_position(F.transform(sums, lambda s: s >= min_chars), True)
    own = F.when(F.col("size") >= min_chars, F.lit(1)).otherwise(need).cast("int")
    rows = rows.withColumn("need", F.nullif(own, F.lit(0)))
    rest = F.count("*").over(ahead.rowsBetween(0, min_chars)).cast("int")
    upto = F.greatest("need", F.coalesce(F.lead("need").over(ahead), rest))
    return rows.withColumn("upto", F.when(F.col("need").isNotNull(), upto)).withColumn("r0", F.lit(0).cast("long"))


def _doubled(rows: DataFrame, k: int) -> DataFrame:
    """Adds rank r(k+1), by the first 2**(k+1) lines. Pairs are counted before they are shuffled, whatever the size of a bucket."""
    ahead = Window.partitionBy("row", "id", "segment").orderBy("ord")
    second = [F.lead(c, 2**k).over(ahead).alias(f"next_{c}") for c in ("a", "b", f"r{k}")]
    rows = rows.select("*", *second).fillna(NEVER, [f"next_{c}" for c in ("a", "b", f"r{k}")])
    first, after = ["a", "b", f"r{k}"], ["next_a", "next_b", f"next_r{k}"]
    counts = rows.groupBy(*first, *after).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*first).orderBy(*after).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(f"r{k + 1}", F.col(f"r{k}") + F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(ranks, [*first, *after]).drop(*after)


def _later_runs(rows: DataFrame, levels: int) -> DataFrame:
    """(row, id, ord, length) of windows that an earlier place has too."""
    ranks = [f"r{k}" for k in range(levels + 1)]
    ahead = Window.partitionBy("row", "id", "segment").orderBy("ord").rowsBetween(0, 2**levels - 1)
    places = F.collect_list(F.struct("a", "b", *ranks)).over(ahead)
    # a window of any length is two windows of the power of two below it, from its start and up to its end
    level = F.length(F.bin("length")) - 1
    other = F.get(F.col("places"), F.col("length") - F.pow(F.lit(2), F.col("level")).cast("int"))
    rank = lambda of: F.get(F.array(*(of[r] for r in ranks)), F.col("level"))
    keyed = rows.withColumn("places", places).filter("need IS NOT NULL").withColumn("length", F.explode(F.sequence("need", "upto")))
    keyed = keyed.withColumn("level", level).withColumn("other", other)
    keyed = keyed.withColumn("own", F.struct(*ranks)).select(
        "row", "id", "ord", "length", "a", "b", rank(F.col("own")).alias("rank"), F.col("other.a").alias("end_a"), F.col("other.b").alias("end_b"),
        rank(F.col("other")).alias("end_rank"), F.struct("id", "row", "ord").alias("place"),
    )
    interval = ["length", "a", "b", "rank", "end_a", "end_b", "end_rank"]
    firsts = keyed.groupBy(*interval).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(firsts, interval).filter("place > first").select("row", "id", "ord", "length")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with later copies of repeated line runs deleted from the text, plus ``removed_lines``.

    A run is the longest one of consecutive lines from a line on that occur in the same order at an earlier place: in a document of a
    smaller id (null first; equal ids by a hash of the text) or further up in the same one; it is deleted if it holds ``min_chars``
    characters or more. Lines are compared without white space at their ends; blank lines are passed over and never deleted. ``removed_lines`` are the deleted places, counted from 0.
    Null and empty texts stay as they are. Rows that repeat id and text come out alike. ``removed_lines`` replaces a column of that name.
    """
    own = [c for c in docs.columns if c != "removed_lines"]
    source = docs.select(F.struct(*own).alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    source = source.withColumn("row", F.xxhash64("id", "text"))
    rows = written(_suffixes(_line_rows(source.select("row", "id", "text")), min_chars), "line-suffixes")
    longest = rows.agg(F.max("upto")).first()[0] or 1
    levels = longest.bit_length() - 1
    for k in range(levels):
        rows = written(_doubled(rows, k), "line-ranks")
    covered = _later_runs(rows, levels).select("row", F.explode(F.sequence(F.col("ord"), F.col("ord") + F.col("length") - 1)).alias("ord"))
    places = rows.select("row", "ord", "pos").distinct()
    removed = covered.distinct().join(places, ["row", "ord"]).groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    removed = removed.withColumnRenamed("row", "of")
    out = source.join(removed, F.col("row") == F.col("of"), "left")
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    shorter = F.array_join(F.get(F.transform(F.array(lines), lambda all_: F.transform(kept, lambda i: F.get(all_, i))), F.lit(0)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(shorter)
    return out.select(
        *(text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in own),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
    )
