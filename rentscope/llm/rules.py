"""Quality rules: decision lists learned by sequential covering from labelled text statistics.

A rule is a conjunction of thresholds. It is grown on two thirds of the labelled sample, one condition at a time, by information gain, and
pruned on the other third; what a rule covers is taken out before the next is grown. The list comes out as one ordered Spark
conditional expression. Learning needs only counts by statistic, bin and label, which Spark makes from binned rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import words, written
from rentscope.operators.scale import once

#: Labelled rows that a list is learned from, at most about this many, taken by the id's hash.
SAMPLE_ROWS = 50_000
BINS = 24
STATISTICS = ("n_words", "mean_word", "symbol_share", "upper_share", "dup_line_share", "repeat_share", "mean_line")


# ---- statistics of a text ----


def _repeat_words(ws: Column) -> Column:
    """Words in three-word windows that occur twice or more, first ones included.

    A window's hash and place share one long, so a plain sort brings equal windows together; neighbours are then compared word by word.
    """
    n = F.size(ws)
    shift = F.length(F.bin(n))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        hashes = F.call_function("shiftright", x, shift) == F.call_function("shiftright", y, shift)
        i, j = place(x), place(y)
        return hashes & (F.get(ws, i) == F.get(ws, j)) & (F.get(ws, i + 1) == F.get(ws, j + 1)) & (F.get(ws, i + 2) == F.get(ws, j + 2))

    def window(i: Column) -> Column:
        h = F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
        return F.call_function("shiftleft", h, shift).bitwiseOR(i.cast("long"))

    def repeated(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before, after = F.get(ordered, k - 1), F.get(ordered, k + 1)
            return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

        return F.flatten(F.transform(F.filter(ordered, twin), lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))

    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))
    return F.when(n < 3, F.lit(0)).otherwise(F.size(F.array_distinct(once(ordered, repeated))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines), all counts long, of every row.

    Null and blank texts count zero of everything. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).alias("n_words"), F.length(F.array_join(ws, "")).alias("word_chars"), _repeat_words(ws).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))

    rows = docs.select(
        F.col(id_col).alias("id"), once(words(text), of_words).alias("w"), once(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("n_symbols"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("n_upper"),
    )
    counts = ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "n_upper", "l.n_lines")
    return rows.select("id", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in counts))


def shares(counts: DataFrame) -> list[Column]:
    """The columns STATISTICS, doubles that don't grow with the text but for ``n_words``."""

    def per(a: str, b: str) -> Column:
        return (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")

    made = (
        F.col("n_words").cast("double"), per("word_chars", "n_words"), per("n_symbols", "word_chars"), per("n_upper", "word_chars"),
        per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_words", "n_lines"),
    )
    return [c.alias(name) for c, name in zip(made, STATISTICS, strict=True)]


# ---- learning ----


@dataclass(frozen=True)
class Condition:
    """``statistic`` is at least the cut (``above``) or below it; ``bin`` is the cut's number."""

    statistic: str
    above: bool
    bin: int
    cut: float

    def binned(self) -> Column:
        return F.col(self.statistic) >= self.bin if self.above else F.col(self.statistic) < self.bin

    def column(self) -> Column:
        return F.col(self.statistic) >= self.cut if self.above else F.col(self.statistic) < self.cut


Rule = tuple[Condition, ...]


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _binned(sample: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Labelled rows as bins of each statistic (bin b: b cuts are at most the value), equal rows counted; and the cuts.

    Cuts are quantiles of the bad rows, quantiles of the good ones, and the least value over zero.
    """
    at = [k / BINS for k in range(1, BINS)] + [0.002, 0.01, 0.99, 0.998]
    of_bad = [F.percentile_approx(F.when(F.col("bad") == bad, F.col(s)), at, 10_000).alias(f"{s}_{bad}") for s in STATISTICS for bad in (True, False)]
    row = sample.agg(*of_bad, *(F.min(F.when(F.col(s) > 0, F.col(s))).alias(s) for s in STATISTICS)).first()
    cuts = {s: sorted({x for x in (*(row[f"{s}_True"] or ()), *(row[f"{s}_False"] or ()), row[s]) if x is not None}) for s in STATISTICS}

    def number(s: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[s])).cast("array<double>"), lambda c: c <= F.col(s)))

    bins = sample.select("bad", "prune", *(number(s).alias(s) for s in STATISTICS))
    return bins.groupBy("bad", "prune", *STATISTICS).agg(F.count("*").alias("n")), cuts


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], least: int) -> tuple[Condition | None, int]:
    """The condition of the highest gain among rows, and how many good rows it still covers."""
    stacked = rows.select("bad", "n", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in STATISTICS))).alias("x"))
    counts: dict[str, dict[tuple[int, bool], int]] = {s: {} for s in STATISTICS}
    for r in stacked.groupBy("x", "bad").agg(F.sum("n").alias("n")).collect():
        counts[r["x"]["s"]][r["x"]["b"], r["bad"]] = r["n"]
    best, top, left = None, 0.0, 0
    for s in STATISTICS:
        p0 = sum(v for (_, bad), v in counts[s].items() if bad)
        n0 = sum(v for (_, bad), v in counts[s].items() if not bad)
        below = [0, 0]
        for b, cut in enumerate(cuts[s], start=1):
            below[0] += counts[s].get((b - 1, True), 0)
            below[1] += counts[s].get((b - 1, False), 0)
            for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                if p >= least and (gain := _gain(p, n, p0, n0)) > top + 1e-9:
                    best, top, left = Condition(s, above, b, cut), gain, n
    return best, left


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The rule cut to the length that does best on the pruning rows, its precision there and the bad rows it covers."""
    steps = [_all([c.binned() for c in rule[: k + 1]]) for k in range(len(rule))]
    sums = rows.agg(*(F.sum(F.when(step & (F.col("bad") == bad), F.col("n"))).alias(f"c{k}_{bad}") for k, step in enumerate(steps) for bad in (True, False))).first()
    scored = []
    for k in range(len(rule)):
        p, n = sums[f"c{k}_True"] or 0, sums[f"c{k}_False"] or 0
        scored.append(((p - n) / (p + n) if p + n else -1.0, -k, p / (p + n) if p + n else 0.0, p))
    worth, minus_k, precision, p = max(scored)
    return rule[: 1 - minus_k], precision, p


def learn(sample: DataFrame, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered rules for bad rows, from a bounded sample with ``bad`` and ``prune`` booleans and the columns STATISTICS.

    Growing ends when no good row is covered or no condition gains; learning ends with the first rule that covers
    fewer than ``least`` bad rows or is below ``precision`` on the pruning rows. No rows, or one label alone, give no rule.
    """
    cells, cuts = _binned(sample)
    left = written(cells, "rule-cells")
    rules: list[Rule] = []
    while True:  # each rule takes ``least`` bad rows or more from those that are left
        uncovered = left.filter(~_any([_all([c.binned() for c in r]) for r in rules]))
        rule: Rule = ()
        while True:  # each condition leaves fewer rows
            best, good = _best_condition(uncovered.filter(~F.col("prune") & _all([c.binned() for c in rule])), cuts, least)
            if best is None:
                break
            rule = (*rule, best)
            if not good:
                break
        if not rule:
            break
        rule, reached, covered = _pruned(uncovered.filter("prune"), rule)
        if reached < precision or covered < least:
            break
        rules.append(rule)
    return rules


def labelled(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """A sample of about SAMPLE_ROWS labelled rows at most (by id hash), ``bad`` where the label is 0. Null labels and ids teach nothing."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20))
    joined = counts.join(known.filter(place < int(share * (1 << 20))), "id")
    return joined.select((F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(3)) == 0).alias("prune"), *shares(counts))


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over STATISTICS: the number of the first rule that holds, null if none does."""
    out = F.when(F.lit(False), F.lit(-1))
    for k, rule in enumerate(rules):
        out = out.when(_all([c.column() for c in rule]), F.lit(k))
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row of ``docs`` with ``base_failed``, ``rule`` (the rule that drops it, or null) and ``kept``.

    The base fails texts of under 50 words, or with over half of the words in repeated windows.
    """
    counts = written(statistics(docs, id_col, text_col), "text-statistics")
    rules = learn(labelled(counts, labels, id_col))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = counts.select("*", *shares(counts)[1:]).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
