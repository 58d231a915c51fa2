"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text tells how far a text can be followed before it leaves what the language has
shown; the text is cut greedily into such longest matches, and the language that needs the fewest phrases a letter wins. Many
chunks of texts are parsed in step, against all languages at once: a transition is one table lookup.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentscope.llm.words import release_memory, texts_of

#: Bound of the labelled sample: documents a language, and characters of each.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 100
CHUNK = 256
#: Phrases of five symbols are no sign of a strange text, however uniform the labelled text is.
LEAST_RATE = 0.2
NONE = "und"


# ---- alphabet ----

SYMBOLS = 64
PLAIN = 1 << 16


def _symbol_table() -> np.ndarray:
    """Symbol of every code point below 65,536: 0 for what is not a letter, 1-26 for a-z in either case, else one of 27-63.

    Letters outside a-z are dealt by their lower-case code point, so each letter of a Latin alphabet keeps a symbol of its own and
    larger scripts share symbols.
    """
    table = np.zeros(PLAIN, np.uint8)
    for code in range(PLAIN):
        char = chr(code)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbols of a text, runs of what is no letter as one 0, with a 0 at both ends; empty if it has no letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = TABLE[np.minimum(code, PLAIN - 1)]
    beyond = np.nonzero(code >= PLAIN)[0]
    if len(beyond):
        found[beyond] = [27 + c % (SYMBOLS - 27) if chr(c).isalpha() else 0 for c in code[beyond].tolist()]
    if not found.any():
        return found[:0]
    padded = np.zeros(len(found) + 2, np.uint8)
    padded[1:-1] = found
    return padded[np.r_[True, (padded[1:] != 0) | (padded[:-1] != 0)]]


# ---- suffix automata ----


def automaton(sample: np.ndarray) -> np.ndarray:
    """Transitions (states, symbols) of the suffix automaton of a symbol string; -1 where there is none. State 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample.tolist():
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = state
    table = np.full((len(moves), SYMBOLS), -1, np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            table[state, c] = to
    return table


def parser(samples: dict[str, list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, starts, steps): one table for all languages.

    ``steps[start + state * SYMBOLS + symbol]`` is 4 * (start + next state * SYMBOLS) plus the number of phrase ends: 1 before a symbol
    that can't follow; a symbol the language has never shown is a phrase of its own, with an end behind it too.
    """
    languages = sorted(samples)
    automata = [automaton(np.concatenate([np.zeros(1, np.uint8), *map(symbols, samples[n])])) for n in languages]
    starts = np.cumsum([0, *(a.size for a in automata)])
    steps = np.empty(starts[-1], np.int32 if 4 * starts[-1] < 2**31 else np.int64)
    for i, start in enumerate(starts[:-1].tolist()):
        moves, automata[i] = automata[i], None  # one at a time: a table is large beside the text it comes from
        stuck, unknown = moves < 0, moves[0] < 0
        to = steps[start : start + moves.size].reshape(moves.shape)
        np.copyto(to, np.where(stuck, np.maximum(moves[0], 0), moves))
        to *= SYMBOLS
        to += start
        to *= 4
        to += stuck
        to += stuck & unknown
        to[0] -= unknown  # nothing ends before the first symbol
    return languages, starts[:-1].astype(np.int64), steps


def phrases(texts: list[np.ndarray], starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(texts, languages) number of phrases of each text. Texts are parsed in chunks of ``CHUNK`` symbols, each from the start."""
    owner, pieces = [], []
    for k, t in enumerate(texts):
        for at in range(0, len(t), CHUNK):
            owner.append(k)
            pieces.append(t[at : at + CHUNK])
    counts = np.zeros((len(texts), len(starts)), np.int64)
    if not pieces:
        return counts
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((CHUNK, len(pieces)), np.uint8)
    for column, k in enumerate(order.tolist()):
        grid[: sizes[k], column] = pieces[k]
    state = np.repeat(starts[:, None], len(pieces), axis=1).astype(steps.dtype)
    ended = np.zeros(state.shape, np.int32)
    active = np.searchsorted(-sizes[order], -np.arange(CHUNK), side="left")  # chunks longer than t
    for t in range(int(sizes.max())):
        n = int(active[t])
        move = steps.take(state[:, :n] + grid[t, :n])
        ended[:, :n] += move & 3
        state[:, :n] = move >> 2
    np.add.at(counts, np.array(owner)[order], (ended + 1).T)
    return counts


# ---- operator ----


def samples(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, list[str]]:
    """Bounded labelled sample: a slice from the middle of the texts with the lowest id hashes, SAMPLE_DOCS a language.

    Only rows with a language and at least one letter count. The languages' sizes, one row each, say which hashes may be among the lowest: about
    eight times the sample. All others go before anything is shuffled, so what a language's rank sees doesn't grow with the corpus.
    """
    text = F.col(text_col)
    middle = F.greatest(F.lit(1), (F.length(text) / 2).cast("int") - SAMPLE_CHARS // 2)
    labelled = docs.filter(F.col(lang_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 8 * SAMPLE_DOCS / r["n"])]), F.col("lang"))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 40))
    rows = labelled.select(F.col(lang_col).alias("lang"), text.alias("text"), place.alias("place"), middle.alias("middle"))
    rows = rows.filter(F.col("place") < share * (1 << 40)).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "place", F.substring("text", F.col("middle"), F.lit(SAMPLE_CHARS)).alias("slice"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place", "slice"))).filter(F.col("n") <= SAMPLE_DOCS)
    out: dict[str, list[str]] = {}
    for row in ranked.select("lang", "slice", "n").orderBy("lang", "n").collect():
        out.setdefault(row["lang"], []).append(row["slice"])
    return out


def predict(docs: DataFrame, learned: dict[str, list[str]], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with ``lang_pred`` and ``score`` (these replace columns of the same names).

    Score is 1 - phrases of the winner / phrases of the second, between 0 and 1; with one language it is 1. A text that is null or has no
    letter is ``und`` with score 0, as are all if nothing was learned. Languages that need equally many phrases win by name.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    # a kept text travels to the tasks once
    name = text_col if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else "__text"
    source = docs.select(*keep) if name in keep else docs.select(*keep, F.col(text_col).cast("string").alias(name))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    table = source.sparkSession.sparkContext.broadcast(parser(learned))
    release_memory()  # the table has gone to a file; a driver needs its memory for what comes next

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, starts, steps = table.value
        for part, made, counts in _parsed(batches, name, starts, steps):
            names, scores = [], []
            for t, row in zip(made, counts, strict=True):
                if not len(t) or not languages:
                    names.append(NONE)
                    scores.append(0.0)
                    continue
                best, *others = np.argsort(row, kind="stable").tolist()
                names.append(languages[best])
                scores.append(1 - float(row[best]) / float(row[others[0]]) if others else 1.0)
            columns = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        release_memory()

    return source.mapInArrow(run, schema)


def _parsed(batches: Iterable[pa.RecordBatch], name: str, starts: np.ndarray, steps: np.ndarray) -> Iterator[tuple]:
    """(rows, symbols of each text, phrases of each text and language) in runs of bounded size."""
    for batch in batches:
        at = 0
        for (texts,) in texts_of([batch], name):
            made = [symbols(t.decode()) if t else np.empty(0, np.uint8) for t in texts]
            yield batch.slice(at, len(texts)), made, phrases(made, starts, steps)
            at += len(texts)


def usual_rates(learned: dict[str, list[str]], quantile: float = 0.9) -> dict[str, float]:
    """Phrases a symbol that text of each language usually needs at most: every second slice, parsed by the others.

    Slices are taken once each, as copies say nothing about other text, and a rate is no less than ``LEAST_RATE``. A language with one slice has no
    measure: its rate is infinite.
    """
    distinct = {n: [t for t in dict.fromkeys(slices) if len(symbols(t))] for n, slices in learned.items()}
    out = dict.fromkeys(learned, float("inf"))
    tested = {n: slices for n, slices in distinct.items() if len(slices) > 1}
    languages, starts, steps = parser({n: slices[::2] for n, slices in tested.items()})
    for k, n in enumerate(languages):
        made = [symbols(t) for t in tested[n][1::2]]
        rates = phrases(made, starts, steps)[:, k] / np.array([len(m) for m in made])
        out[n] = max(LEAST_RATE, float(np.quantile(rates, quantile)))
    return out


def in_known_language(docs: DataFrame, learned: dict[str, list[str]], text_col: str = "text", slack: float = 2.0, allowance: int = 3) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text reads as one of the learned languages.

    A text is rejected if in every language its parse needs more than ``slack`` times the usual phrases a symbol (see ``usual_rates``), and
    ``allowance`` phrases more, so that a few names or a short text prove nothing: keyboard junk, encoded data, other scripts. Null texts and texts
    without a letter are rejected. If nothing was learned, only these are. Rows that repeat fare alike.
    """
    is_text = docs.schema[text_col].dataType.simpleString() == "string"
    name = text_col if is_text else "__text"
    source = docs if is_text else docs.select("*", F.col(text_col).cast("string").alias(name))
    rates = usual_rates(learned)
    limits = np.array([slack * rates[n] for n in sorted(rates)])
    table = source.sparkSession.sparkContext.broadcast(parser(learned))
    release_memory()
    kept = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, steps = table.value
        for part, made, counts in _parsed(batches, name, starts, steps):
            sizes = np.array([len(m) for m in made])
            reads = (counts <= sizes[:, None] * limits + allowance).any(axis=1) if len(limits) else np.ones(len(made), bool)
            yield part.select(kept).filter(pa.array((sizes > 0) & reads))
        release_memory()

    return source.mapInArrow(run, docs.schema)


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """True for one document of five, by the crc32 of the id's text; such documents teach nothing. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def accepted(predicted: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows with a language, predicted with a score of at least ``least``; those without a letter go."""
    return predicted.filter((F.col("lang_pred") != NONE) & (F.col("score") >= least))
