"""Cheapest repair of conversations, by a cost DP and a prefix-doubling ranking of the paths that reach its cost.

A conversation is to become ``(s?(ua)+)?`` in role initials: an optional opening by system, then user and assistant in turn, or nothing.
Rows are kept (K, 0), given the role user or assistant (R, 2) or deleted (D, 3: what blank rows and repeats must be), and empty user or
assistant rows are inserted anywhere (I, 2); a cut-off row that stays costs 1 more. Among the cheapest edits those win whose initials, in
order (the audit), come first in ASCII.

Only light rows (keys, roles, digests of texts) are ranged over the cluster, by conversation and turn, and cut into segments of one Arrow
batch at most. A segment is a min-plus matrix over the four states of the pattern. For the few conversations in more than one segment
the matrices are folded from the end, so each segment knows what its exits cost; then it is solved for each state it can be
entered in, and the segments are threaded from the front. Inside a segment each (row, state) is a node. Nodes are ranked by the
first letter of their optimal arcs, then by the first 2, 4, 8 ... letters: the rank of a node and that of the node its doubled pointer leads to make the
next rank. The ranks select one arc of each node, and doubled pointers lead to every place of the audit at once.

Texts are shuffled once, to be hashed. SHA-256 runs through a conversation from its first to its last byte, so one task reads a conversation's
texts, as a stream: it holds one batch, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import BLANKS, written

# states: nothing yet, after the opening, after a user row, after an assistant row
NEXT = np.array([2, 2, 3, 2])  # where an inserted or reroled row leads: its role is user, after a user row assistant
AT_END = np.array([0, 4, 2, 0])  # what it costs to end in a state
TRAILING = ("", "II", "I", "")
TRAILING_ROLES = ("", "ua", "a", "")
FAR = 1 << 50
BOUND = 1 << 20
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = np.frombuffer(b" DIKR", np.uint8)
INITIALS = "sua"
ROLES = {"u": "user", "a": "assistant"}

# a layer's code: 0 must go, else 1 + 4 * cut-off + place of its initial in INITIALS (3: any other)
KEPT_TO = np.full((9, 4), -1)
for _cut in (0, 4):
    KEPT_TO[1 + _cut, 0] = 1
    KEPT_TO[2 + _cut, [0, 1, 3]] = 2
    KEPT_TO[3 + _cut, 2] = 3
CUT = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1])
LEGAL = {(0, 1), (1, 2), (2, 1)}

SEGMENT = (
    "c string, seg long, codes binary, weights array<long>, elements array<int>, turns array<long>, roles array<string>, digests binary, matrix array<long>, "
    "head int, tail int, blank long, duplicate long, truncated long, illegal long"
)
ACTS = "acts array<struct<t:long,role:string,digest:binary,before:string,becomes:string>>"
SOLVED = f"c string, seg long, entry int, exit int, open boolean, cost long, audit string, head int, tail int, blank long, duplicate long, truncated long, illegal long, {ACTS}"


def key_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text), nulls of role and text as one space, after the damage that their conversation and turn call for,
    with ``copies``: by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20, 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it and 4 makes it the user's."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    lot = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    return rows.filter(lot != 0).select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(lot == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _light(rows: DataFrame) -> DataFrame:
    """One row for all equal rows: key, faults, initial and number of copies; ``again`` where role and text were seen at an earlier turn."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    light = rows.groupBy("c", "t", "role", "digest", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when((initial == 0) | (F.col("role") == ""), 3).otherwise(initial - 1).alias("initial")).agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("t").isNotNull().alias("known"), F.col("t"))
    seen = light.groupBy(F.col("c").alias("c2"), F.col("role").alias("role2"), F.col("digest").alias("digest2")).agg(F.min(place).alias("first"), F.count("*").alias("turns"))
    seen = seen.filter("turns > 1").drop("turns")
    both = light.join(seen, (F.col("c") == F.col("c2")) & (F.col("role") == F.col("role2")) & (F.col("digest") == F.col("digest2")), "left")
    again = F.col("first").isNotNull() & ~(F.col("t").eqNullSafe(F.col("first.t")))
    return both.select("c", "t", "role", "digest", "blank", "cut", "initial", "n", again.alias("again"))


def _values(codes: np.ndarray, weights: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least cost from each layer and state to the end, layers of all segments one after the other, each segment with its exit last."""
    base = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    out = np.empty((int((lengths + 1).sum()), 4), np.int64)
    out[base + lengths] = after
    order = np.argsort(-lengths, kind="stable")
    sizes = -lengths[order]
    for back in range(1, int(lengths.max(initial=0)) + 1):
        s = order[: np.searchsorted(sizes, -back, "right")]
        layer, beyond = first[s] + lengths[s] - back, out[base[s] + lengths[s] - back + 1]
        best = np.minimum.reduce([cost for _, cost in _arcs(codes[layer], weights[layer], beyond)])
        for _ in range(2):
            best = np.minimum(best, 2 + best[:, NEXT])
        out[base[s] + lengths[s] - back] = best
    return out


def _arcs(codes: np.ndarray, weights: np.ndarray, beyond: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(state reached, cost to the end) by deleting, keeping and reroling a layer's row, for each layer and state."""
    yield np.broadcast_to(np.arange(4), beyond.shape), 3 * weights[:, None] + beyond
    to = KEPT_TO[codes]
    yield to, np.where(to >= 0, CUT[codes][:, None] + np.take_along_axis(beyond, np.maximum(to, 0), 1), FAR)
    yield np.broadcast_to(NEXT, beyond.shape), np.where(codes[:, None] > 0, 2 + CUT[codes][:, None] + beyond[:, NEXT], FAR)


def ranked(letters: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Letter, target and doubled pointers of the arc that starts each node's least path.

    ``letters`` and ``targets`` are (nodes, arcs); letter BOUND marks no arc. Nodes without an arc end a path. Arcs of one node bear different letters,
    so the least letter leads to one node, and the path of each power of two letters has one pointer.
    """
    here = np.arange(len(letters))
    pick = letters.argmin(axis=1)
    end = letters[here, pick] >= BOUND
    ranks = np.where(end, 0, letters[here, pick])
    pointer = np.where(end, here, targets[here, pick])
    while not end[pointer].all():
        _, ranks = np.unique(ranks * (ranks.max() + 1) + ranks[pointer], return_inverse=True)
        pointer = pointer[pointer]
    _, ranks = np.unique(ranks * (ranks.max() + 1) + ranks[pointer], return_inverse=True)
    pick = np.where(letters >= BOUND, np.iinfo(np.int64).max, letters * len(letters) + ranks[targets]).argmin(axis=1)
    letter, target = np.where(end, 0, letters[here, pick]), np.where(end, here, targets[here, pick])
    pointers = [target]
    while not end[pointers[-1]].all():
        pointers.append(pointers[-1][pointers[-1]])
    return letter, target, pointers


def _solve(codes, weights, lengths, after, owners, entries):
    """For each (segment, state it is entered in): cost, exit state, and (letter, layer, state) of each step of the least path, with its owner."""
    values = _values(codes, weights, lengths, after)
    rows = len(values)
    base = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    exits = np.zeros(rows, bool)
    exits[base + lengths] = True
    layer_rows = np.flatnonzero(~exits)
    letters, targets = np.full((rows, 4, 4), BOUND), np.zeros((rows, 4, 4), np.int64)
    own, beyond = values[layer_rows], values[layer_rows + 1]
    for i, (letter, (to, cost)) in enumerate(zip((DELETE, KEEP, REROLE), _arcs(codes, weights, beyond), strict=True)):
        letters[layer_rows, :, i] = np.where(cost == own, letter, BOUND)
        targets[layer_rows, :, i] = (layer_rows + 1)[:, None] * 4 + np.maximum(to, 0)
    letters[layer_rows, :, 3] = np.where(2 + own[:, NEXT] == own, INSERT, BOUND)
    targets[layer_rows, :, 3] = layer_rows[:, None] * 4 + NEXT
    letter, _, pointers = ranked(letters.reshape(-1, 4), targets.reshape(-1, 4))
    ends = np.repeat(exits, 4)
    start = base[owners] * 4 + entries
    node, steps = start.copy(), np.zeros(len(start), np.int64)
    for k in reversed(range(len(pointers))):
        on = ~ends[pointers[k][node]]
        node, steps = np.where(on, pointers[k][node], node), steps + np.where(on, 1 << k, 0)
    on = ~ends[node]
    node, steps = np.where(on, pointers[0][node], node), steps + on
    who = np.repeat(np.arange(len(start)), steps)
    t = np.arange(len(who)) - np.repeat(np.cumsum(steps) - steps, steps)
    at = start[who]
    for k, pointer in enumerate(pointers):
        at = np.where(t >> k & 1, pointer[at], at)
    layer = np.searchsorted(layer_rows, at // 4)
    return values.reshape(-1)[start], node % 4, who, letter[at], layer, at % 4


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a conversation's rows inside a batch."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        blank, cut, again = (col[c].to_numpy(zero_copy_only=False) for c in ("blank", "cut", "again"))
        initial, n = col["initial"].to_numpy(), col["n"].to_numpy()
        names = col["c"].to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1]
        stops = np.r_[starts[1:], len(names)]
        gone = blank | again
        two = ~gone & (n > 1)  # its first copy, and the others, which must go
        elements = np.repeat(np.arange(len(n)), 1 + two)
        second = np.r_[False, elements[1:] == elements[:-1]]
        codes = np.where(gone[elements] | second, 0, 1 + 4 * cut[elements] + initial[elements]).astype(np.uint8)
        weights = np.where(gone[elements], n[elements], np.where(second, n[elements] - 1, 1))
        cuts = np.searchsorted(elements, np.r_[starts, len(n)])
        joint = np.r_[0, [0 if (a, b) in LEGAL else 1 for a, b in zip(initial[:-1].tolist(), initial[1:].tolist(), strict=True)]].astype(np.int64)
        joint[starts] = 0
        totals = {
            "blank": np.where(blank, n, 0), "duplicate": np.where(blank, 0, np.where(again, n, n - 1)), "truncated": np.where(gone, 0, cut).astype(np.int64), "illegal": n - 1 + joint,
        }
        turns, roles, digests = col["t"].to_pylist(), col["role"].to_pylist(), col["digest"].to_pylist()
        out = []
        for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            x, y = cuts[i], cuts[i + 1]
            matrix = None
            if i in (0, len(starts) - 1):  # only these can go on in another segment
                units = np.where(np.eye(4, dtype=bool), 0, FAR)
                matrix = np.stack([_values(codes[x:y], weights[x:y], np.array([y - x]), unit[None])[0] for unit in units], axis=1).reshape(-1).tolist()
            out.append({
                "c": names[a], "seg": number + i, "codes": codes[x:y].tobytes(), "weights": weights[x:y].tolist(), "elements": (elements[x:y] - a).tolist(), "turns": turns[a:b],
                "roles": roles[a:b], "digests": b"".join(digests[a:b]), "matrix": matrix, "head": int(initial[a]), "tail": int(initial[b - 1]),
                **{k: int(v[a:b].sum()) for k, v in totals.items()},
            })
        number += len(starts)
        yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT_TYPE)


_SEGMENT_TYPE = pa.schema([
    ("c", pa.string()), ("seg", pa.int64()), ("codes", pa.binary()), ("weights", pa.list_(pa.int64())), ("elements", pa.list_(pa.int32())), ("turns", pa.list_(pa.int64())),
    ("roles", pa.list_(pa.string())), ("digests", pa.binary()), ("matrix", pa.list_(pa.int64())), ("head", pa.int32()), ("tail", pa.int32()),
    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
])
_ACT = pa.struct([("t", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("before", pa.string()), ("becomes", pa.string())])
_SOLVED_TYPE = pa.schema([
    ("c", pa.string()), ("seg", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("open", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("head", pa.int32()),
    ("tail", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("acts", pa.list_(_ACT)),
])


def _ends(key, table):
    """What each exit state of a conversation's segments costs, folded from its end."""
    rows = sorted(table.select(["seg", "matrix"]).to_pylist(), key=lambda r: r["seg"])
    after, out = AT_END, []
    for r in reversed(rows):
        out.append((key[0].as_py(), r["seg"], r["seg"] == rows[0]["seg"], after.tolist()))
        after = (np.array(r["matrix"]).reshape(4, 4) + after).min(axis=1)
    return pa.table(list(zip(*out, strict=True)), schema=pa.schema([("c", pa.string()), ("seg", pa.int64()), ("first", pa.bool_()), ("after", pa.list_(pa.int64()))]))


def _thread(key, table):
    """The state in which each segment of a conversation is entered, the illegal pair before it, and whether it is the last."""
    rows = table.to_pylist()
    exits = {(r["seg"], r["entry"]): r["exit"] for r in rows}
    ends = {r["seg"]: (r["head"], r["tail"]) for r in rows}
    state, tail, out = 0, None, []
    for seg in sorted(ends):
        out.append((key[0].as_py(), seg, state, int(tail is not None and (tail, ends[seg][0]) not in LEGAL), seg == max(ends)))
        state, tail = exits[seg, state], ends[seg][1]
    return pa.table(
        list(zip(*out, strict=True)), schema=pa.schema([("c", pa.string()), ("seg", pa.int64()), ("entry", pa.int32()), ("joint", pa.int64()), ("final", pa.bool_())])
    )


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            rows = whole.slice(at, 512).to_pylist()
            codes = np.frombuffer(b"".join(r["codes"] for r in rows), np.uint8).astype(np.int64)
            weights = np.concatenate([np.array(r["weights"], np.int64) for r in rows])
            lengths = np.array([len(r["codes"]) for r in rows])
            after = np.array([r["after"] or AT_END for r in rows])
            asked = [(i, s) for i, r in enumerate(rows) for s in ((0, 1, 2, 3) if r["after"] and not r["first"] else (0,))]
            owners, entries = np.array(asked).T
            cost, exits, who, letter, layer, state = _solve(codes, weights, lengths, after, owners, entries)
            spelt = np.repeat(LETTERS[letter], np.where(letter == DELETE, weights[layer], 1))
            lengths_out = np.bincount(who, np.where(letter == DELETE, weights[layer], 1), len(asked)).astype(np.int64)
            audits = np.r_[0, np.cumsum(lengths_out)]
            first_layer = np.r_[0, np.cumsum(lengths)[:-1]]
            acts: list[list] = [[] for _ in asked]
            ahead, ahead_owner = "", -1
            for o, what, x, s in zip(who.tolist(), letter.tolist(), layer.tolist(), state.tolist(), strict=True):
                if o != ahead_owner:
                    ahead, ahead_owner = "", o
                role = "a" if s == 2 else "u"
                if what == INSERT:
                    ahead += role
                elif what != DELETE:
                    row = rows[owners[o]]
                    e = row["elements"][x - first_layer[owners[o]]]
                    becomes = ROLES[role] if what == REROLE else row["roles"][e]
                    acts[o].append((row["turns"][e], row["roles"][e], row["digests"][32 * e : 32 * e + 32], ahead, becomes))
                    ahead = ""
            out = []
            for o, (i, entry) in enumerate(asked):
                r = rows[i]
                out.append({
                    **{k: r[k] for k in ("c", "seg", "head", "tail", "blank", "duplicate", "truncated", "illegal")}, "entry": entry, "exit": int(exits[o]), "open": r["after"] is not None,
                    "cost": int(cost[o]), "audit": spelt[audits[o] : audits[o + 1]].tobytes().decode(),
                    "acts": [dict(zip(("t", "role", "digest", "before", "becomes"), a, strict=True)) for a in acts[o]],
                })
            yield pa.RecordBatch.from_pylist(out, schema=_SOLVED_TYPE)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's repaired lines, from its decisions and texts in order."""
    done: list[tuple[str, str]] = []
    name, lines, due = None, None, None

    def line(text: str) -> None:
        nonlocal fresh
        lines.update(text.encode() if fresh else b"\n" + text.encode())
        fresh = False

    fresh = True
    for batch in batches:
        for r in batch.to_pylist():
            if r["c"] != name:
                if name is not None:
                    done.append((name, lines.hexdigest()))
                name, lines, due, fresh = r["c"], hashlib.sha256(), None, True
            key = (r["t"], r["role"], r["digest"])
            if r["becomes"] is not None or r["last"]:
                for role in r["before"]:
                    line(f"{ROLES[role]}:")
                due = (key, r["becomes"])
            elif due is not None and due[0] == key:
                line(f"{due[1]}:{r['text']}")
                due = None  # further copies were deleted
        if done:
            yield pa.RecordBatch.from_pylist([{"c": c, "sha": s} for c, s in done], schema=pa.schema([("c", pa.string()), ("sha", pa.string())]))
            done = []
    if name is not None:
        yield pa.RecordBatch.from_pylist([{"c": name, "sha": lines.hexdigest()}], schema=pa.schema([("c", pa.string()), ("sha", pa.string())]))


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``conversations``.

    ``rows`` are (conv_id, turn, role, text, copies). Rows follow each other by turn, nulls first; rows of one turn by role and then by the SHA-256 of
    their text. Equal rows are copies of one row: all but the first are repeats. Null ids are one conversation. An empty or other role fits
    nowhere. A conversation without rows has zeros, an empty audit and the digest of nothing. Other columns are not read.
    """
    keyed = rows.select(
        key_of(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("t"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies"
    )
    light = written(_light(keyed), "conversation-rows")
    order = ("c", "t", "role", "digest")
    segments = written(light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, SEGMENT), "conversation-segments")

    several = segments.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c")
    ends = segments.select("c", "seg", "matrix").join(several, "c").groupBy("c").applyInArrow(_ends, "c string, seg long, first boolean, after array<long>")
    solved = written(segments.drop("matrix").join(ends, ["c", "seg"], "left").mapInArrow(_solved, SOLVED), "conversation-paths")
    threads = solved.filter("open").select("c", "seg", "entry", "exit", "head", "tail").groupBy("c")
    threads = threads.applyInArrow(_thread, "c string, seg long, entry int, joint long, final boolean")
    chosen = solved.filter("open").join(threads, ["c", "seg", "entry"]).unionByName(
        solved.filter("NOT open").withColumn("joint", F.lit(0).cast("long")).withColumn("final", F.lit(True))
    )
    by_exit = lambda names: F.when(F.col("final"), F.element_at(F.array(*map(F.lit, names)), F.col("exit") + 1)).otherwise("")
    chosen = chosen.withColumn("audit", F.concat("audit", by_exit(TRAILING))).withColumn("trailing", by_exit(TRAILING_ROLES))

    totals = chosen.groupBy("c").agg(
        *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("joint")).alias("illegal"), F.min_by("cost", "seg").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    turns = light.groupBy("c", "t").agg(F.lit(1).alias("one")).groupBy("c").agg(
        (F.max("t").cast("decimal(20,0)") - F.min("t") + 1 - F.count("t")).cast("long").alias("gaps")
    )

    acts = chosen.select("c", F.explode("acts").alias("a")).select("c", F.lit(False).alias("last"), "a.t", "a.role", "a.digest", "a.before", "a.becomes", F.lit(None).cast("string").alias("text"))
    nothing = {"t": "long", "role": "string", "digest": "binary", "becomes": "string", "text": "string"}
    tails = chosen.filter("final").select("c", F.lit(True).alias("last"), F.col("trailing").alias("before"), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    texts = keyed.select("c", F.lit(False).alias("last"), "t", "role", "digest", "text", *(F.lit(None).cast("string").alias(n) for n in ("before", "becomes")))
    stream = acts.unionByName(tails).unionByName(texts).repartition("c").sortWithinPartitions("c", "last", "t", "role", "digest", F.col("becomes").isNull())
    hashes = stream.mapInArrow(_hashed, "c string, sha string")

    asked = conversations.select("conv_id").distinct().withColumn("c", key_of(F.col("conv_id")))
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return asked.join(totals, "c", "left").join(turns, "c", "left").join(hashes, "c", "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
