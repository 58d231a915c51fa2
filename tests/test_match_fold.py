"""The fold behind ``match_plans``: its work per row does not grow with the plans a run has made."""

import random
import time

from rentscope.operators import merge as G


def by_rule(rows):
    """The rule with everything made so far looked through for each row."""
    made, out = [], []
    for e in rows:
        if e["id"] is not None:
            made.append((None, e["id"], None, e["size"]))
            continue
        near = [m for m in made if e["probe"] is not None and abs(m[3] - e["probe"]) <= 5]
        known = [m[0] for m in made if m[2] is not None and m[2] == e["name"]]
        known += [e["known_at"]] if e["known_at"] is not None and e["known_at"] < e["pos"] else []
        if known:
            tier, plan, made_by = 1, None, min(known)
        elif e["near_n"] + len(near) == 1:
            tier, plan, made_by = 3, *((e["near_id"], None) if e["near_n"] == 1 else (near[0][1], near[0][0]))
        else:
            tier, plan, made_by = 4, None, e["pos"]
            made.append((e["pos"], None, e["makes"], e["size"]))
        out.append((e["pos"], e["name"], e["makes"], tier, plan, made_by))
    return out


def row(rng, pos, names, spread):
    name, size = rng.choice(names), rng.choice([None, rng.randrange(spread) / 2])
    near_n = rng.choice([0, 0, 0, 1, 2])
    return {"pos": pos, "id": rng.choice([None] * 9 + [900 + pos]), "name": name, "makes": name or "Unit", "size": size or 0.0, "probe": size,
            "near_n": near_n, "near_id": 500 + pos if near_n else None, "known_at": rng.choice([None] * 6 + [rng.randrange(200)])}


def test_run_follows_the_rule():
    rng, tiers = random.Random(8), set()
    for trial in range(60):
        names = [None, "", "Unit", *[f"K{i}" for i in range(rng.choice([3, 200]))]]
        rows = [row(rng, pos // 2 if trial % 2 else pos, names, rng.choice([40, 4000])) for pos in range(150)]
        run = G._Run()
        got = [p for p in map(run.placed, rows) if p]
        assert got == by_rule(rows)
        tiers |= {p[3] for p in got}
    assert tiers == {1, 3, 4}


def test_run_is_linear():
    run, start = G._Run(), time.process_time()
    for pos in range(60_000):
        run.placed({"pos": pos, "id": None, "name": f"N{pos}", "makes": f"N{pos}", "size": float(pos % 190), "probe": float(pos % 190), "near_n": 2, "near_id": 1,
                    "known_at": None})
    assert time.process_time() - start < 10 and sum(map(len, run.of_size.values())) == 2 * 190
