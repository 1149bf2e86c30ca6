"""The stratified bench against a version that goes unit by unit."""

import hashlib
import random

from tidemark.operators.freeze import CLASS_WEIGHT, LEAST_GROUPS, PENALTIES, freeze_stratified
from tidemark.scratch import Scratch


def plain(parents, objects, share):
    count = {}
    for p, name, n in objects:
        if name is not None and n > 0:
            count.setdefault(p, {})[name] = count.get(p, {}).get(name, 0) + n
    batches = {}
    for batch, p, unit, split in parents:
        if batch is not None:
            batches.setdefault(batch, {}).setdefault(unit or str(p), []).append((p, split or "train"))
    out = []
    for batch, units in batches.items():
        if len(units) < LEAST_GROUPS:
            continue
        stats = {}
        for u, members in units.items():
            c = {}
            for p, _ in members:
                for k, n in count.get(p, {}).items():
                    c[k] = c.get(k, 0) + n
            stats[u] = (c, len(members), max(PENALTIES.get(s, max(PENALTIES.values())) for _, s in members))
        names = sorted({k for c, _, _ in stats.values() for k in c})
        want = {k: share * sum(c.get(k, 0) for c, _, _ in stats.values()) for k in names}
        images = share * sum(n for _, n, _ in stats.values())
        off = lambda aim, v: abs(aim - v) / max(aim, 1.0)
        gap = lambda c, n: off(sum(want.values()), sum(c.values())) + off(images, n) + (CLASS_WEIGHT * sum(off(want[k], c.get(k, 0)) for k in names) / len(names) if names else 0)
        got, n, turn = {}, 0, 0
        left = dict(stats)
        while left:
            after = lambda u: ({k: got.get(k, 0) + left[u][0].get(k, 0) for k in names}, n + left[u][1])
            best = min(left, key=lambda u: (round(gap(*after(u)) + left[u][2], 12), hashlib.sha256(f"bench:{batch}:{u}".encode()).hexdigest(), u))
            if round(gap(*after(best)) + left[best][2], 12) >= round(gap(got, n), 12):
                break
            got, n = after(best)
            del left[best]
            turn += 1
            out.append((batch, best, turn, round(gap(got, n), 9)))
    return sorted(out)


def test_bench_equals_a_plain_version(spark):
    rng = random.Random(8)
    parents, objects = [], []
    for p in range(220):
        batch = rng.choice(["a", "b", "b", "c", None])
        parents.append((batch, p, None if rng.random() < 0.3 else f"{batch}{rng.randrange(12)}", rng.choice(["train", "train", "val", "test", "other", None])))
        objects += [(p, name, rng.randrange(0, 7)) for name in ("x", "y", "z", None) if rng.random() < (0.8 if name == "x" else 0.3)]
    parents += [("small", 900 + k, f"s{k % 2}", "train") for k in range(9)] + [("bare", 950 + k, None, None) for k in range(12)]
    frames = spark.createDataFrame(parents, "batch string, parent_id long, unit string, split string"), spark.createDataFrame(objects, "parent_id long, class_name string, n long")
    got = sorted((r.batch, r.unit, r.turn, round(r.gap, 9)) for r in freeze_stratified(*frames, 0.2, Scratch(spark, "t")).collect())
    want = plain(parents, objects, 0.2)
    assert got == want and {r[0] for r in want} == {"a", "b", "c", "bare"} and len(want) >= 10
    assert freeze_stratified(frames[0].limit(0), frames[1], 0.2, Scratch(spark, "t")).collect() == []
