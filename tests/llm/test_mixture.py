"""The mixture against what its splitting tree draws, with rows that are repeated or bear no id."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import docs_of, sentence
from tidemark.llm import mixture
from tidemark.llm.scratch import Scratch


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(21)
    many = [(k, sentence(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for k in range(2500)]
    df = docs_of(spark, many)
    return df, mixture.plan(df, Scratch(spark, "test"), mixture.WEIGHTS, 3, 16, 11), mixture.mixture(df).collect()


def test_taken_is_what_the_leaves_draw(spark, mixed):
    _, plan, found = mixed
    draws = Counter((r.source, r.block) for r in plan.draws.collect())
    rest = {r.place for r in plan.rest.collect()}
    want = Counter()
    for r in plan.rows.collect():
        times = draws[r.source, r.block] + (r.place in rest) if r["size"] else 0
        want[r.doc_id, r["size"] * times] += 1
    assert Counter((r.doc_id, r.taken) for r in found) == want


def test_leaves_hold_disjoint_draws_in_the_tree_s_numbers(mixed):
    _, plan, _ = mixed
    rows = plan.draws.collect()
    assert max(Counter((r.source, r.block, r["pass"]) for r in rows).values()) == 1
    by_source = Counter(r.source for r in rows)
    sources = sorted(by_source, key=lambda s: (s is None, s or ""))
    quotas = np.array([by_source[s] for s in sources])
    totals = np.diff(int(quotas.sum()) * np.arange(17) // 16)
    table = mixture.split_quotas(quotas, 16, 12, totals)
    assert table.sum(0).tolist() == quotas.tolist() and table.sum(1).tolist() == totals.tolist()
    assert Counter((r.source, r.shard) for r in rows) == Counter({(s, k): int(table[k, i]) for k in range(16) for i, s in enumerate(sources) if table[k, i]})
    goal = {r.source: r for r in plan.goal.collect()}
    words = defaultdict(Counter)
    for r in plan.rows.collect():
        words[r.source][r.block] += r["size"]
    rest = {r.place: r["size"] for r in plan.rows.collect()}
    last = sum(rest[r.place] for r in plan.rest.collect())
    drawn = sum(words[r.source][r.block] for r in rows if r.block != mixture.REST)
    assert abs(drawn + last - sum(g.target for g in goal.values())) <= 60 * len(goal)


def test_choose_fills_what_is_left():
    words, single = np.array([50, 40, 30, 20]), np.zeros(4, bool)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in mixture.choose(words, single, 75.0)] == [[True, False, False, True], 1, 5.0]
    alone = mixture.choose(np.array([50, 60]), np.ones(2, bool), 85.0)
    assert alone[0].tolist() == [True, True] and alone[1] == -1


def test_groups_of_sources_split_as_one():
    quotas = np.array([40, 7, 300, 12, 1], np.int64)
    whole = mixture.split_quotas(np.array([47, 313]), 5, 3)
    parts = [mixture.split_quotas(quotas[:2], 5, 4, whole[:, 0]), mixture.split_quotas(quotas[2:], 5, 5, whole[:, 1])]
    assert [p.sum(1).tolist() for p in parts] == whole.T.tolist() and [p.sum(0).tolist() for p in parts] == [[40, 7], [300, 12, 1]]


def test_repeats_and_rows_without_id(spark):
    rng = random.Random(5)
    same, other = sentence(rng, 10), sentence(rng, 10)
    rows = [(None, same, "en", "a")] * 700 + [(7, other, "en", "a")] * 300 + [(None, sentence(rng, 10), "en", "b") for _ in range(500)] + [(k, sentence(rng, 10), "en", "c") for k in range(500)]
    df = docs_of(spark, rows)
    found = mixture.mixture(df).collect()
    assert len(found) == len(rows) and max(r.taken for r in found) <= 30
    target = {r.target for r in found}
    taken = defaultdict(int)
    for r in found:
        taken[r.target] += r.taken
    assert all(abs(taken[t] - t) <= 15 for t in target)
    assert Counter(map(str, found)) == Counter(map(str, mixture.mixture(df.repartition(5)).collect()))
    copies = Counter(r.doc_id for r in mixture.mixed_documents(df).select("doc_id").collect())
    want = Counter()
    for r in found:
        want[r.doc_id] += r.taken // 10
    assert copies == want


def test_clashing_columns(spark):
    df = docs_of(spark, [(1, "a b", "en", "x"), (2, None, "en", None)]).selectExpr("*", "1 as place", "2 as drawn", "3 as mix_shard", "4 as `row`", "5 as `a.b`")
    out = mixture.mixed_documents(df)
    assert out.columns == [c for c in df.columns if c != "mix_shard"] + ["mix_shard", "mix_position"]
    assert {(r.doc_id, r.place, r["a.b"]) for r in out.collect()} <= {(1, 1, 5), (2, 1, 5)}
