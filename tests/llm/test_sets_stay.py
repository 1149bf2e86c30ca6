"""Shingle sets are not shuffled anew for each step that looks at some of them."""

import random

from tests.llm.test_operators import brute_components, docs_of
from tidemark.llm import near_dedup


def families(rng):
    """Families of texts around the bound, some links in each, and many pairs of near copies."""
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(9000)}" for _ in range(300)]
        for _ in range(12):
            text = list(base)
            for at in rng.sample(range(300), rng.randrange(2, 9)):
                text[at] = f"x{rng.randrange(9000)}"
            rows.append(text)
    for _ in range(120):
        text = [f"w{rng.randrange(9000)}" for _ in range(300)]
        rows += [text, text[:-1]]
    return [(k, " ".join(t), "en", "a") for k, t in enumerate(rows)]


def shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_sets_are_shuffled_a_few_times_only(spark):
    rows = families(random.Random(5))
    want = brute_components(rows)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        moved = []
        for ids in (near_dedup.BROADCAST_IDS, 10):  # the second: more than can be sent to executors
            start = shuffled(spark)
            found = near_dedup.near_duplicates(docs_of(spark, rows), broadcast_ids=ids).collect()
            moved.append(shuffled(spark) - start)
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    finally:
        spark.conf.set(name, before)
    sets = 8 * sum(n for n, _ in want.values())
    assert moved[0] < 5.5 * sets and moved[1] < 8 * sets
