"""Tokens of all scripts, short items, common phrases and slices in the decontamination."""

import random

import numpy as np
import pyarrow as pa

from tests.llm.test_operators import brute_tiles, docs_of, sentence
from tidemark.llm import decontaminate


def test_tokens_of_other_scripts_and_short_items(spark):
    items = [(1, "“Alpha” beta—ÉTÉ, gamma; δέλτα!"), (2, "two words"), (3, "Solo"), (4, "мир труд май июнь июль август"), (5, "***")]
    docs = [
        (10, "x alpha beta été gamma ΔΈΛΤΑ y", "en", "a"), (11, "He said: ‘two’ (words) again", "en", "a"), (12, "two other words", "en", "a"), (13, "a SOLO b", "en", "a"), (14, "soloist", "en", "a"),
        (15, "… Мир, труд! май: июнь — июль", "ru", "a"), (16, "alpha beta ete gamma", "en", "a"), (17, None, None, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (10**6, 2):
        found = decontaminate.contaminated(docs_of(spark, docs), benchmark, slice_seeds=size).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(10, 1), (11, 2), (13, 3), (15, 4)}
        assert sorted(r.doc_id for r in decontaminate.keep_clean(docs_of(spark, docs), benchmark, slice_seeds=size).collect()) == [12, 14, 16, 17]


def test_a_phrase_of_many_items_loses_none():
    """Random items with common phrases, against tiling every pair."""
    rng = random.Random(6)
    phrases = [sentence(rng, 7, 50).split() for _ in range(3)]
    items = [rng.choice(phrases) + sentence(rng, rng.randrange(1, 12), 300).split() + rng.choice(phrases)[: rng.randrange(5, 8)] for _ in range(40)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(phrases), sentence(rng, 6, 300).split()] + [x[rng.randrange(4) :][: rng.randrange(4, 20)] for x in rng.sample(items, 2)]
        rng.shuffle(parts)
        texts.append(sum(parts, []))
    table = decontaminate._table(list(range(40)), [" ".join(x) for x in items], 5, 5, 0.5)
    got = {(row, item): covered for row, item, covered, _, _ in decontaminate.matches(pa.array([" ".join(t) for t in texts]), table, 5, 0.5)}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            n = sum(x[0] for x in brute_tiles(item, t, 5))  # of equal runs the one earlier in the item
            if n >= 0.5 * len(item):
                want[i, k] = n
    assert set(got) == set(want) and len(table.hash) < sum(len(np.unique(s)) for s in table.seeds)


def test_seeds_that_only_hash_alike_are_told_apart():
    table = decontaminate._table([1], ["a b c d e f"], 5, 5, 0.5)
    table.words = [[b"a", b"b", b"c", b"x", b"e", b"f"]]
    assert not list(decontaminate.matches(pa.array(["a b c d e f"]), table, 5, 0.5))
