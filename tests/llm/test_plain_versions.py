"""The classifier's scores and the shards' cuts against versions in plain Python."""

import math
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import docs_of, sentence
from tidemark.llm import quality, shards

WHITE = b" \t\n\v\f\r"


def plain_features(text):
    data = (text or "").encode()
    words, word = [], bytearray()
    for b in [*data, 32]:
        if b in WHITE:
            if word:
                words.append(bytes(word))
            word = bytearray()
        else:
            word.append(b)
    upper = lambda b: 65 <= b <= 90
    letter = lambda b: upper(b) or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    symbol = lambda b: b >= 32 and not letter(b) and not digit(b) and b not in b".,;:'\"-()?" and b not in WHITE
    count = lambda f: sum(map(f, data))
    low = [w.lower() for w in words]
    n, size, letters = max(len(words), 1), max(len(data), 1), max(count(letter), 1)
    pairs = list(zip(low, low[1:]))
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, count(upper) / letters, count(symbol) / size, count(digit) / size, len(set(low)) / n, len(set(pairs)) / max(n - 1, 1), sum(a == b for a, b in pairs) / n,
        sum(symbol(w[-1]) for w in words) / n, sum(sum(map(upper, w)) >= 2 and not any(97 <= b <= 122 for b in w) for w in words) / n, sum(not any(map(letter, w)) for w in words) / n,
        data.count(10) / n, max(Counter(low).values(), default=0) / n, sum(b in WHITE for b in data) / size,
    ]


def test_scores_are_sums_over_the_tables(spark):
    rng = random.Random(2)
    bad = lambda t: rng.choice([t.upper(), t.replace(" ", "$ "), " ".join(x for x in t.split()[:9] for _ in range(5)), t.replace(" ", "\n| ")])
    some = [(k, sentence(rng, rng.randrange(1, 80)).capitalize() + ".", "en", "a") for k in range(300)] + [(300 + k, bad(sentence(rng, 60)), "en", "a") for k in range(150)]
    odd = [(900, None, None, None), (901, "", "en", "a"), (902, "ÉÀ 12 ## #", "en", "a"), (903, " \n ", "en", "a"), (904, "Word " * 20000, "en", "a")]
    docs = docs_of(spark, some + odd)
    labels = spark.createDataFrame([(i, int(i < 300)) for i, *_ in some], "doc_id long, quality int")
    model = quality.train(docs, labels)
    want = {}
    for i, text, *_ in some + odd:
        x = plain_features(text)
        total = model.intercept + sum(float(values[bisect_right(edges.tolist(), v)]) for v, edges, values in zip(x, model.edges, model.tables))
        total += sum(float(values[bisect_right(a.tolist(), x[p]), bisect_right(b.tolist(), x[q])]) for p, q, a, b, values in model.pairs)
        want[i] = 1 / (1 + math.exp(-total))
    found = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert found == pytest.approx(want, abs=1e-6) and len(model.pairs) == 6


def plain_tree(rows, shards_, slack):
    """Shard of each row (size, {dimension: place}, own) by sorting every node's rows along its widest dimension."""
    dims = sorted(rows[0][1])
    span = {d: max(1, max(r[1][d] >> 47 for r in rows) - min(r[1][d] >> 47 for r in rows)) for d in dims}
    limit = slack * sum(r[0] for r in rows) / shards_
    out = {}

    def passing(values, goal):
        """The value at which running bytes pass the goal, the bytes before it and its own."""
        by = Counter()
        for at, size in values:
            by[at] += size
        before = 0
        for at in sorted(by):
            if before + by[at] > goal:
                return at, before, by[at]
            before += by[at]
        return at, before - by[at], by[at]

    def cut(own, k, first):
        if k == 1 or not own:
            out.update({id(r): first for r in own})
            return
        half = k // 2
        wide = max(dims, key=lambda d: ((max(r[1][d] >> 47 for r in own) - min(r[1][d] >> 47 for r in own)) / span[d], d))
        goal = sum(r[0] for r in own) * half / k
        place, before, weight = passing([(r[1][wide], r[0]) for r in own], goal)
        want = goal - before
        if weight > limit:
            at, less, heavy = passing([(r[2], r[0]) for r in own if r[1][wide] == place], want)
            at += 2 * (want - less) > heavy
            left = [r for r in own if r[1][wide] < place or r[1][wide] == place and r[2] < at]
        else:
            place += 2 * want > weight
            left = [r for r in own if r[1][wide] < place]
        ids = set(map(id, left))
        cut(left, half, first)
        cut([r for r in own if id(r) not in ids], k - half, first + half)

    cut(rows, shards_, 0)
    return [out[id(r)] for r in rows]


def test_shards_are_those_of_sorted_cuts(spark):
    rng = random.Random(7)
    many = [(k, sentence(rng, rng.randrange(1, 60)), rng.choice(["en", "fr", "de", None]), "a") for k in range(1500)] + [(5000 + k, "the same text", "en", "b") for k in range(600)] + [(9000, None, "en", "a"), (9001, "", None, "a")]
    docs = docs_of(spark, many)
    at = shards.places(docs)
    rows = [(r["__size"], {d[5:]: r[d] for d in r.asDict() if d.startswith("__at_")}, r["__own"], r["id"]) for r in docs.select(F.col("doc_id").alias("id"), *[v.alias(k) for k, v in at.items()]).collect()]
    for n in (1, 7, 40):
        want = {r[3]: s for r, s in zip(rows, plain_tree(rows, n, shards.SLACK))}
        assert {r.doc_id: r.shard for r in shards.shard_documents(docs, shards=n).collect()} == want
    size = Counter()
    for r in shards.shard_documents(docs).collect():
        size[r.shard] += r["size"]
    mean, most = sum(size.values()) / 40, max(r[0] for r in rows)
    assert len(size) == 40 and max(size.values()) <= mean + most and min(size.values()) >= mean - most
