"""Back-off of any order against counters."""

import math
from collections import Counter

import pytest

from tests.llm.test_operators import WORD, docs_of, rows, sentence  # noqa: F401
from tidemark.llm import backoff


def brute(texts, order, alpha=0.4):
    folded = [WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)})) for t in texts]
    grams = [[Counter(zip(*(w[k:] for k in range(n)))) for n in range(1, order + 1)] for w in folded]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    size = sum(map(len, folded))
    for w, own in zip(folded, grams):
        score = 0.0
        for i in range(len(w)):
            factor = 0.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = total[n - 1][g] - own[n - 1][g]
                if c > 0:
                    base = total[n - 2][g[:-1]] - own[n - 2][g[:-1]] if n > 1 else size - len(w)
                    score += factor + math.log(c / base)
                    break
                factor += math.log(alpha) if n > 1 else 0.0
            else:
                score += factor - math.log(size - len(w) + 1)
        yield len(w), score


@pytest.mark.parametrize("order", [1, 3, 4])
def test_orders_against_counters(spark, rows, order):  # noqa: F811
    some = rows + rows[:5] + [(None, t, *r) for _, t, *r in rows[5:9]]
    want = sorted((i if i is not None else -1, n, round(s, 5)) for (i, *_), (n, s) in zip(some, brute([t for _, t, *_ in some], order)))
    for size, grams in ((8 << 20, 10_000_000), (20_000, 5_000)):
        backoff.PART_GRAMS, before = grams, backoff.PART_GRAMS
        found = backoff.backoff_scores(docs_of(spark, some), order=order, chunk_bytes=size).collect()
        backoff.PART_GRAMS = before
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.log_score, 5)) for r in found) == [pytest.approx(w, abs=1e-4) for w in want]
