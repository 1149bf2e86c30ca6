"""Components of any finite size in the exact search."""

import math
import random

from pyspark.sql import functions as F

from tidemark.llm import topk


def test_finite_components_of_any_size(spark):
    rng = random.Random(4)
    vectors = [(k, [rng.choice([1, -1]) * 10 ** rng.uniform(-2, 2) for _ in range(6)]) for k in range(200)]
    vectors += [(300 + 10 * k, [rng.choice([1e15, -1e15, 3.0, 1e9, 0.0]) for _ in range(6)]) for k in range(12)] + [(500, [1e307] * 6), (520, [-1.7e308] * 6), (540, [float("inf")] * 6), (560, [1e8] * 6)]
    good = {i: [math.floor(64 * x) if abs(x) < 1e300 else int(math.copysign(1.7976931348623157e308, x)) for x in v] for i, v in vectors if all(map(math.isfinite, v))}
    good[500] = [math.floor(64 * 1e307) if math.isfinite(64 * 1e307) else int(1.7976931348623157e308)] * 6
    want = []
    for q in good:
        if q % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(good[q], v)), -(2**63)), 2**63 - 1), i) for i, v in good.items() if i != q)[:20]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for rows in (8192, 16):
        found = topk.top_k(df, F.col("vec_id") % 20 == 0, bucket_rows=rows, query_rows=8)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
