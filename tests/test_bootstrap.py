"""Replicates with exactly n draws, against a plain bootstrap."""

import numpy as np
import pytest

from tidemark.operators.bootstrap import counts_within, draws_of_part, resampled_sums
from tidemark.scratch import Scratch


def test_draws_of_all_parts_sum_to_the_rows():
    sizes = np.array([5, 0, 17, 3, 40, 1, 9])
    drawn = np.stack([draws_of_part(sizes, p, 3000, 4) for p in range(len(sizes))])
    assert (drawn.sum(axis=0) == sizes.sum()).all() and (drawn[1] == 0).all()
    assert np.abs(drawn.mean(axis=1) - sizes).max() < 0.3
    share = sizes / sizes.sum()
    assert np.abs(drawn.var(axis=1) - sizes.sum() * share * (1 - share)).max() < 2
    within = counts_within(9, drawn[6], 6, 4)
    assert (within.sum(axis=1) == drawn[6]).all() and within.std(axis=0).min() > 0.5


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_interval_equals_that_of_a_plain_bootstrap(spark, part_rows):
    rng = np.random.default_rng(2)
    x = rng.exponential(1, 400)
    frame = spark.createDataFrame([(k, float(v), None if k % 7 == 0 else 1.0, "a") for k, v in enumerate(x)], "id long, x double, y double, draws string").repartition(3)
    got = resampled_sums(frame, "id", ["x", "y"], 600, Scratch(spark, "t"), part_rows=part_rows).collect()
    assert sorted(r.rep for r in got) == list(range(600)) and {r.draws for r in got} == {400}
    again = resampled_sums(frame.repartition(5), "id", ["x", "y"], 600, Scratch(spark, "t"), part_rows=part_rows).collect()
    assert sorted((r.rep, r.y) for r in again) == sorted((r.rep, r.y) for r in got)
    plain = np.array([x[rng.integers(0, 400, 400)].mean() for _ in range(4000)])
    mine = np.array([r.x / 400 for r in got])
    assert np.abs(np.percentile(mine, [2.5, 50, 97.5]) - np.percentile(plain, [2.5, 50, 97.5])).max() < 0.03 and abs(mine.std() / plain.std() - 1) < 0.12
    assert abs(np.mean([r.y for r in got]) - 400 * 6 / 7) < 3
    assert resampled_sums(frame.limit(0), "id", ["x"], 10, Scratch(spark, "t")).collect() == []
