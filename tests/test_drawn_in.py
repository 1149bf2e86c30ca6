"""Boxes drawn in by the ratio asked for lose no pair of that ratio, and meet fewer others."""

import random

from pyspark.sql import functions as F

from tidemark.operators.spatial_join import drawn_in_for, iou, meeting_pairs


def test_drawn_in_boxes_keep_every_pair_of_the_ratio(spark):
    rng = random.Random(9)
    rows = [(k, float(x), float(y), float(x + rng.randrange(1, 12)), float(y + rng.randrange(1, 12))) for k in range(220) for x, y in [(rng.randrange(24), rng.randrange(24))]]
    found = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    ids = lambda pairs: sorted((r.a_id, r.b_id) for r in pairs.select("a_id", "b_id").collect())
    for least in (0.1, 0.3, 0.5, 1.0):
        close = F.round(iou(), 9) >= least
        drawn = meeting_pairs(found, found, (8.0, 4.0), shrink=drawn_in_for(least))
        assert ids(drawn.filter(close)) == ids(meeting_pairs(found, found, 64.0).filter(close))
        assert drawn.count() < meeting_pairs(found, found, 64.0).count()
