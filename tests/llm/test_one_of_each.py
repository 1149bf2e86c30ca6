"""keep_one_of_each on clashing keys and very many copies of one row."""

from pyspark.sql import functions as F

from tidemark.llm import near_dedup

DOCS = "doc_id long, text string, lang string"
WORDS = " ".join(f"w{k}" for k in range(40))


def test_rows_whose_keys_clash_all_stay(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "row_key", lambda doc_id, text: F.lit(7).cast("long"))
    rows = [(1, "alpha " + WORDS, "a"), (2, WORDS[::-1], "a"), (5, "one " * 9 + "x", "a"), (5, "other " * 9 + "y", "a"), (5, "other " * 9 + "y", "a")]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted({(i, t) for i, t, _ in rows})


def test_very_many_copies_of_one_row(spark):
    copies = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(WORDS).alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("lang")).repartition(6)
    rows = copies.union(spark.createDataFrame([(4, WORDS + " and more", "x"), (9, "quite another text of its own", "x"), (None, None, "z"), (None, None, "z")], DOCS))
    frame = near_dedup.keep_one_of_each(rows)
    kept = frame.collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", WORDS), ("9", "quite another text of its own"), ("None", None), ("None", None)])
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    again = near_dedup.keep_one_of_each(rows.repartition(3)).filter("doc_id = 3").first()
    assert again.lang == next(r.lang for r in kept if r.doc_id == 3)  # whatever the partitions
