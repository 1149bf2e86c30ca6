"""The pipeline's stages, each against what a plain computation says its decisions must be."""

import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_tiles


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    out = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = out.collect()
        out = stage(spark, spark.createDataFrame(before, docs.schema), small)
        seen[name] = (before, out.collect())
        assert out.columns[: len(columns)] == columns
    before, after = seen["near_dedup"]
    kept = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in before], 80).items() if i == c}
    assert sorted(r.doc_id for r in after) == sorted(kept)
    before, after = seen["quality"]
    assert len(after) >= 0.75 * len(before) and {r.doc_id for r in after} <= {r.doc_id for r in rows}
    marks = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [" ".join(r.text.lower().split()) for r in seen["decontamination"][1]]
    assert not any(m in t for m in marks for t in clean)
    before, after = seen["mixing"]
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["sharding"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before) and {r.shard for r in after} <= set(range(40))
    slots = Counter(r.shard for r in after)
    assert all({r.slot for r in after if r.shard == s} == set(range(n)) for s, n in slots.items())


def odd_rows():
    """Nulls in every column, an id on several texts, repeats, empty and long texts; texts of their own words, which are good and clean."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"{rng.choice(['the', 'and', 'of'])} w{rng.randrange(4000)}" for _ in range(n)) + "."
    a, b, c, d = (say(60) for _ in range(4))
    rows = [(None, a, "en", "s"), (None, b, None, "s"), (5, a + " tail", "en", None), (7, c, "en", "s"), (7, d, "en", "t"), (7, d, "en", "t"), (8, None, None, None), (None, None, None, None), (9, "", "en", "s"), (10, say(20000), "en", "s")]
    return [(i, t, lang, source, len(t) if t else None) for i, t, lang, source in rows]


def folder_of(spark, base, small, rows):
    """A folder of tables with these documents."""
    path = str(base)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_run_on_odd_rows_against_a_plain_version(spark, small, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    path = folder_of(spark, tmp_path / "t", small, rows + odd_rows())
    found = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, path).collect()
    # near-duplicates: by text, whatever the ids; the group's first id (none last) stays
    texts = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in good})
    groups = brute_components([(k, t) for k, (*_, t) in enumerate(texts)], 80)
    stay = Counter()
    marks = [re.findall(r"[a-z0-9]+", r.text.lower()) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    kept = {k: [i for i, (_, root) in groups.items() if root == k] for k, (_, root) in groups.items() if k == root}
    wordless = Counter((r.doc_id, r.text) for r in good if not (r.text or "").strip())
    for members in kept.values():
        null, i, t = texts[members[0]]
        if t.strip():
            words = re.findall(r"[^\W_]+", t.lower())
            held = any(2 * sum(n for n, *_ in brute_tiles(words, m, 5)) >= len(m) for m in marks if {*zip(*(words[k:] for k in range(5)))} & {*zip(*(m[k:] for k in range(5)))})
            if not held:
                stay[t] += 1
    assert sum(1 for r in found if not (r.text or "").strip()) == 0, "the mix draws no wordless rows"
    got = Counter(r.text for r in found)
    assert set(got) <= set(stay) and max(got.values()) <= 3 * max(stay.values())
    mix = corpus_pipeline.mixing(spark, corpus_pipeline.decontamination(spark, corpus_pipeline.near_dedup(spark, spark.createDataFrame(good, docs.schema), path), path), path)
    assert Counter(r.text for r in mix.collect()) == got
    clean = corpus_pipeline.decontamination(spark, corpus_pipeline.near_dedup(spark, spark.createDataFrame(good, docs.schema), path), path)
    by_text = Counter(r.text for r in clean.collect() if (r.text or "").strip())
    assert by_text == stay and sum(wordless.values()) >= clean.filter("trim(coalesce(text, '')) = ''").count()
    slots = Counter(r.shard for r in found)
    assert all({r.slot for r in found if r.shard == s} == set(range(n)) for s, n in slots.items())


def test_empty_tables_and_clashing_columns(spark, small, tmp_path):
    path = folder_of(spark, tmp_path / "t", small, [])
    assert corpus_pipeline.run(spark, path).count() == 0
    more = "1 as __key, 2 as __rank, 3 as shard, 4 as slot, 5 as __place, 6 as size, 7 as place, 8 as `row`, 9 as component_id, 10 as score, 11 as drawn, 12 as __size, 13 as __shard, 14 as mix_shard"
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *more.split(", "))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == (0 if not docs.count() else out.count())
        kept = [c for c in docs.columns if c not in ("shard", "slot", "mix_shard")]
        assert [c for c in out.columns if c in kept] == kept, name
        row = out.filter("doc_id = 10").first()
        assert row is None or (row["__key"], row["__rank"], row["place"], row["row"], row["__size"]) == (1, 2, 7, 8, 12), name
