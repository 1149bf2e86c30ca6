"""The numbered operators on small fixtures: brute force, nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import backoff, chat, decontaminate, html_text, language, mixture, near_dedup, quality, shards, topk

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, node string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", "z") for i, t, lang, src in rows], DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [sentence(rng, n, 3000) for n in (3, 40, 120, 200, 350)]
    out = [(k, t, "en", "a") for k, t in enumerate(base)]
    for k, t in enumerate(base[1:], 10):
        w = t.split()
        out += [(k, t, "en", "b"), (k + 10, " ".join(w[:-1] + ["other"]), "fr", "a"), (k + 20, " ".join(w[: len(w) // 2]), "en", None)]
        for j in range(12):  # near copies that are near each other or not
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = f"n{rng.random()}"
            out.append((100 * k + j, " ".join(v).upper(), "en", "c"))
    return out + [(90, None, None, None), (91, "", "en", "a"), (92, " \n\t", "en", "a"), (93, "Solo", "en", "a"), (94, "solo", "de", "a"), (95, sentence(rng, 30000), "en", "a"), (96, "?? !!", "en", "d")]


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark, rows):
    found = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_near_duplicates_repeats_and_empty(spark, rows):
    twice = near_dedup.near_duplicates(docs_of(spark, rows[:8] * 2)).collect()
    assert len(twice) == 16 and {(r.doc_id, r.component_id) for r in twice} == {(k, v[1]) for k, v in brute_components(rows[:8]).items()}
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    kept = near_dedup.keep_one_of_each(docs_of(spark, rows[:8] * 2))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in brute_components(rows[:8]).items() if v[1] == k)


def test_one_of_each_group_whatever_the_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, 60, 3000) for _ in range(4))
    near = lambda t: t + " tail"
    given = [(None, a), (None, b), (None, near(b)), (None, c), (5, near(a)), (7, c), (7, d), (7, d), (None, near(d)), (None, None), (None, ""), (None, " "), (None, " "), (8, ""), (8, "")]
    kept = near_dedup.keep_one_of_each(docs_of(spark, [(i, t, "en", "a") for i, t in given])).collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    of_b = [k for k in found if k in ((None, b), (None, near(b)))]
    assert len(of_b) == 1 and found == Counter([(5, near(a)), of_b[0], (7, c), (7, d), (None, None), (None, ""), (None, " "), (None, " "), (8, "")])


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 50, 4000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        assert (near_dedup.sketch([a], 125) < np.iinfo(np.uint64).max).all()
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))])
    s = near_dedup.sketch([a, np.sort(b)], 2000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_prefix_keys_lose_no_pair():
    rng = random.Random(2)
    for _ in range(60):
        base = [rng.randrange(2**63) for _ in range(rng.randrange(5, 120))]
        other = [x for x in base if rng.random() > 0.06] + [rng.randrange(2**63) for _ in range(rng.randrange(4))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            often = np.full(1 << 12, 2, np.uint8)
            classes = frozenset(map(near_dedup.size_class, (len(a), len(b))))
            (p, _, x), (q, _, y) = (near_dedup.prefix_keys(s, often, 85, classes) for s in (a, b))
            shared = [(x[list(p).index(k)], y[list(q).index(k)]) for k in set(p) & set(q)]
            assert any(185 * (1 + min(v)) >= 85 * (len(a) + len(b)) for v in shared)


PAGE = """<html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="</p>";</script></head><body class="c{n}"><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy now</div><{open}><h1>Title &lt;{n}&gt;</h1><p>First   para&nbsp;graph<p><b>Second</b> one, which is long enough to matter.<br><p>Third.</p><form>Name <input></form><aside>Aside</aside></{close}>
<div id="comments"><p>I disagree with all of this and I will say so at length.</p></div><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(n, f"http://h{n % 2}.example/{n}", PAGE.format(n=n, open=o, close=o.split()[0])) for n, o in enumerate(["article", 'div class="post-7"', "article", 'div class="post-8"', "article"])]
    rows += [(7, "http://h0.example/x", None), (8, None, ""), (9, "http://h1.example/y", "<p>Only <b>this"), (9, "http://h1.example/y", "<p>Only <b>this")]
    pages = spark.createDataFrame([(*r, "u", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract(pages).collect()
    want = {n: f"Title <{n}>\nFirst para graph\nSecond one, which is long enough to matter.\nThird." for n in range(5)} | {7: "", 8: "", 9: "Only this"}
    assert len(found) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in found)
    again = html_text.extract(pages, broadcast_hosts=0).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert html_text.extract(pages.limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), v.astype(float).tolist()) for i, v in enumerate(rng.normal(0, rng.uniform(0.1, 2, 300)[:, None], (300, 12)))]
    vectors += [(300 + i, vectors[7][1]) for i in range(30)] + [(400, None), (401, [float("nan")] * 12), (402, [1.0, None] + [0.0] * 10), (403, [0.0] * 12), (405, [])]
    df = spark.createDataFrame([(*v, "q", 3) for v in vectors], "vec_id long, embedding array<double>, rank string, score int")
    good = {i: np.floor(64 * np.array(v)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            pad = lambda a: np.pad(a, (0, 12 - len(a)))
            scores = sorted(((-int(pad(good[q]) @ pad(v)), i) for i, v in good.items() if i != q))[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    for bucket in (8192, 16):
        found = topk.top_k(df, F.col("vec_id") % 20 == 0, bucket_rows=bucket, query_rows=4)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_coordinate_pruning_is_exact():
    rng = np.random.default_rng(5)
    p = rng.integers(-60, 60, (500, 8))
    p[:40] = p[0] + rng.integers(-3, 3, (40, 8))
    norms = np.sqrt((p**2).sum(1).astype(float))
    order = np.argsort(-norms)
    p, norms, ids = p[order], norms[order], order.astype(np.int64)
    q = p[:10].copy()
    scores = q @ p.T
    theta = np.partition(scores, -12, axis=1)[:, -12]
    for start in (0.0, 2.0):  # all by coordinates, all by length
        found = topk.search_bucket(np.arange(1000, 1010), norms[:10], q, theta, np.full(10, 2**62), ids, norms, p, 10, coordinate_from=start)
        assert [sorted(s, reverse=True) for _, _, s in sorted(found, key=lambda r: r[0])] == [sorted(row, reverse=True)[:10] for row in scores.tolist()]


def test_mixture(spark, rows):
    rng = random.Random(8)
    many = [(100000 + k, sentence(rng, rng.randrange(1, 60)), "en", rng.choice("aaaaabcde")) for k in range(3000)] + rows
    df = docs_of(spark, many)
    found = mixture.mixture(df).collect()
    assert len(found) == len(many) and sorted(map(str, found)) == sorted(map(str, mixture.mixture(df.repartition(7)).collect()))
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in many}
    by = Counter()
    for i, _, _, s in many:
        by[s] += sizes[i]
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(by), float(sum(by.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * by[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * by[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    of = {i: s for i, _, _, s in many}
    taken = Counter()
    for r in found:
        assert r.size == sizes[r.doc_id] and r.source_size == by[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(60, 0.01 * target[s]) for s in by)
    mixed = mixture.mixed_documents(df)
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert copies == Counter({r.doc_id: r.taken // r.size for r in found if r.taken})
    assert mixture.mixture(df.limit(0)).count() == 0 and mixture.mixed_documents(df.limit(0)).count() == 0


def test_quotas_split_exactly():
    quotas = np.array([500, 3, 0, 77], np.int64)
    table = mixture.split_quotas(quotas, 7, 1)
    assert table.shape == (7, 4) and (table.sum(0) == quotas).all() and (table >= 0).all()
    assert (mixture.split_quotas(quotas, 7, 1) == table).all()
    assert np.ptp(table.sum(1)) <= 3


def test_quality(spark):
    rng = random.Random(9)
    bad = lambda t: rng.choice([t.upper().replace(" ", "!! "), " ".join(x for x in t.split()[:9] for _ in range(9)), t.replace(" ", " | "), t.replace(" ", "$$$ ")])
    good = [(k, ". ".join(sentence(rng, 12).capitalize() for _ in range(4)), "en", "a") for k in range(500)]
    some = good + [(500 + k, bad(sentence(rng, 60)), "en", "a") for k in range(150)] + [(900, None, "en", "a"), (901, "", "en", "a"), (902, "!", None, None), (None, "a b", "en", "a")]
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, *_ in some if i is not None] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs_of(spark, some), labels).collect()
    assert len(found) == len(some)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out and r.doc_id < 650]
    assert sum(r.predicted == int(r.doc_id < 500) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs_of(spark, some), labels)
    assert kept.columns == docs_of(spark, []).columns and kept.count() == sum(r.predicted for r in found)
    none = quality.classify(docs_of(spark, some[:3]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.classify(docs_of(spark, []), labels).count() == 0


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, pair_rounds=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_shards(spark, rows):
    rng = random.Random(3)
    many = [(100000 + k, sentence(rng, rng.randrange(1, 80)), rng.choice(["en", "fr", "de", None]), "a") for k in range(2500)] + [(200000 + k, "the same text", "en", "b") for k in range(1800)] + rows
    found = shards.shard_documents(docs_of(spark, many)).collect()
    text = {i: t for i, t, *_ in many}
    assert len(found) == len(many)
    slots, bytes_ = {}, Counter()
    for r in found:
        data = (text[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        bytes_[r.shard] += r.size
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = [v for s, v in bytes_.items()]
    long = max(r.size for r in found)
    mean = sum(rest) / 40
    assert max(v for v in rest) <= mean + long and min(rest) > 0.3 * mean
    again = shards.with_shards(docs_of(spark, many))
    assert Counter(r.shard for r in again.select("shard").collect()) == Counter(r.shard for r in found)
    assert shards.shard_documents(docs_of(spark, [])).count() == 0
    assert len({r.shard for r in shards.shard_documents(docs_of(spark, many), shards=None, target_bytes=30_000).collect()}) > 3


def brute_tiles(a, b, least):
    """Greedy string tiling by trying every start."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles
        n, i, j = best
        tiles.append(best)
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))


def test_decontamination_against_brute_tiling(spark):
    rng = random.Random(11)
    items = [(k, sentence(rng, 24, 5000)) for k in range(12)] + [(50, None), (51, "too short"), (52, "")]
    docs = [(k, sentence(rng, 40, 5000), "en", "a") for k in range(20)]
    for k in range(12):
        w = items[k][1].split()
        docs.append((100 + k, f"{sentence(rng, 9)} {items[k][1].upper()}! {sentence(rng, 9)}", "en", "a"))
        docs.append((200 + k, " ".join([*w[12:], "x", "y", *w[:12], sentence(rng, 5)]), "en", "a"))  # reordered
        docs.append((300 + k, " ".join([*w[:9], sentence(rng, 30, 5000)]), "en", "a"))  # too little of it
    docs += [(400, None, None, None), (401, "", "en", "a"), (402, items[0][1] + " " + sentence(rng, 60000), "en", "a")]
    benchmark = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")
    for size in (10**6, 30):
        found = decontaminate.contaminated(docs_of(spark, docs), benchmark, slice_seeds=size).collect()
        got = {(r.doc_id, r.item_id): r.covered_tokens for r in found}
        want = {}
        for i, t, *_ in docs:
            for k, b in items:
                words = [re.findall(r"[a-z0-9]+", (x or "").lower()) for x in (t, b)]
                if i != 402 and len(words[1]) > 4:
                    n = sum(x[0] for x in brute_tiles(*words, 5))
                    if n >= 0.5 * len(words[1]):
                        want[i, k] = n
        assert {k: v for k, v in got.items() if k[0] != 402} == want and (402, 0) in got and set(range(100, 112)) | set(range(200, 212)) <= {k[0] for k in got}
    clean = decontaminate.keep_clean(docs_of(spark, docs), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in docs if i not in {k[0] for k in got})
    assert decontaminate.contaminated(docs_of(spark, docs), benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs_of(spark, []), benchmark).count() == 0


def test_keep_clean_finds_items_without_an_id(spark):
    rng = random.Random(12)
    items = [(k, sentence(rng, 24, 5000)) for k in (None, 3, None)]
    docs = [(k, f"{sentence(rng, 9)} {t} {sentence(rng, 9)}", "en", "a") for k, (_, t) in enumerate(items)] + [(9, sentence(rng, 40, 5000), "en", "a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (10**6, 30):
        assert [r.doc_id for r in decontaminate.keep_clean(docs_of(spark, docs), benchmark, slice_seeds=size).collect()] == [9]


def test_tiling_of_repeated_words():
    for a, b in (("a a a a a a b c d e f".split(), "a a a a b c d e".split()), ("x y z w v x y z w v q".split(), "x y z w v q r x y z w v".split())):
        seeds = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]]
        tiles = decontaminate.tile(*map(np.array, zip(*seeds)), 5)
        assert sum(n for *_, n in tiles) == sum(n for n, *_ in brute_tiles(a, b, 5))


def test_chat(spark):
    said = [(1, 0, "system", "Be [INST] kind"), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant<|im_sep|>x"), (1, 2, "assistant", r"back\slash \<|im_end|> [/INST]</s>"), (2, 1, "assistant", None), (2, 0, None, ""),
            (3, 5, "assistant", "é😀"), (3, 5, "assistant", "é😀"), (None, None, "user", "no id"), (4, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame([(*r, "f", 1) for r in said], "conv_id long, turn long, role string, text string, formatted string, nth int")
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in said if c == conv))
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert found[conv].n_turns == len(own) and found[conv].loss_chars == len(learnt) and found[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look <|image|>", None, None), ("image", None, "s3://a.png", None), ("Audio", None, "b.wav", 12), ("document", None, None, None), (None, "end", None, None), ("video", None, "v", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|im_start|>user<|im_sep|>look <\\|image|><|image|><|audio|><|document|>end<|file|><|im_end|>\n<|im_start|>assistant<|im_sep|><|im_end|>\n"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in row.attachments] == [(1, "image", "s3://a.png", 576), (1, "audio", "b.wav", 12), (1, "document", None, 1024), (1, "file", "v", 1)]
    assert row.attachment_tokens == 576 + 12 + 1024 + 1


def brute_backoff(rows, alpha=0.4):
    words = {k: WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)})) for k, (_, t, *_) in enumerate(rows)}
    total = [Counter(), Counter()]
    for w in words.values():
        total[0].update(w)
        total[1].update(zip(w, w[1:]))
    n, out = sum(total[0].values()), {}
    for k, w in words.items():
        own, score = (Counter(w), Counter(zip(w, w[1:]))), 0.0
        for i, x in enumerate(w):
            c1, rest = total[0][x] - own[0][x], n - len(w)
            single = math.log(c1 / rest) if c1 else -math.log(rest + 1)
            if i == 0:
                score += single
                continue
            c2, h = total[1][w[i - 1], x] - own[1][w[i - 1], x], total[0][w[i - 1]] - own[0][w[i - 1]]
            score += math.log(c2 / h) if c2 else math.log(alpha) + single
        out[k] = (len(w), score)
    return out


def test_backoff_against_counters(spark, rows):
    some = rows + rows[:5]
    want = sorted((i if i is not None else -1, n, round(s, 6)) for (i, *_), (n, s) in zip(some, brute_backoff(some).values()))
    for size in (8 << 20, 20_000):
        found = backoff.backoff_scores(docs_of(spark, some), chunk_bytes=size).collect()
        assert sorted((r.doc_id, r.n_tokens, round(r.log_score, 6)) for r in found) == [pytest.approx(w) for w in want]
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) for r in found) and backoff.backoff_scores(docs_of(spark, [])).count() == 0
    three = backoff.backoff_scores(docs_of(spark, some), order=3).collect()
    assert len(three) == len(some)


def test_packed_runs():
    for values in ([], [0], [5, 5, 2**63], list(range(1000))):
        a = np.array(values, np.uint64)
        assert (backoff.unpack(backoff.pack(a), len(a)) == a).all()


def test_language(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "th", "ing", "er", "and", "wh"], "de": ["ung", "ch", "der", "ei", "sch", "ß"], "fr": ["eau", "ê", "ou", "le", "è", "ment"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(n))
    some = [(k, text(lang, rng.randrange(2, 60)), lang, "a") for k, lang in enumerate(rng.choices(list(parts), k=600))]
    odd = [(900, None, None, None), (901, "", "en", "a"), (902, "123 ... !!", "en", "a"), (903, "日本", None, "a"), (904, "a" * 300000, "en", "a"), (None, "the thing", "en", "a"), (905, "\U0001f600", "en", "a")]
    found = language.identify(docs_of(spark, some + odd)).collect()
    truth = {i: lang for i, _, lang, _ in some}
    assert len(found) == len(some) + len(odd)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r.lang_pred for r in found}
    assert {by[k] for k in (900, 901, 902, 905)} == {"und"} and by[903] in parts and by[904] in parts
    assert {r.lang_pred for r in language.identify(docs_of(spark, odd[:4])).collect()} <= {"und", "en"}
    assert language.identify(docs_of(spark, [])).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"], 3, rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    runs, truth = rng.integers(97, 100, (4, 5)), np.array([0, 1, 2, 1])
    _, grads = net.gradients(runs, truth)
    for name, at in (("f_in", (98, 2)), ("b_in", (97, 5)), ("f_rec", (1, 4)), ("b_rec", (2, 7)), ("f_out", (0, 1)), ("bias", (2,))):
        w = net.weights[name]
        w[at] += 1e-5
        up = net.gradients(runs, truth)[0]
        w[at] -= 2e-5
        down = net.gradients(runs, truth)[0]
        w[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=2e-4)
