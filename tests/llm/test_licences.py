"""Licence scans against a version that compares every place with every phrase."""

import random
import re

from tidemark.llm import licences

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, labels string, n_words string, score string"


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    starts, names, own = [], set(), set()
    for t in licences.TEMPLATES:
        k = t.text.split()
        if t.base:
            found = [i for i in range(len(w)) if w[i : i + len(k)] == k]
            starts += found
            names |= {t.label} if found else set()
        spans = [(next(i for i in range(len(k)) if k[i : i + len(p.split())] == p.split()), p.split()) for p in t.keys]
        for i in range(-len(k), len(w)):
            if all(i + at >= 0 and w[i + at : i + at + len(p)] == p for at, p in spans):
                own.add(t.label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(own))


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = sorted({w for t in licences.TEMPLATES for w in t.text.split()})
    texts = [None, "", " \n", "?!", "CC BY-NC 4.0", "Under the MIT  license; under-the-mit-LICENSE", "under the mit", "nc " * 5000 + "cc by nc", "Licensed under the Apache License, Version 2.0."]
    texts += ["Under THE mıt license", "ünder the mit license", "CC BY NC", "K under the mit license " * 3, "forms with or without modification are permitted", "x" * 100_000 + " cc by nc"]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            kind = rng.random()
            parts.append(rng.choice(licences.TEMPLATES).text if kind < 0.15 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6))) if kind < 0.6 else rng.choice(["été", "42", "Wort", "…"]))
        text = rng.choice([" ", "\n", " - "]).join(parts)
        texts.append(text.upper() if rng.random() < 0.2 else text)
    return texts + texts[-3:]


def test_places_and_labels_equal_a_plain_version(spark):
    texts = made()
    docs = spark.createDataFrame([(k % 130, t, "a", "b", "c") for k, t in enumerate(texts)], DOCS).repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licences.scan(docs).collect()), key=str)
    assert got == sorted(((k % 130, *plain(t)) for k, t in enumerate(texts)), key=str)
    assert sum(r[2] for r in got) > 50


def test_scores(spark):
    texts = {1: "permission is hereby granted, free of charge, to any person obtaining a copy of this software", 2: "all about permission and copies", 3: None, 4: "hereby granted free of costs", 5: "this is under the mit license"}
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in texts.items()], DOCS)
    score = {r.doc_id: r.score for r in licences.scan(docs).collect()}
    assert abs(score[1] - 1) < 1e-9 and abs(score[5] - 1) < 1e-9 and score[3] == 0 < score[2] < score[4] < 0.6


def test_empty_table_and_words_that_share_a_hash(spark, monkeypatch):
    docs = spark.createDataFrame([], DOCS)
    assert licences.scan(docs).collect() == []
    index = licences.Index(licences.TEMPLATES, dict.fromkeys(licences.Vocabulary(licences.TEMPLATES).names, 1.0))
    import pyarrow as pa

    block = next(licences.blocks(pa.array(["cc by nd", "cc by nc"])))
    w = licences.words(block, licences.NOT_WORD)
    w.hash[2] = w.hash[5]  # another word with the same hash is no licence
    found = [(t, s.tolist(), whole.tolist()) for t, _, s, _, whole in licences.places(block, w, index) if licences.TEMPLATES[t].label == "cc-by-nc"]
    assert found == [(2, [0, 3], [False, True])]
