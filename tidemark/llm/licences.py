"""Licence statements in texts, found through a positional index of rare template words.

A template is a run of words with key phrases in it that must all stand there. The index knows for each word where it
stands in which template. For each template, a file's word of the highest inverse document frequency (over all documents)
among those of the first key phrase is looked up; wherever it stands, it opens the template at the place that the relative
positions give. A file with the phrase holds the phrase's rarest word, so no place is missed. At each place the file's
words are intersected with the template's postings by relative position; the key phrases are verified letter by letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textblocks import NOT_WORD, Block, Words, blocks, words


@dataclass(frozen=True)
class Template:
    """label; text: its words; keys: phrases of text that must all stand at their places; base: counted as a place."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# Phrases and labels that the base result counts.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Opening words of public licences, and how licences are commonly named.
STATEMENTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "are permitted")),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify", "for any purpose")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
)
TEMPLATES = tuple(Template(label, text, (text,), True) for text, label in BASE) + tuple(Template(*s) for s in STATEMENTS)

#: Words commoner than this open no template, but for the rarest of a phrase.
LEAST_IDF = 0.5
#: Places of a template that are compared at once.
PLACES_AT_ONCE = 1 << 17
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _hashed(names: Sequence[str]) -> np.ndarray:
    block = next(blocks(pa.array([" ".join(names)])))
    return words(block, NOT_WORD).hash


class Vocabulary:
    """The words of all templates: names in order, and the number of each word of a block (-1: none of them)."""

    def __init__(self, templates: Sequence[Template]):
        self.names = sorted({w for t in templates for w in t.text.split()})
        hashes = _hashed(self.names)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, w: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w.hash, self.order[at], -1)


class Index:
    """Postings of the templates: words and weights by place, required places, and openers, places of the first key phrase from the rarest word down."""

    def __init__(self, templates: Sequence[Template], idf: dict[str, float]):
        self.templates, self.vocabulary = tuple(templates), Vocabulary(templates)
        number = {w: k for k, w in enumerate(self.vocabulary.names)}
        self.words, self.weights, self.required, self.openers = [], [], [], []
        for template in templates:
            own = template.text.split()
            spans = []
            for key in template.keys:
                k = key.split()
                spans.append(next(range(i, i + len(k)) for i in range(len(own) - len(k) + 1) if own[i : i + len(k)] == k))
            required = np.zeros(len(own), bool)
            for span in spans:
                required[span.start : span.stop] = True
            rarest = sorted(spans[0], key=lambda i: -idf[own[i]])
            self.openers.append([i for i in rarest if i == rarest[0] or idf[own[i]] >= LEAST_IDF])
            self.words.append(np.array([number[w] for w in own]))
            weights = np.array([idf[w] for w in own]) + 1e-9
            self.weights.append(weights / weights.sum())
            self.required.append(required)


def inverse_frequencies(docs: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of each template word, over all documents."""
    vocabulary = Vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.names)
        for batch in batches:
            found = np.zeros(size + 1, np.int64)
            found[size] = batch.num_rows
            for block in blocks(batch.column("text")):
                w = words(block, NOT_WORD)
                numbers = vocabulary.numbers(w)
                known = numbers >= 0
                found[:size] += np.bincount(np.unique(w.text[known] * size + numbers[known]) % size, minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(found)], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r.word: r.n for r in counts.collect()}  # a row for each template word
    total = n.get(len(vocabulary.names), 0)
    return {name: math.log((1 + total) / (1 + n.get(k, 0))) for k, name in enumerate(vocabulary.names)}


def _same_words(block: Block, w: Words, place: int, expected: Sequence[str]) -> bool:
    """Whether the words from a place on are the expected ones, letter by letter."""
    for k, name in enumerate(expected):
        if bytes(block.data[w.start[place + k] : w.end[place + k]]).lower() != name.encode():  # bytes.lower: A-Z only
            return False
    return True


def places(block: Block, w: Words, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each template, where its rarest word stands: the text, where the template would begin, the share of its weight that stands there, and whether the key phrases do."""
    numbers = index.vocabulary.numbers(w)
    ends = np.cumsum(w.per_text)
    known = np.flatnonzero(numbers >= 0)
    owner, number = w.text[known], numbers[known]
    for t, openers in enumerate(index.openers):
        own, weights, required = index.words[t], index.weights[t], index.required[t]
        rank = np.full(len(index.vocabulary.names), len(own))
        for r in reversed(range(len(openers))):
            rank[own[openers[r]]] = r
        best = np.full(block.texts, len(own))
        np.minimum.at(best, owner, rank[number])
        opened = (rank[number] == best[owner]) & (best[owner] < len(own))
        for r in np.unique(rank[number[opened]]).tolist():
            opener, hits = openers[r], known[opened & (rank[number] == r)]
            for cut in range(0, len(hits), PLACES_AT_ONCE):
                some = hits[cut : cut + PLACES_AT_ONCE]
                first, end = ends[w.text[some]] - w.per_text[w.text[some]], ends[w.text[some]]
                share, whole = np.zeros(len(some)), np.ones(len(some), bool)
                for k in np.argsort(-weights, kind="stable"):
                    at = some + (k - opener)
                    inside = (at >= first) & (at < end)
                    same = np.zeros(len(some), bool)
                    same[inside] = numbers[at[inside]] == own[k]
                    share += weights[k] * same
                    if required[k]:
                        whole &= same
                expected = index.templates[t].text.split()
                spans = [i for i in range(len(own)) if required[i]]
                for i in np.flatnonzero(whole):
                    whole[i] = all(_same_words(block, w, some[i] + k - opener, expected[k : k + 1]) for k in spans)
                yield t, w.text[some], some - opener, share, whole


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """A row for each row of docs (doc_id, text; other columns are left out): its licence statements.

    Words are runs of letters and digits of any script, A-Z lower-cased. n_base, first_word, last_word, base_labels: places
    of base templates, all of them, overlapping ones too. labels: also those of templates whose key phrases all stand
    there. score: the largest share of a template's weight at one place, 1 for a whole statement. Null and empty texts have
    no words, no labels (empty strings), null places and score 0; repeated rows each get a row; no rows give none.
    """
    spark_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(templates, inverse_frequencies(spark_docs, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: dict[tuple[int, bool], set[str]] = {}
            for block in blocks(batch.column("text")):
                w = words(block, NOT_WORD)
                n_words[block.first : block.last] = w.per_text
                begins = np.cumsum(w.per_text) - w.per_text
                for t, owner, starts, share, whole in places(block, w, index):
                    template, row = index.templates[t], block.first + owner
                    np.maximum.at(score, row, share)
                    for found in np.unique(row[whole]).tolist():
                        for base in {template.base, False}:
                            labels.setdefault((found, base), set()).add(template.label)
                    if template.base:
                        at = starts[whole] - begins[owner[whole]]
                        np.add.at(n_base, row[whole], 1)
                        np.minimum.at(first, row[whole], at)
                        np.maximum.at(last, row[whole], at)
            joined = {base: pa.array([",".join(sorted(labels.get((row, base), ()))) for row in range(n)], pa.string()) for base in (True, False)}
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), joined[True], joined[False], pa.array(np.minimum(score, 1.0))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return spark_docs.mapInArrow(run, COLUMNS)
