"""Document quality: a generalised additive model with pairwise interactions (GA2M) over text statistics.

Each feature is cut into bins at quantiles. Boosting goes round the features in turn; each turn fits a shallow
tree on the feature's gradient histogram and adds its leaves to the feature's lookup table. Then the pairs whose
two-way cut explains most of what is left are boosted the same way into two-way tables. A score is the logistic of
the intercept plus one table entry for each feature and pair: vectorised bin look-ups and additions, no trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textblocks import LOWER, WHITE, Block, blocks, ngrams, words

FEATURES = (
    "log_words", "word_bytes", "upper_share", "symbol_share", "digit_share", "distinct_words", "distinct_pairs", "repeats",
    "odd_endings", "shouted_words", "letterless_words", "line_share", "top_word_share", "space_share",
)
#: The model is fitted on at most this many labelled rows, those whose ids hash lowest.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3

_CHARS = np.arange(256)
_UPPER = (_CHARS >= 65) & (_CHARS <= 90)
_LETTER = _UPPER | ((_CHARS >= 97) & (_CHARS <= 122)) | (_CHARS >= 128)
_DIGIT = (_CHARS >= 48) & (_CHARS <= 57)
_MARK = np.isin(_CHARS, np.frombuffer(b".,;:'\"-()?", np.uint8))
_SYMBOL = ~_LETTER & ~_DIGIT & ~_MARK & ~WHITE & (_CHARS >= 32)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive positions of at."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and how often its most frequent one stands there."""
    kinds, most = np.zeros(texts), np.zeros(texts)
    cuts = np.searchsorted(owner, np.arange(texts + 1))
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
        own = np.sort(keys[cuts[i] : cuts[i + 1]])
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        kinds[i] = len(heads)
        most[i] = np.diff(np.concatenate([heads, [len(own)]])).max()
    return kinds, most


def features(block: Block) -> np.ndarray:
    """texts x FEATURES; a text without words has zeros throughout."""
    data, offsets, texts = block.data, block.offsets, block.texts
    w = words(block)
    n = np.maximum(w.per_text, 1)
    size = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(_sums(_LETTER[data], offsets), 1)
    out = np.zeros((texts, len(FEATURES)))
    kinds, most = _distinct(w.hash, w.text, texts)
    pair_hash, pair_at = ngrams(w, 2)
    pair_kinds, _ = _distinct(pair_hash, w.text[pair_at], texts)
    per_word = lambda flags: np.bincount(w.text, flags, minlength=texts) / n
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    inside = lambda table: np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    lower, upper, letter = inside(_LETTER & (LOWER == _CHARS) & (_CHARS < 128)), inside(_UPPER), inside(_LETTER)
    within = lambda total: total[w.end] - total[w.start]
    last = data[np.maximum(w.end - 1, 0)] if len(data) else data
    out[:, 0] = np.log1p(w.per_text)
    out[:, 1] = np.bincount(w.text, w.end - w.start, minlength=texts) / n
    out[:, 2] = _sums(_UPPER[data], offsets) / letters
    out[:, 3] = _sums(_SYMBOL[data], offsets) / size
    out[:, 4] = _sums(_DIGIT[data], offsets) / size
    out[:, 5] = kinds / n
    out[:, 6] = pair_kinds / np.maximum(n - 1, 1)
    out[:, 7] = per_word(again)
    out[:, 8] = per_word(_SYMBOL[last])
    out[:, 9] = per_word((within(upper) >= 2) & (within(lower) == 0))
    out[:, 10] = per_word(within(letter) == 0)
    out[:, 11] = _sums(data == 10, offsets) / n
    out[:, 12] = most / n
    out[:, 13] = _sums(WHITE[data], offsets) / size
    return out


@dataclass
class AdditiveModel:
    """intercept; edges: of each feature's bins; tables: one for each feature; pairs: (i, j, coarse edges of both, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, k], "right")]
        for i, j, of_i, of_j, values in self.pairs:
            total += values[np.searchsorted(of_i, x[:, i], "right"), np.searchsorted(of_j, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0 if none gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and gain.max() > 1e-9 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf value of every bin, for a tree of the given depth over one histogram."""
    at = _cut(g, h, ridge)[1] if depth else 0
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    return np.concatenate([_shallow_tree(g[:at], h[:at], depth - 1, ridge), _shallow_tree(g[at:], h[at:], depth - 1, ridge)])


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cross cut of a two-way histogram."""
    best, values = 0.0, np.zeros(g.shape)
    corner = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = corner(g), corner(h)
    base = cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            parts = [(c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]) for c in (cg, ch)]
            gain = sum(p**2 / (q + ridge) for p, q in zip(*parts)) - base
            if gain > best:
                best, leaves = gain, [_leaf(p, q, ridge) for p, q in zip(*parts)]
                values = np.empty(g.shape)
                values[:a, :b], values[:a, b:], values[a:, :b], values[a:, b:] = leaves
    return best, values


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 80, depth: int = 2, rate: float = 0.1, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 20, ridge: float = 1.0
) -> AdditiveModel:
    """Fit by cyclic boosting of the logistic loss. Without rows of both labels the model is its intercept."""
    rate_1 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    quantiles = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1])) if len(v) else np.zeros(0)
    width = x.shape[1]
    edges = [quantiles(x[:, k], bins) for k in range(width)]
    model = AdditiveModel(float(np.log(rate_1 / (1 - rate_1))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if len(np.unique(y)) < 2:
        return model
    binned = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(width):
            g, h = slope()
            size = len(model.tables[k])
            step = rate * _shallow_tree(np.bincount(binned[k], g, size), np.bincount(binned[k], h, size), depth, ridge)
            model.tables[k] += step
            total += step[binned[k]]
    coarse = [quantiles(x[:, k], pair_bins) for k in range(width)]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def two_way(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slope()
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        flat = cells[i] * shape[1] + cells[j]
        return _quadrants(*(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), ridge)

    ranked = sorted(((two_way(i, j)[0], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)[:pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, _, _, values in model.pairs:
            step = rate * two_way(i, j)[1]
            values += step
            total += step[cells[i], cells[j]]
    return model


def text_features(text: Column) -> Column:
    """The features of a text column as array<double>."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        rows = [features(b) for b in blocks(column)]
        flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.reshape(-1)))

    return run(text)


def score(model: AdditiveModel, text: Column) -> Column:
    """Score of a text column under a model, 0 to 1."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        parts = [model.score(features(b)) for b in blocks(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text divides by folds. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold: of their ids, the max_rows that hash lowest.

    Labels null or with a null id are left out; an id labelled more than once counts with its largest label.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))
    found = rows.select("doc_id", text_features(F.col("text")).alias("x"), "y").orderBy("doc_id").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(x, (found.column("y").to_numpy() > 0.5).astype(float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; the text alone makes the score, null counting as empty.

    Repeated rows get equal scores; without usable labels every score is 0.5. An empty table gives an empty result.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(train(docs, labels), F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all columns, without the rows that the classifier scores below the threshold."""
    return docs.filter(score(train(docs, labels), F.col("text").cast("string")) >= threshold)
