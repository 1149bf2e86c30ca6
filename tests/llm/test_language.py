"""The network against a version that goes position by position, and its reading of whole texts."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import docs_of
from tidemark.llm import language
from tidemark.llm.textblocks import blocks


def gru(net, data, d):
    """States of one direction over the bytes, in their order."""
    w, h, out = net.weights, np.zeros(net.weights["f_rec"].shape[0]), []
    size = len(h)
    for byte in data if d == "f" else data[::-1]:
        x, u = w[f"{d}_in"][byte].astype(float), h @ w[f"{d}_rec"]
        z, r = (1 / (1 + np.exp(-(x[k : k + size] + u[k : k + size]))) for k in (0, size))
        n = np.tanh(x[2 * size :] + r * u[2 * size :])
        h = (1 - z) * n + z * h
        out.append(h)
    return out if d == "f" else out[::-1]


def slow(net, text):
    """Mean over all positions, each labelled by the window it lies in with the overlap on either side."""
    data = list(text.lower().encode())
    total = np.zeros(len(net.languages))
    for start in range(0, len(data), language.WINDOW):
        low, end = max(0, start - language.CONTEXT), min(len(data), start + language.WINDOW)
        high = min(len(data), end + language.CONTEXT)
        f, b = gru(net, data[low:end], "f"), gru(net, data[start:high], "b")
        for k in range(start, end):
            logits = f[k - low] @ net.weights["f_out"] + b[k - start] @ net.weights["b_out"] + net.weights["bias"]
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / max(len(data), 1)


def test_pooling_against_positions_one_by_one():
    net = language.Network.start(["a", "b", "c"], 5, np.random.default_rng(3))
    w, c = language.WINDOW, language.CONTEXT
    texts = ["", "x", "Hello, World 42!", "ab " * w, "q" * w, "r" * (w + 1), "s" * (w + c), "the " * 300, "é ü ñ " * 90, "Z" * (2 * w - 1)]
    got = np.concatenate([language.pooled(net, b) for b in blocks(pa.array([*texts, None]), limit=1500)])
    assert got.shape == (len(texts) + 1, 3) and not got[0].any() and not got[-1].any()
    for text, row in zip(texts[1:], got[1:]):
        assert row == pytest.approx(slow(net, text), abs=1e-5), text[:9]


def test_every_byte_is_labelled_once():
    sizes = [0, 1, language.WINDOW, language.WINDOW + 1, 5 * language.WINDOW - 1]
    block = next(blocks(pa.array(["x" * n for n in sizes])))
    start, end, text = language.windows_of(block)
    seen = np.zeros(len(block.data), int)
    for a, b in zip(start, end):
        seen[a:b] += 1
    assert (seen == 1).all() and [math.ceil(n / language.WINDOW) for n in sizes] == np.bincount(text, minlength=len(sizes)).tolist()


def test_a_language_of_long_texts_only_is_learnt(spark):
    some = [(k, ("zug wand " if k % 2 else "eau lune ") * (12000 if k % 2 else 5), "de" if k % 2 else "fr", "a") for k in range(40)]
    twice = some + [(1, some[1][1], "de", "b")] * 5 + [(None, "eau lune", "fr", "a"), (99, None, "it", "a")]
    found = language.identify(docs_of(spark, twice)).collect()
    assert len(found) == len(twice)
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "fr") for r in found if r.doc_id is not None and r.doc_id < 40)
    assert sorted(map(str, found)) == sorted(map(str, language.identify(docs_of(spark, twice).repartition(3)).collect()))


def test_gradients_leave_out_what_is_beyond_the_text():
    net = language.Network.start(["a", "b"], 3, np.random.default_rng(1))
    whole, padded = np.array([[97, 98, 99]]), np.array([[97, 98, 99, 0, 0]])
    truth = np.array([1])
    (l1, g1), (l2, g2) = net.gradients(whole, truth), net.gradients(padded, truth)
    assert l1 == pytest.approx(l2, abs=1e-6) and all(np.allclose(g1[k], g2[k], atol=1e-6) for k in g1)
