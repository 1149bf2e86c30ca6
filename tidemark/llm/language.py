"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads all bytes of a text, letters, digits, spaces and punctuation alike (capitals of ASCII and Latin-1 as
small letters), in both directions, and labels every byte position with a distribution over languages. A document's
probabilities are the mean over all its positions.

So that a text of any length runs as one matrix of equal rows, it is read in windows of WINDOW bytes that overlap by
CONTEXT bytes on either side: the states of both directions run through the overlap before they label, and each
position is labelled by exactly one window.

The network is trained here in numpy, by backpropagation through time and Adam, on windows of a bounded sample of
documents of each language, at places spread over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.textblocks import Block, blocks

#: Bytes that a window labels, and bytes of overlap read before and behind them.
WINDOW, CONTEXT = 240, 16
#: The training sample: about so many documents of each language, so many windows of each at most, so many bytes long.
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 16
LEARN_BYTES = 40
HIDDEN = 8
STEPS = 400
BATCH = 128
#: Windows computed at once.
TOGETHER = 1024
#: Languages (some 30 bytes each) up to which their shares are sent to every executor.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"

_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:128] = [not chr(b).isalpha() for b in range(128)]
#: Byte 0 stands for what is outside the text.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[0] = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """languages, sorted; for each direction byte table, recurrent weights and biases; output weights."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> "Network":
        w = {}
        for d in "fb":
            w[f"{d}_in"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w[f"{d}_rec"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            w[f"{d}_out"] = rng.normal(0, hidden**-0.5, (hidden, len(languages))).astype(np.float32)
        w["bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)

    def states(self, runs: np.ndarray, direction: str, keep: list | None = None) -> list[np.ndarray]:
        """The hidden state at each position of equally long runs, in order of positions; zero outside the text."""
        table, rec = self.weights[f"{direction}_in"], self.weights[f"{direction}_rec"]
        size = rec.shape[0]
        h = np.zeros((len(runs), size), table.dtype)
        out: list[np.ndarray] = [h] * runs.shape[1]
        for t in range(runs.shape[1]) if direction == "f" else range(runs.shape[1] - 1, -1, -1):
            x, u = table[runs[:, t]], h @ rec
            gates = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            n = np.tanh(x[:, 2 * size :] + r * u[:, 2 * size :])
            live = (runs[:, t] != 0)[:, None]
            before, h = h, (n + z * (h - n)) * live
            out[t] = h
            if keep is not None:
                keep.append((t, before, z, r, n, u[:, 2 * size :], live))
        return out

    def labels(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        logits = forward @ self.weights["f_out"] + backward @ self.weights["b_out"] + self.weights["bias"]
        p = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def summed(self, windows: np.ndarray) -> np.ndarray:
        """Distributions summed over the labelled positions of windows (rows of CONTEXT, labelled and CONTEXT bytes).

        The same as states and labels, with positions in columns and without keeping what isn't needed.
        """
        bytes_ = np.ascontiguousarray(windows.T, dtype=np.intp)
        live = (bytes_ != 0).astype(np.float32)
        size, count = self.weights["f_rec"].shape[0], len(windows)
        last = len(bytes_) - CONTEXT
        kept = np.empty((last - CONTEXT, size, count), np.float32)
        out = np.zeros((len(self.languages), count), np.float32)
        heads = {d: np.ascontiguousarray(self.weights[f"{d}_out"].T) for d in "fb"}
        bias = self.weights["bias"][:, None]
        for d, steps in (("f", range(last)), ("b", range(len(bytes_) - 1, CONTEXT - 1, -1))):
            table, rec = np.ascontiguousarray(self.weights[f"{d}_in"].T), np.ascontiguousarray(self.weights[f"{d}_rec"].T)
            h = np.zeros((size, count), np.float32)
            x, u = np.empty((3 * size, count), np.float32), np.empty((3 * size, count), np.float32)
            for t in steps:
                table.take(bytes_[t], axis=1, out=x, mode="clip")
                np.matmul(rec, h, out=u)
                gates = x[: 2 * size]
                gates += u[: 2 * size]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new = u[2 * size :]
                new *= gates[size:]
                new += x[2 * size :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:size]
                h += new
                h *= live[t]
                if d == "f" and t >= CONTEXT:
                    kept[t - CONTEXT] = h
                elif d == "b" and t < last:
                    p = heads["f"] @ kept[t - CONTEXT]
                    p += heads["b"] @ h
                    p += bias
                    p -= p.max(axis=0)
                    np.exp(p, out=p)
                    p *= live[t] / p.sum(axis=0)
                    out += p
        return out.T

    def gradients(self, runs: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions in texts and its gradients, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        f, b = (np.stack(self.states(runs, d, kept[d])) for d in "fb")
        p = self.labels(f, b)
        live = (runs.T != 0)[:, :, None]
        n = max(int(live.sum()), 1)
        rows = np.arange(len(runs))
        loss = -float((np.log(p[:, rows, truth] + 1e-9) * live[:, :, 0]).sum() / n)
        p[:, rows, truth] -= 1
        p *= live
        p /= n
        g = {k: np.zeros_like(v) for k, v in self.weights.items()}
        g["bias"] = p.sum(axis=(0, 1))
        for d, states in (("f", f), ("b", b)):
            g[f"{d}_out"] = np.tensordot(states, p, ((0, 1), (0, 1)))
            back = p @ self.weights[f"{d}_out"].T
            rec = self.weights[f"{d}_rec"]
            carry = np.zeros_like(states[0])
            inputs = np.zeros((runs.shape[1], len(runs), rec.shape[1]), rec.dtype)
            for t, before, z, r, new, u, alive in reversed(kept[d]):
                carry = (carry + back[t]) * alive
                dn = carry * (1 - z) * (1 - new**2)
                dz = carry * (before - new) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                at_u = np.concatenate([dz, dr, dn * r], axis=1)
                inputs[t] = np.concatenate([dz, dr, dn], axis=1)
                g[f"{d}_rec"] += before.T @ at_u
                carry = carry * z + at_u @ rec.T
            which = (runs.T.reshape(-1)[:, None] == np.arange(256)).astype(rec.dtype)
            g[f"{d}_in"] = which.T @ inputs.reshape(-1, rec.shape[1])
        return loss, g


def fit(runs: np.ndarray, truth: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> Network:
    """Train on equally long runs of bytes (0 where a text ends) with the index of their language, each language as often."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network.start(languages, hidden, rng)
    of = [np.flatnonzero(truth == k) for k in range(len(languages))]
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.array([own[rng.integers(0, len(own))] for own in (of[k] for k in rng.integers(0, len(of), batch))])
        _, grads = net.gradients(runs[pick], truth[pick])
        rate = 0.02 * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        for k, g in grads.items():
            np.clip(g, -1, 1, out=g)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] = net.weights[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def folded(block: Block) -> np.ndarray:
    """The block's bytes, capitals of ASCII and of Latin-1 (two bytes each) as small letters."""
    data = _FOLD[block.data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    return data


def windows_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every window's labelled bytes, and its text."""
    size = np.diff(block.offsets)
    each = -(-size // WINDOW)
    text = np.repeat(np.arange(block.texts), each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = block.offsets[:-1][text] + nth * WINDOW
    return start, np.minimum(start + WINDOW, block.offsets[1:][text]), text


def cut(data: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Rows of length bytes from each start; 0 before first and from last on."""
    at = start[:, None] + np.arange(length)
    inside = (at >= first[:, None]) & (at < last[:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)


def pooled(net: Network, block: Block) -> np.ndarray:
    """texts x languages: the mean distribution of each text's positions; a text without bytes has zeros."""
    total = np.zeros((block.texts, len(net.languages)))
    if not len(block.data):
        return total
    data = folded(block)
    start, end, text = windows_of(block)
    for k in range(0, len(start), TOGETHER):
        own = slice(k, k + TOGETHER)
        rows = cut(data, start[own] - CONTEXT, block.offsets[:-1][text[own]], np.minimum(end[own] + CONTEXT, block.offsets[1:][text[own]]), WINDOW + 2 * CONTEXT)
        beyond = np.arange(WINDOW + 2 * CONTEXT) >= (end[own] - start[own])[:, None] + CONTEXT
        rows[beyond & (end[own] == block.offsets[1:][text[own]])[:, None]] = 0
        sums = net.summed(rows)
        for n in range(total.shape[1]):
            total[:, n] += np.bincount(text[own], sums[:, n], minlength=block.texts)
    return total / np.maximum(np.diff(block.offsets), 1)[:, None]


def _has_letter(block: Block) -> np.ndarray:
    ascii_ = ~_NOT_LETTER & (np.arange(256) < 128)
    count = np.concatenate([[0], np.cumsum(ascii_[block.data])])
    found = count[block.offsets[1:]] > count[block.offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(block.offsets) > 0)):
        found[i] = any(map(str.isalpha, bytes(block.data[block.offsets[i] : block.offsets[i + 1]]).decode("utf-8", "ignore")))
    return found


def held_out(doc_id: Column, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def _learn_from(per_doc: int):
    """lang, place, bytes: windows at places spread over each text; all of a text that is short."""
    schema = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                if not len(block.data):
                    continue
                size = np.diff(block.offsets)
                each = np.minimum(per_doc, -(-size // LEARN_BYTES))
                text = np.repeat(np.arange(block.texts), each)
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                room = np.maximum(size - LEARN_BYTES, 0)[text]
                start = block.offsets[:-1][text] + nth * room // np.maximum(each[text] - 1, 1)
                rows = cut(folded(block), start, block.offsets[:-1][text], block.offsets[1:][text], LEARN_BYTES)
                where = block.first + text
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(where)), pa.array(nth), pa.array([r.tobytes() for r in rows], pa.binary())], schema=schema)

    return run, "lang string, place long, bytes binary"


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """A network for the languages of docs outside the held-out fold; None if there is none.

    Of each language about per_language documents are drawn, those whose id and text hash below a bound that follows
    from the language's number of documents, whatever their length; of each per_doc windows at most, at places spread
    over all of its text. So at most about per_language * per_doc * LEARN_BYTES bytes of a language reach the driver.
    Rows repeated with one id and text count once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = usable.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    lot = F.xxhash64(F.lit(1), "doc_id", "text")
    share = Scratch(docs.sparkSession, "languages").keep(share)  # a row for each language: texts aren't shuffled to it
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share
    drawn = usable.join(share, "lang").filter(F.col("text").isNotNull() & (F.pmod(lot, F.lit(1 << 40)) < F.col("share") * float(1 << 40)))
    drawn = drawn.withColumn("lot", lot).groupBy("lot", "lang").agg(F.first("text").alias("text"))
    run, schema = _learn_from(per_doc)
    found = drawn.select("lang", "text").mapInArrow(run, schema).toArrow().sort_by([("lang", "ascending"), ("place", "ascending"), ("bytes", "ascending")])
    if not found.num_rows:
        return None
    langs = np.array(found.column("lang").to_pylist())
    languages = sorted(set(langs.tolist()))
    runs = np.frombuffer(b"".join(found.column("bytes").to_pylist()), np.uint8).reshape(-1, LEARN_BYTES)
    return fit(runs, np.searchsorted(np.array(languages), langs), languages)


def identify(docs: DataFrame, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, lang, text).

    lang_pred is a language of the training fold, score its pooled probability. A null text and one without a
    letter get ``und`` and 0, as does every row if nothing can be learnt. A null doc_id isn't held out, nor learnt
    from. Repeated rows get equal results. An empty table gives an empty result.
    """
    net = train(docs, **sample)
    kind = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                if net is None:
                    best, score, ok = np.zeros(block.texts, int), np.zeros(block.texts), np.zeros(block.texts, bool)
                else:
                    means = pooled(net, block)
                    best, score, ok = means.argmax(axis=1), np.clip(means.max(axis=1), 0, 1), _has_letter(block)
                names = [net.languages[k] if good else UNKNOWN for k, good in zip(best, ok)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.texts), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))], schema=kind)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
