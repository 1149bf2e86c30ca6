"""Stupid-backoff language-model scores, with n-gram counts over all documents.

S(w | h) = count(h w) / count(h) if h w occurs, else alpha * S(w | shorter h); the last resort is count(w) / N, or
1 / (N + 1) for a word that occurs nowhere else. Counts leave out the scored document's own n-grams, so that a text
is judged by the rest of the corpus.

Relational plan: the rows of a part of the table are packed into chunks of a bounded number of bytes, as they come, and
written; texts are not shuffled to be counted. A chunk's distinct n-grams, with their counts, form sorted runs that are
cut by hash into partitions of the count table and packed (one row for a chunk and a partition, in place of a row for
each n-gram). A partition adds up the counts of all chunks and answers each chunk with the totals of the n-grams it
sent. The answers are joined to the chunk's documents, whose exploded n-grams look their totals up and are summed by
document. An n-gram is sent once by a chunk however often it occurs there, so a frequent one is no hot key: its
partition gets one entry of each chunk. Neither are repeated or missing ids, as chunks don't go by ids.

Hashes of n-grams have SPARE_BITS more bits than the corpus's number of words (LEAST_BITS at least, 64 at most), so that
about one n-gram in 2^SPARE_BITS shares its count with another one, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.textblocks import blocks, ngrams, words

ORDER = 2
ALPHA = 0.4
#: Bytes of text in a chunk, at most (a longer text is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: N-grams that a partition of the count table gets from all chunks, about.
PART_GRAMS = 4_000_000
SPARE_BITS, LEAST_BITS = 22, 48
#: Effort of compressing a chunk's rows, which are written twice.
LEVEL = 12


def pack(values: np.ndarray) -> bytes:
    """A run of integers as byte planes, compressed: small or slowly rising values take few bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


@dataclass
class Tokens:
    """The words of a chunk's texts: hash and text of each, and the number of each text's."""

    hash: np.ndarray
    text: np.ndarray
    per_text: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Tokens":
        hashes, owners, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in blocks(texts):
            w = words(block)
            hashes.append(w.hash)
            owners.append(w.text + block.first)
            counts.append(w.per_text)
        return cls(np.concatenate(hashes), np.concatenate(owners), np.concatenate(counts))

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words within a text, and the place of its last word."""
        h, at = ngrams(self, n)
        return h >> np.uint64(64 - bits), at + (n - 1)


def _chunks(chunk_bytes: int):
    """Rows (doc_id, text) in their order as chunks: their number of words, and the rows as a compressed Arrow stream."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])
    schema = pa.schema([("n_words", pa.int64()), ("docs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = n_words = 0

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as writer:
                writer.write_table(pa.concat_tables(held).combine_chunks())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([n_words], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for block in blocks(texts, min(chunk_bytes, 2 << 20)):
                if held and size + len(block.data) > chunk_bytes:
                    yield chunk()
                    size = n_words = 0
                held.append(pa.Table.from_arrays([batch.column("doc_id").slice(block.first, block.texts), texts.slice(block.first, block.texts)], schema=kind))
                size += len(block.data)
                n_words += len(words(block).hash)
        if held:
            yield chunk()

    return run, "n_words long, docs binary"


def _opened(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all()


def _bounds(partitions: int, bits: int) -> np.ndarray:
    """The least hash of each partition but the first."""
    return np.array([-(-(k << bits) // partitions) for k in range(1, partitions)], np.uint64)


def _count(order: int, partitions: int, bits: int):
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("size", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column("chunk").to_pylist(), batch.column("docs")):
                tokens = Tokens.of(_opened(docs.as_buffer()).column("text").combine_chunks())
                for n in range(1, order + 1):
                    distinct, counts = np.unique(tokens.grams(n, bits)[0], return_counts=True)
                    cuts = [0, *np.searchsorted(distinct, _bounds(partitions, bits)).tolist(), len(distinct)]
                    rows = []
                    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if a < b:
                            rises = np.diff(distinct[a:b], prepend=distinct[a : a + 1])
                            rises[0] = distinct[a]
                            rows.append((part, chunk, n, b - a, pack(rises), pack(counts[a:b])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, "part int, chunk long, n int, size int, grams binary, counts binary"


def _total(order: int):
    """Totals of a partition's n-grams, as asked for by each chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("totals", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = []
        asked = table.to_pylist()
        for n in range(1, order + 1):
            own = [r for r in asked if r["n"] == n]
            grams = [np.cumsum(unpack(r["grams"], r["size"]), dtype=np.uint64) for r in own]
            if not own:
                continue
            distinct, which = np.unique(np.concatenate(grams), return_inverse=True)
            counts = np.bincount(which, np.concatenate([unpack(r["counts"], r["size"]) for r in own]), minlength=len(distinct)).astype(np.uint64)
            at = 0
            for r in own:
                mine = counts[which[at : at + r["size"]]]
                at += r["size"]
                rows.append((r["chunk"], key[0].as_py(), n, r["size"], pack(mine)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return run, "chunk long, part int, n int, size int, totals binary"


def score_texts(tokens: Tokens, totals: list[np.ndarray], bits: int, corpus: int, alpha: float, leave_out: bool) -> np.ndarray:
    """Sum of log scores of each text. totals: for each length, corpus counts of the sorted distinct n-grams."""
    n_words = len(tokens.hash)
    own_words = tokens.per_text[tokens.text]
    left = (corpus - own_words) if leave_out else np.full(n_words, corpus)
    score = np.zeros(n_words)
    shorter = np.zeros(0)
    for n, total in enumerate(totals, 1):
        h, last = tokens.grams(n, bits)
        which = np.unique(h, return_inverse=True)[1]
        count = total[which].astype(np.float64)
        if leave_out:
            _, place, own = np.unique(tokens.text[last] * max(len(total), 1) + which, return_inverse=True, return_counts=True)
            count -= own[place]
        if n == 1:
            score = np.log(np.where(count > 0, count, 1.0)) - np.log(np.where(count > 0, np.maximum(left, 1), left + 1))
        else:
            seen = count > 0
            backed = score[last] + math.log(alpha)
            with np.errstate(divide="ignore", invalid="ignore"):
                score[last] = np.where(seen, np.log(count) - np.log(shorter[last - 1]), backed)
        shorter = np.ones(n_words)
        shorter[last] = count
    ends = np.cumsum(tokens.per_text)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    return sums[ends] - sums[ends - tokens.per_text]


def _score(order: int, alpha: float, leave_out: bool, corpus: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_score", pa.float64())])

    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _opened(chunk.column("docs")[0].as_buffer())
        tokens = Tokens.of(docs.column("text").combine_chunks())
        found: list[list] = [[] for _ in range(order)]
        for r in sorted(answers.select(["part", "n", "size", "totals"]).to_pylist(), key=lambda r: r["part"]):
            found[r["n"] - 1].append(unpack(r["totals"], r["size"]))
        totals = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]
        scores = score_texts(tokens, totals, bits, corpus, alpha, leave_out)
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(tokens.per_text), pa.array(scores)], schema=schema)

    return run, "doc_id long, n_tokens long, log_score double"


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, log_score, mean_log_score for every row of docs (doc_id, text; more columns are left out).

    Words are runs without white space, A-Z lower-cased; log_score sums natural logs over them. A text without
    words (or null) has 0 and a null mean. A repeated row is a document of its own, of which the others are part
    of the corpus, and so is each row without an id. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "backoff")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _chunks(chunk_bytes)
    chunks = scratch.keep(rows.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id()))
    corpus = chunks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(64, max(LEAST_BITS, SPARE_BITS + max(1, corpus).bit_length()))
    partitions = max(1, -(-order * corpus // PART_GRAMS))
    run, schema = _count(order, partitions, bits)
    counted = chunks.select("chunk", "docs").mapInArrow(run, schema)
    run, schema = _total(order)
    totals = counted.groupBy("part").applyInArrow(run, schema)
    run, schema = _score(order, alpha, leave_out, corpus, bits)
    scored = chunks.select("chunk", "docs").groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, schema)
    return scored.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
