"""The prefix trie against a version that keeps every prefix in a dictionary, with pieces of a few rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth string, piece string, kind string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(rows):
    def place(t):
        role, text = t[1] or "", t[2] or ""
        return (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role, text))
    own = {c: [(r or "", x or "") for _, r, x in sorted(t, key=place)] for c, t in own.items()}
    whole = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4 :] for c, t in own.items()}
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in children.get(p, [])) + (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], ends[p]) for p, m in members.items())


def of(spark, rows, parts=3, **sizes):
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROWS).repartition(parts)
    got = prefix_trie.prefix_trie(frame, **sizes).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def made(seed, convs=160):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(900), convs):
        kind = rng.random()
        turns = 1 if kind < 0.1 else rng.randrange(1, 6)
        for t in range(turns):
            text = rng.choice(["one", "one two", "one two", None, " a\tb c "]) if t < 3 or kind > 0.5 else rng.choice(["x", "y y", f"own {c}"])
            out.append((c, rng.choice([t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "user", None]), text))
    for c in range(1000, 1080):  # copies
        out += [(c, t, "user", "the same words") for t in range(7)]
    out += [(2000, t, "user", f"long {t // 2}") for t in range(300)] + [(2001, t, "user", f"long {t // 2}") for t in range(290)] + [(None, 0, "user", "lost")]
    return out + out[:5]


@pytest.mark.parametrize("piece_rows", [100_000, 7, 1])
def test_trie_equals_a_plain_version(spark, piece_rows):
    rows = made(piece_rows)
    assert of(spark, rows, piece_rows=piece_rows) == plain(rows)


def test_small_tables(spark):
    assert of(spark, []) == []
    assert of(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(5, 0, "user", "x")], [(3, 0, "user", "x"), (3, 1, "user", "x y"), (4, 0, "user", "z")], [(k, 0, "u", "same") for k in range(40)]):
        assert of(spark, rows) == plain(rows) == of(spark, rows, piece_rows=1)


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        a = rng.integers(0, 9, n)
        minima = prefix_trie.RangeMinima(a)
        at, bound = rng.integers(0, n, 200), rng.integers(0, 10, 200)
        for i, b, before, after in zip(at, bound, minima.before(at, bound), minima.after(at, bound)):
            assert before == max([k for k in range(i + 1) if a[k] < b], default=-1)
            assert after == min([k for k in range(i, n) if a[k] < b], default=n)
        first = rng.integers(0, n, 200)
        last = np.maximum(first, rng.integers(0, n, 200))
        assert all(v == a[f : l + 1].min() for f, l, v in zip(first, last, minima.least(first, last)))
