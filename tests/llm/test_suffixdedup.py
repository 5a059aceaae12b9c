"""Transforms and their merge against sorted suffixes; removal against its definition, byte by byte."""

import random

import numpy as np
import pytest

from stopwise.llm import suffixdedup
from stopwise.llm.bwt import Merge, transforms
from stopwise.llm.suffixdedup import remove_earlier


def collection(rnd, letters=3, pieces=8):
    return [bytes(rnd.randrange(letters) + 65 for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, pieces))]


def symbols(pieces):
    return np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)


def test_transforms_equal_sorted_suffixes():
    rnd = random.Random(1)
    parts = [collection(rnd) for _ in range(30)] + [[b"A" * 50, b"A" * 50, b"A" * 31, b"\x00\x00"]]
    lengths = [sum(len(p) + 1 for p in c) for c in parts]
    edges = np.concatenate(([0], np.cumsum(lengths)))
    got = transforms(np.concatenate([symbols(c) for c in parts]), edges)
    for c, a, b in zip(parts, edges[:-1], edges[1:]):
        rows = sorted((tuple(x + 1 for x in p[i:]) + (0,), n, p[i - 1] + 1 if i else 0) for n, p in enumerate(c) for i in range(len(p) + 1))
        assert got[a:b].tolist() == [r[2] for r in rows]


@pytest.mark.parametrize("size", [1, 3, 8, 13, 18])
def test_merge_finds_repeated_strings(size):
    rnd = random.Random(size)
    for _ in range(20):
        shards = [collection(rnd, letters=2) for _ in range(rnd.randrange(1, 6))]
        merge = Merge([transforms(symbols(c), np.array([0, len(symbols(c))])) for c in shards])
        flat = [p for c in shards for p in c]
        piece, left = merge.pieces()
        order, begins = merge.repeated(size)
        got = sorted(sorted((int(piece[r]), len(flat[piece[r]]) - int(left[r])) for r in part) for part in np.split(order, begins[1:])) if len(order) else []
        where = {}
        for n, p in enumerate(flat):
            for i in range(len(p) - size + 1):
                where.setdefault(p[i : i + size], []).append((n, i))
        assert got == sorted(w for w in where.values() if len(w) > 1)


def brute_force(rows, size):
    last = 1 << 63
    texts = [((last if i is None else i), (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - size + 1):
            w = t[p : p + size]
            first[w] = min(first.get(w, last), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = end + 1
        out.append((-1 if i == last else i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def found(df, **options):
    rows = remove_earlier(df, **options).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in rows)


def copied_rows(seed, alphabet, n=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400)))
        for _ in range(rnd.randrange(4)):
            if rows:
                other = rnd.choice(rows)[1] or ""
                a = rnd.randrange(len(other) + 1)
                at = rnd.randrange(len(text) + 1)
                text = text[:at] + other[a : a + rnd.randrange(30, 200)] + text[at:]
        rows.append((rnd.choice([i, i, i, None, 7]), rnd.choice([text] * 9 + [None])))
    return rows + rows[:5]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "aé日😀\x00"])
def test_removal_equals_definition(spark, monkeypatch, alphabet):
    monkeypatch.setattr(suffixdedup, "SHARD", 3000)
    rows = copied_rows(len(alphabet), alphabet)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_force(rows, 50)


def test_frequent_keys_and_other_sizes(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 3)
    rows = copied_rows(9, "abcdefghij ") + [(100 + i, f"{i:03d}" + "the same words in every document, " * (1 + i % 3) + f"{i:03d}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute_force(rows, 50)
    assert found(df, size=37) == brute_force(rows, 37)


def test_odd_rows(spark, docs, rows, empty):
    mine = [(r[0], r[1]) for r in rows]
    got = found(docs)
    want = brute_force([(i, t if t is None or len(t) < 10_000 else "") for i, t in mine], 50)
    assert [g[:3] for g in got if g[1] < 10_000] == [w[:3] for w in want if w[1] or w[0] != 6]
    assert [g for g in got if g[0] == 6][0][2] == 0
    assert remove_earlier(empty).collect() == []
    periodic = [(1, "ab" * 5000), (2, "ab" * 3000 + "c"), (3, "x" * 49), (4, "x" * 49), (5, "x" * 50), (6, "x" * 50)]
    assert found(spark.createDataFrame(periodic, "doc_id long, text string")) == brute_force(periodic, 50)
