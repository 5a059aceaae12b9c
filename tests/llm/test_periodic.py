"""Runs against their definition, period by period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stopwise.llm.periodic import collapse_runs, find_runs


def runs_of(words, least=6, periods=4):
    """Every maximal stretch of every period, kept under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def found_in(lists):
    numbers = {w: i for i, w in enumerate(sorted({w for x in lists for w in x}))}
    ids = np.array([numbers[w] for x in lists for w in x], np.int64)
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = [[] for _ in lists]
    for (s, n), q in find_runs(ids, sizes).items():
        at = max(i for i in range(len(lists)) if starts[i] <= s and sizes[i])
        out[at].append((s - int(starts[at]), n, q))
    return [sorted(x) for x in out]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_definition(letters):
    rnd = random.Random(letters)
    lists = []
    for _ in range(150):
        words = [rnd.randrange(letters) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            unit = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 7))]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = unit * rnd.randrange(2, 9) + unit[: rnd.randrange(len(unit))]
        lists.append(words)
    assert found_in(lists) == [runs_of(x) for x in lists]


def test_runs_inside_runs():
    unit = ["a"] * 7 + ["b"]
    words = ["x"] + (unit * 5 + ["c"]) * 4 + ["y"]
    assert found_in([words]) == [runs_of(words)] and len(runs_of(words)) > 20


def test_long_run_and_long_text():
    words = ["the"] * 30_000 + [f"w{i}" for i in range(30_000)] + ["on", "and"] * 10_000
    assert found_in([words]) == [[(0, 30_000, 1), (60_000, 20_000, 2)]]


def test_documents_do_not_meet():
    assert found_in([["a"] * 5, [], ["a"] * 5, ["a"] * 6]) == [[], [], [], [(0, 6, 1)]]


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_operator_on_odd_rows(spark, docs, rows, empty):
    more = spark.createDataFrame([(50, "Ü" + " go\tgo" * 4), (None, "la " * 9), (50, "a b " * 3 + "a b c")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in collapse_runs(both).collect())
    want = []
    for doc_id, text in [(r[0], r[1]) for r in rows] + [(r[0], r[1]) for r in more.collect()]:
        words = words_of(text)
        runs = runs_of(words) if len(words) < 1000 else []
        want.append((doc_id or -1, len(words), runs, kept(words, runs)))
    assert got == sorted(want)
    assert collapse_runs(docs).count() == docs.count() and collapse_runs(empty).collect() == []


def test_query_equals_contract(spark, tmp_path):
    from stopwise.llm.queries import op12_periodic_runs

    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randrange(0, 70)))) for i in range(150)] + [(500, None), (501, ""), (None, "x x x x x x x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = runs_of(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept(words, runs))]
        want.append((-1 if doc_id is None else doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [(-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in names)) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[1] > 0 for w in want) > 5
