"""Runs: stretches of words that repeat with a period, found as maximal pairs in each document's LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_of, word_keys
from .repeats import _distinct

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 6, 4
#: Characters of text that are worked on at once; a longer document is worked on alone.
CHUNK = 4_000_000

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


class _Interval:
    """The suffixes of an LCP interval: all places in order, and the same by the word to their left."""

    __slots__ = ("places", "lists")

    def __init__(self, place: int, left: int):
        self.places, self.lists = [place], {left: [place]}

    def take(self, other: _Interval) -> None:
        for place in other.places:
            insort(self.places, place)
        for left, mine in other.lists.items():
            held = self.lists.setdefault(left, [])
            for place in mine:
                insort(held, place)


def _pairs(small: _Interval, large: _Interval, left: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Pairs of places from the two, at most `reach` apart, with different words to their left.

    The places of an interval of length l that are within l / 3 of each other are occurrences of one string that overlaps
    itself: they are evenly spaced, and all but the first have the same word to their left.  So the nearest place to the
    right and the furthest one to the left are the only ones that can differ from a place's own class without being a
    multiple of a shorter period.
    """
    only = next(iter(large.lists)) if len(large.lists) == 1 else None
    places = large.places
    for mine, members in small.lists.items():
        if mine == only:
            continue  # no two of these differ to the left
        for p in members:
            i = bisect_left(places, p)
            if i < len(places) and places[i] - p <= reach and left[places[i]] != mine:
                yield p, places[i]
            j = bisect_left(places, p - reach, 0, i)
            if j < i and left[places[j]] != mine:
                yield places[j], p


def _repeated(ids: np.ndarray, doc: np.ndarray, room: np.ndarray, size: int) -> np.ndarray:
    """Places where a sequence of `size` words starts that its document may have elsewhere too (by hash), in order of hash."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64)
    for i in range(size):
        h = (h ^ ids[i : n + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    order = order[room[order] >= size]
    ranked = h[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    return order[same[1:] | same[:-1]]


class _Suffixes:
    """The order of a chunk's suffixes, document by document, as far as `size` words repeat in a document, and their LCPs."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, room: np.ndarray, size: int):
        self.ids, self.room, self.size, n = ids, room, size, len(ids)
        found = _repeated(ids, doc, room, size)
        # What follows a repeated sequence takes part in the order of words, so it is ranked too.
        order = np.union1d(found, (found + size)[room[found] > size])
        words = [doc[order], *(np.where(room[order] > i, ids[np.minimum(order + i, n - 1)], -1) for i in range(size))]
        by = np.lexsort(words[::-1])
        order, fresh = order[by], np.zeros(len(order), bool)
        fresh[:1] = True
        for values in words:
            fresh[1:] |= values[by][1:] != values[by][:-1]
        self.groups = np.cumsum(fresh)
        self.levels, step = [], size
        rank = np.arange(-n - 2, -2)  # all other places are never compared, or differ
        while True:
            starts = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            rank = rank.copy()
            rank[order] = starts
            self.levels.append((step, rank))
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            places = order[at]
            after = np.where(room[places] > step, np.append(rank, np.zeros(1, rank.dtype))[np.minimum(places + step, n)], -1)
            by = np.lexsort((after, starts[at]))
            order[at], after, mine = places[by], after[by], starts[at][by]
            fresh = fresh.copy()
            fresh[at[1:]] |= (after[1:] != after[:-1]) | (mine[1:] != mine[:-1])
            step *= 2
        self.order = order

    def common(self) -> np.ndarray:
        """Words that each suffix shares with its predecessor in the order; 0 between groups."""
        if not len(self.order):
            return np.zeros(0, np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        at = np.flatnonzero(self.groups[1:] == self.groups[:-1])
        a, b = a[at], b[at]
        length, most = np.zeros(len(at), np.int64), np.minimum(self.room[a], self.room[b])
        for step, rank in reversed(self.levels):
            fits = np.flatnonzero(length + step <= most)
            equal = fits[rank[(a + length)[fits]] == rank[(b + length)[fits]]]
            length[equal] += step
        for _ in range(self.size - 1):
            fits = np.flatnonzero(length < most)
            equal = fits[self.ids[(a + length)[fits]] == self.ids[(b + length)[fits]]]
            # Those that stopped differ at this place and stay so.
            length[equal] += 1
        out = np.zeros(len(self.order), np.int64)
        out[at + 1] = length
        return out


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> dict[tuple[int, int], int]:
    """(start, length) -> period of all runs in the documents whose word numbers lie one after the other in ids.

    A run of period q and length n is a pair of suffixes q apart that have n - q words in common and neither the word
    before nor the word after: a maximal pair.  The tree of LCP intervals is built bottom-up, by joining neighbours in
    suffix order at falling LCPs, and pairs come from the smaller of two joined intervals, so each place is looked up
    at most log(n) times.
    """
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(ids))
    # Length n >= periods * q and n >= least, so the common part has at least so many words, whatever q.
    shortest = min(max(least, periods * q) - q for q in range(1, least + 1))
    suffixes = _Suffixes(ids, doc, room, shortest)
    common, order = suffixes.common(), suffixes.order.tolist()
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    left[ends[sizes > 0] - sizes[sizes > 0]] = -1  # a document's first word has nothing to its left
    left = left.tolist()
    parent: dict[int, int] = {}
    held: dict[int, _Interval] = {}

    def root(i: int) -> int:
        while i in parent:
            up = parent[i]
            if up in parent:
                parent[i] = parent[up]
            i = up
        return i

    found: dict[tuple[int, int], int] = {}
    joins = np.flatnonzero(common >= shortest)
    joins = joins[np.argsort(-common[joins], kind="stable")]
    for at, length in zip(joins.tolist(), common[joins].tolist()):
        a, b = root(at - 1), root(at)
        x, y = held.get(a) or _Interval(order[a], left[order[a]]), held.get(b) or _Interval(order[b], left[order[b]])
        if len(x.places) < len(y.places):
            a, b, x, y = b, a, y, x
        for first, second in _pairs(y, x, left, length // (periods - 1)):
            q = second - first
            if length + q >= least:
                key = (first, length + q)
                if q < found.get(key, q + 1):
                    found[key] = q
        x.take(y)
        held.pop(b, None)
        held[a], parent[b] = x, a
    return found


def _dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:n] > 0


def _collapsed(ids: list, texts: list[str], least: int, periods: int) -> pa.RecordBatch:
    keys, sizes = word_keys(texts)
    numbers = _distinct(keys)[1] if len(keys) else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    mine: dict[int, list] = {}
    for (start, length), period in sorted(find_runs(numbers, sizes, least, periods).items(), key=lambda run: (run[0][0], run[1])):
        at = int(np.searchsorted(starts, start, "right")) - 1
        while not sizes[at]:
            at -= 1  # an empty document begins where its successor does
        mine.setdefault(at, []).append((start - int(starts[at]), length, period))
    kept, runs = [], []
    for i, text in enumerate(texts):
        words = text.encode().split()
        if i in mine:
            gone = _dropped(mine[i], len(words)).tolist()
            words = [w for w, g in zip(words, gone) if not g]
        kept.append(b" ".join(words).decode())
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine.get(i, [])])
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    columns = [pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "kept_text"])


def collapse_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, runs by start and period, kept_text.

    Words are separated by white space.  A run is a stretch of words with smallest period q, at least `least` words and
    `periods` * q long, that no neighbouring word extends.  Of each run the first q words stay, unless another run drops
    them; kept_text is the words that stay, joined by one space.  A null or empty text has no words and no runs; null and
    repeated ids are rows like others; an empty table gives an empty result.

    Documents are independent, so nothing is shuffled; texts are taken in chunks of about CHUNK characters, and only
    places whose next words occur twice in their document enter the tree.
    """
    if periods < 4 or least < periods:
        raise ValueError("runs need at least 4 periods")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if texts and held + len(text) > CHUNK:
                    yield _collapsed(ids, texts, least, periods)
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield _collapsed(ids, texts, least, periods)
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(task, RESULT)
