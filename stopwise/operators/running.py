"""Order statistics along steps: each key's values come and go, and asked steps are answered from a tree of counts.

Rows of a key lie together (see history.History).  A value is present in spans of steps.  All keys of a chunk are advanced
at once, step by step: counts per distinct value are kept in Fenwick trees side by side in one array, so a value's coming
or going costs the logarithm of its key's distinct values, and so does a median.  No row is made per value and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are worked on at once; a key is never cut.
CHUNK = 200_000


class _Trees:
    """Counts per (key, value) in Fenwick trees, and count, sum and sum of squares per key."""

    def __init__(self, key: np.ndarray, y: np.ndarray, n: np.ndarray, keys: int):
        order = np.lexsort((y, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (y[order][1:] != y[order][:-1])
        self.values = y[order][fresh]
        self.size = np.bincount(key[order][fresh], minlength=keys)
        self.first = np.cumsum(self.size) - self.size
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        self.place = place - self.first[key] + 1
        self.tree = np.zeros(len(self.values) + 1, np.int64)
        wide = len(n) and float((np.abs(n).astype(float) * y.astype(float) ** 2).sum()) >= 2.0**62
        self.kind = object if wide else np.int64
        self.key, self.y, self.n = key, y.astype(self.kind), n
        self.count = np.zeros(keys, np.int64)
        self.sum, self.squares = np.zeros(keys, self.kind), np.zeros(keys, self.kind)

    def change(self, rows: np.ndarray, sign: np.ndarray) -> None:
        key, n = self.key[rows], self.n[rows] * sign
        np.add.at(self.count, key, n)
        np.add.at(self.sum, key, n * self.y[rows])
        np.add.at(self.squares, key, n * self.y[rows] * self.y[rows])
        place, size, first = self.place[rows], self.size[key], self.first[key] - 1
        while len(place):
            np.add.at(self.tree, first + place, n)
            place = place + (place & -place)
            stays = place <= size
            place, size, first, n = place[stays], size[stays], first[stays], n[stays]

    def ranked(self, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value with `rank` values before it, of each key."""
        place, left, first, size = np.zeros(len(key), np.int64), rank.copy(), self.first[key] - 1, self.size[key]
        bit = 1 << int(size.max(initial=1)).bit_length()
        while bit:
            to = place + bit
            fits = np.flatnonzero(to <= size)
            held = self.tree[(first + to)[fits]]
            goes = fits[held <= left[fits]]
            left[goes] -= self.tree[(first + to)[goes]]
            place[goes] = to[goes]
            bit >>= 1
        return self.values[first + place + 1]

    def statistics(self, key: np.ndarray) -> list[pa.Array]:
        """n, median, mean and sample deviation of keys that have values."""
        n = self.count[key]
        median = (self.ranked(key, (n - 1) // 2) + self.ranked(key, n // 2)) / 2
        s, q = self.sum[key], self.squares[key]
        big = len(n) and float(n.max()) * float(max(q.max(), 1)) >= 2.0**62
        m, s2, q2 = (x.astype(object) for x in (n, s, q)) if big else (n, s, q)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt((m * q2 - s2 * s2).astype(np.float64) / (n.astype(np.float64) * (n - 1)))
        return [pa.array(n), pa.array(median.astype(np.float64)), pa.array(s.astype(np.float64) / n), pa.array(spread, mask=n < 2)]


def _keys(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where a new key begins. Null is a value of its own."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for name in names:
        codes = table[name].combine_chunks().dictionary_encode()
        codes = pc.fill_null((codes if isinstance(codes, pa.Array) else codes.combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return fresh


def _answered(table: pa.Table, fresh: np.ndarray, names: Sequence[str], steps: int, asked: bool) -> Iterator[pa.RecordBatch]:
    key = np.cumsum(fresh) - 1
    ask = pc.is_valid(table["step"]).to_numpy()
    mine = np.flatnonzero(~ask)
    spans = table["spans"].combine_chunks().take(pa.array(mine))
    trees = _Trees(key[mine], table["y"].to_numpy()[mine].astype(np.int64), table["n"].to_numpy()[mine].astype(np.int64), int(key[-1]) + 1)
    size = np.diff(spans.offsets.to_numpy())
    row, when = np.repeat(np.arange(len(mine)), size), spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sign = 1 - 2 * ((np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)) % 2)
    order = np.argsort(when, kind="stable")
    row, when, sign = row[order], when[order], sign[order]
    places = np.flatnonzero(ask)
    at = table["step"].to_numpy()[places].astype(np.int64) if asked else None
    representative, done = np.flatnonzero(fresh), 0
    for step in sorted(set(at.tolist())) if asked else range(steps):
        upto = int(np.searchsorted(when, step, "right"))
        trees.change(row[done:upto], sign[done:upto])
        done = upto
        chosen = key[places[at == step]] if asked else np.arange(len(representative))
        chosen = chosen[trees.count[chosen] > 0]
        if len(chosen):
            known = table.select(names).take(pa.array(representative[chosen])).combine_chunks()
            columns = [known[c].combine_chunks() for c in names] + [pa.array(np.full(len(chosen), step, np.int32)), *trees.statistics(chosen)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "step", "n", "median", "mean", "std"])


def along(names: Sequence[str], steps: int, asked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows in order of `names`: (names, spans, y, n, step).

    Rows without step hold n times the value y in the steps [spans[0], spans[1]), [spans[2], spans[3]) and so on.  The
    answer to a row with a step is the statistics of its key there; without `asked`, all keys are answered at all steps.
    Keys without values at a step give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK:
                table = pa.Table.from_batches(held)
                fresh = _keys(table, names)
                cut = int(np.flatnonzero(fresh)[-1])
                if cut:
                    yield from _answered(table.slice(0, cut), fresh[:cut], names, steps, asked)
                held, count = table.slice(cut).to_batches(), table.num_rows - cut
        if count:
            table = pa.Table.from_batches(held)
            yield from _answered(table, _keys(table, names), names, steps, asked)

    return run
