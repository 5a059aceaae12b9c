"""Burrows-Wheeler transforms of collections of short pieces, and their merge by refining an interleave.

A symbol is a byte plus one; 0 ends a piece.  Rows are the suffixes of a collection in order, ends of pieces first and in
the order of the pieces, equal suffixes too.
"""

from __future__ import annotations

import numpy as np

#: The first i of the eight symbols of a number.
_MASKS = np.array([(1 << 64) - (1 << 8 * (8 - i)) for i in range(9)], np.uint64)
#: Bits of a row's number in a key that is sorted whole.
_INDEX = 21


def _sorted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers, and where in that order a new pair begins."""
    n = len(high)
    fresh = np.ones(n, bool)
    if n <= 1 << _INDEX and (not n or max(int(high.max()) >> 64 - 2 * _INDEX - 1, int(low.max()) >> _INDEX) == 0):
        # Pair and index fit into one number, so that values are sorted, which is much faster than an order.
        key = np.sort((high << _INDEX | low) << _INDEX | np.arange(n))
        order, key = key & (1 << _INDEX) - 1, key >> _INDEX
        fresh[1:] = key[1:] != key[:-1]
        return order, fresh
    order = np.lexsort((low, high))
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order, fresh


def transforms(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The transforms of several collections that lie one after the other in text (symbols, each piece ended by 0).

    edges: where collections begin, and the end.  The transform of a collection has its place and length.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the piece's end
    eight = np.ndarray((n,), ">u8", text.tobytes() + bytes(7), strides=(1,)).astype(np.uint64)
    key = eight & _MASKS[np.minimum(left, 8)]
    order = np.empty(n, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        order[a:b] = a + np.argsort(key[a:b], kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    fresh[edges[:-1][edges[:-1] < n]] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    single = fresh & np.append(fresh[1:], True)
    at = np.flatnonzero(~single & (left[order] >= 8))
    step = 8
    while len(at):
        # Members of a group share their first symbols, so all of them go on or none; equal ones keep the order of pieces.
        places = order[at]
        mine, after = rank[places], rank[places + step]
        by = np.lexsort((after, mine))
        places, mine, after = places[by], mine[by], after[by]
        order[at] = places
        fresh = np.ones(len(at), bool)
        fresh[1:] = (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])
        rank[places] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        step *= 2
        at = at[~(fresh & np.append(fresh[1:], True)) & (left[places] >= step)]
    out = text[order - 1]
    first = np.ones(n, bool)
    first[1:] = text[:-1] == 0
    out[first[order]] = 0
    return out


class Merge:
    """Shards' transforms side by side. Rows of all shards are numbered one after the other."""

    def __init__(self, shards: list[np.ndarray]):
        self.symbols = np.concatenate(shards) if shards else np.zeros(0, np.uint8)
        self.edges = np.concatenate(([0], np.cumsum([len(s) for s in shards]))).astype(np.int64)
        #: For each row, that of the suffix with one more symbol before it.
        self.before = np.empty(len(self.symbols), np.int64)
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            self.before[a + np.argsort(self.symbols[a:b], kind="stable")] = np.arange(a, b)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its piece (pieces of all shards in order), and the symbols up to the piece's end."""
        piece, length = np.empty(len(self.symbols), np.int64), np.empty(len(self.symbols), np.int64)
        # A piece's last row comes first in its shard: there are as many as symbols 0.
        counts = [int((self.symbols[a:b] == 0).sum()) for a, b in zip(self.edges[:-1], self.edges[1:])]
        rows = np.concatenate([np.arange(a, a + c) for a, c in zip(self.edges[:-1].tolist(), counts)] or [np.zeros(0, np.int64)])
        mine, steps = np.arange(len(rows)), 0
        while len(rows):
            piece[rows], length[rows] = mine, steps
            goes = self.symbols[rows] > 0
            rows, mine, steps = self.before[rows[goes]], mine[goes], steps + 1
        return piece, length

    def repeated(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose first `size` symbols begin more than one row, interval by interval, and where each interval begins.

        The interleave of the shards is refined until it is right for the first `size` symbols.  A step takes the rows in
        their present order and puts the rows of the suffixes that are longer by up to 16 symbols into order by those
        symbols, which are known from the transforms; blocks are intervals with a common prefix of the present length.
        A block of one row stays one, however long its prefix gets, and is left out.
        """
        symbol, row, valid = self.symbols.astype(np.int64), self.before, self.symbols > 0
        wider = [(1, symbol, row, valid)]
        order, block, done = np.arange(len(symbol)), np.zeros(len(symbol), np.int64), 0
        for width in (2, 4, 8, 16):
            if width > size:
                break
            valid = valid & valid[row]
            if width == 2:
                symbol, row = symbol[row] << 8 | symbol, row[row]
            else:  # only the order of symbols counts, so their ranks stand for them
                mine = np.flatnonzero(valid)
                by, fresh = _sorted(symbol[row[mine]], symbol[mine])
                mine, row = mine[by], row[row]
                symbol = np.zeros(len(symbol), np.int64)
                symbol[mine] = np.cumsum(fresh) - 1
                order, block, done = _shared(row[mine], fresh, width)
            wider.append((width, symbol, row, valid))
        while done < size and len(order):
            width, symbol, row, valid = next(w for w in reversed(wider) if w[0] <= size - done)
            goes = valid[order]
            order, block = order[goes], block[goes]
            by, fresh = _sorted(symbol[order], block)
            order, block, done = _shared(row[order[by]], fresh, done + width)
        return order, np.flatnonzero(np.diff(block, prepend=-1))


def _shared(order: np.ndarray, fresh: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of several rows, numbered anew."""
    several = ~(fresh & np.append(fresh[1:], True))
    return order[several], np.cumsum(fresh[several]) - 1, done
