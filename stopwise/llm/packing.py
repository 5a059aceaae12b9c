"""Packing into sequences of at most 1024 tokens: documents go to tiers of context sizes, and each tier is packed."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .tokenizer import ROWS, encode, trim

CONTEXT = 1024
TIERS = (256, 512, 1024)
#: A sequence may keep so much room; windows that stay emptier are given up and their documents cut at tier sizes.
SLACK = 2
#: Parts in which pieces of one length are numbered at least, and pieces for each of them.
PARTS, PART_ROWS = 256, 50_000
#: Tokens of a step, in longest contexts.
STEP = 64
END_ID = 0


def _cuts(r: int) -> list[tuple[int, int]]:
    """A rest of r tokens cut at tier sizes: (start, length) of its 512, its 256 and its tail."""
    out, at = [], 0
    for size in (512, 256):
        if r - at >= size:
            out.append((at, size))
            at += size
    return out + ([(at, r - at)] if r > at else [])


def _crc_name(size: int) -> str:
    return f"crc_{size}" if size in (512, 256) else "crc_tail"


def _pieces(path: str):
    names = ["doc_id", "start", "length", "crc", "crc_512", "crc_256", "crc_tail", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            doc_ids = batch.column(0).to_pylist()
            for a, ids, counts in encode(batch.column(1).to_pylist(), path):
                rows, at = [], 0
                for i, n in enumerate(counts.tolist()):
                    doc = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    for s in range(0, n + 1, CONTEXT):
                        piece = doc[s : s + CONTEXT]
                        part = dict.fromkeys(names[4:7])
                        if len(piece) < CONTEXT:
                            part |= {_crc_name(size): zlib.crc32(piece[x : x + size].tobytes()) for x, size in _cuts(len(piece))}
                        rows.append((doc_ids[a + i], s, len(piece), zlib.crc32(piece.tobytes()), part["crc_512"], part["crc_256"], part["crc_tail"], n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
        trim(path)

    return run, ", ".join(f"{n} long" for n in names)


def _windows(room: np.ndarray, capacity: int, least: int = 0):
    """Windows of one tier, from counts of lengths: the longest piece over `least` opens each, and its gap is filled with
    the longest pieces that fit, of whatever tier.

    Yields (lengths in descending order with their counts, how many such windows) and takes their pieces out of room.
    Every step uses up the pieces of some length, so the number of windows yielded is bounded by the lengths.
    """
    while room[least + 1 : capacity + 1].any():
        opener = least + 1 + int(np.flatnonzero(room[least + 1 : capacity + 1])[-1])
        used, gap = {opener: 1}, capacity - opener
        while gap:
            fits = np.flatnonzero(room[: gap + 1])
            fits = next((x for x in fits[::-1].tolist() if room[x] > used.get(x, 0)), None) if len(fits) else None
            if fits is None:
                break
            used[fits] = used.get(fits, 0) + 1
            gap -= fits
        times = min(int(room[x]) // k for x, k in used.items())
        for x, k in used.items():
            room[x] -= k * times
        yield sorted(used.items(), reverse=True), times


def _tier(length: int) -> int:
    return next(i for i, size in enumerate(TIERS) if length <= size)


class Plan:
    """Where the pieces of each length go.

    counts[r] is the number of rests of r tokens (r < 1024). A rest's tier is the smallest context that holds it. The
    tier of the longest contexts is packed first, its gaps filled from the shorter tiers; then each shorter tier at its
    own size. A window that is full is a sequence of its tier; nearly full ones of a shorter tier stand side by side in
    one sequence of the longest. The rests of windows that stay too empty are cut at tier sizes: their 512s and 256s
    are full windows, their tails are packed once more.

    slots has rows (key, first rank, last rank + 1, copies per window, offset, first sequence, sequence length,
    first place among the sequences of its tier), key = 2048 * cut + length.
    """

    def __init__(self, counts: dict[int, int]):
        self.slots: list[tuple] = []
        self.sequences = self.tokens = 0
        self.of_tier = [0] * len(TIERS)
        self.next: dict[int, int] = {}
        room, loose = np.zeros(CONTEXT + 1, np.int64), np.zeros(CONTEXT + 1, np.int64)
        for r, n in counts.items():
            room[r] = n
        for capacity, least in zip(TIERS[::-1], (*TIERS[-2::-1], 0)):
            side, near = CONTEXT // capacity, []
            for window, times in _windows(room, capacity, least):
                gap = capacity - sum(x * k for x, k in window)
                if gap == 0:
                    self._add(0, window, times)
                elif gap * side <= SLACK:
                    self._add(0, [(x, k * side) for x, k in window], times // side)
                    near += [window] * (times % side)
                else:
                    self._loosen(loose, window, times)
            whole = len(near) // side * side
            for i in range(0, whole, side):
                together: dict[int, int] = {}
                for x, k in (y for window in near[i : i + side] for y in window):
                    together[x] = together.get(x, 0) + k
                self._add(0, sorted(together.items(), reverse=True), 1)
            for window in near[whole:]:
                self._loosen(loose, window, 1)
        self._cut(loose)

    @staticmethod
    def _loosen(loose: np.ndarray, window: list[tuple[int, int]], times: int):
        for x, k in window:
            loose[x] += k * times

    def _cut(self, loose: np.ndarray):
        self.whole = {r: self.next.get(r, 0) for r in range(1, CONTEXT)}
        # First rank, among pieces of a size, of those that come from rests of r tokens.
        self.base: dict[tuple[int, int], int] = {}
        sizes = np.zeros(CONTEXT + 1, np.int64)
        for r in range(1, CONTEXT):
            for _, size in _cuts(r):
                self.base[r, size] = int(sizes[size])
                sizes[size] += loose[r]
        for size in TIERS[-2::-1]:
            self._add(1, [(size, 1)], int(sizes[size]))
            sizes[size] = 0
        for window, times in _windows(sizes, CONTEXT):
            self._add(1, window, times)

    def _add(self, kind: int, window: list[tuple[int, int]], times: int):
        if not times:
            return
        offset, total = 0, sum(x * k for x, k in window)
        tier = _tier(total)
        for x, k in window:
            key = 2048 * kind + x
            rank = self.next.get(key, 0)
            self.slots.append((key, rank, rank + k * times, k, offset, self.sequences, total, self.of_tier[tier]))
            self.next[key] = rank + k * times
            offset += x * k
        self.sequences += times
        self.tokens += total * times
        self.of_tier[tier] += times


def _placer(plan: Plan, n_full: int):
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 8)
    mark = slots[:, 0] * (1 << 45) + slots[:, 1]
    whole = np.array([0] + [plan.whole[r] for r in range(1, CONTEXT)])
    steps = max(1, round((plan.tokens + n_full * CONTEXT) / (STEP * CONTEXT)))
    tier_first = np.concatenate(([0], np.cumsum(plan.of_tier)[:-1]))
    full_first = plan.of_tier[-1]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "_place"]

    def rows_of(p, length, start, crc, key, rank):
        at = np.searchsorted(mark, key * (1 << 45) + rank, side="right") - 1
        s = slots[at]
        k = rank - s[:, 1]
        lengths = np.full(len(rank), length) if np.isscalar(length) else length
        return [p["doc_id"], p["start"] + start, lengths, crc, p["doc_tokens"], s[:, 5] + k // s[:, 3], s[:, 4] + k % s[:, 3] * length, s[:, 6], s[:, 7] + k // s[:, 3]]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            full = pdf["length"] == CONTEXT
            uncut = ~full & (pdf["rank"].to_numpy() < whole[np.minimum(pdf["length"], CONTEXT - 1)])
            parts = []
            f = pdf[full]
            if len(f):
                rank, none = f["rank"].to_numpy(), np.zeros(len(f), np.int64)
                parts.append([f["doc_id"], f["start"], f["length"], f["crc"], f["doc_tokens"], plan.sequences + rank, none, none + CONTEXT, full_first + rank])
            u = pdf[uncut]
            if len(u):
                parts.append(rows_of(u, u["length"].to_numpy(), 0, u["crc"], u["length"].to_numpy(), u["rank"].to_numpy()))
            for r, c in pdf[~full & ~uncut].groupby("length"):
                for start, size in _cuts(r):
                    rank = c["rank"].to_numpy() - whole[r] + plan.base[r, size]
                    crc = c[_crc_name(size)].astype("int64")
                    parts.append(rows_of(c, size, start, crc, np.full(len(c), 2048 + size), rank))
            for p in parts:
                out = pd.DataFrame(dict(zip(names, (np.asarray(x) if not hasattr(x, "array") else x.reset_index(drop=True) for x in p))))
                tier = np.searchsorted(TIERS, out["sequence_length"])
                out["tier"] = np.array(TIERS)[tier]
                out["step"] = (tier_first[tier] + out.pop("_place")) % steps  # each tier's sequences go round all steps
                yield out

    return run, ", ".join(f"{n} long" for n in names[:-1]) + ", tier int, step long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, tier (the context size that the sequence needs) and step.

    A document is its token ids and an end id; null and empty texts are the end id alone.  Whole contexts of a document
    are sequences of the longest tier; its rest is routed to the smallest tier that holds it, and the tiers are packed
    one after the other (see Plan), from the histogram of rests: 1023 counts, whatever the corpus.  Each tier's
    sequences are dealt evenly to the steps, so that all steps have as many of each tier, and as many tokens, but for
    one sequence of each tier.  A rest finds its place by its rank among all rests of its length; ranks come from
    counts per (length, part) and a numbering inside each, so no task holds all rests of a length.

    Rows with null or repeated ids are documents of their own; rows that agree in id, text and place are alike, so it
    does not matter which of them comes first; an empty table gives no rows.
    """
    run, schema = _pieces(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(run, schema))
    n_parts = max(PARTS, pieces.count() // PART_ROWS)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(n_parts)).cast("int"))
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    n_full = histogram.pop(CONTEXT, 0)
    plan = Plan(histogram)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    mine = Window.partitionBy("length", "part").orderBy("doc_id", "start", "crc", "doc_tokens", "crc_512", "crc_256", "crc_tail")
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(mine) - 1).drop("part", "before")
    place, schema = _placer(plan, n_full)
    return ranked.mapInPandas(place, schema)
