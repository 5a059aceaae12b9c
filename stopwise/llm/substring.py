"""Removal of repeated passages: difference-cover anchors find candidates, whole windows decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import input_units, scrambled, text_of, word_keys

WINDOW = 35
#: A difference cover: every distance modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: A bucket of keys holds about as many as so many units do.
UNITS_PER_BUCKET = 2
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def _rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every `size` consecutive entries, modulo 2**64."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.full(n, base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n - size + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * power)))
    return scrambled((sums[size:] - sums[:-size]) * back)


class _Unit:
    """The words of a group of documents as one array of hashes."""

    def __init__(self, docs: pd.DataFrame, window: int):
        self.docs = docs
        self.hashes, self.sizes = word_keys(docs["text"].tolist())
        self.ends = np.cumsum(self.sizes)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.ends - self.sizes, self.sizes)
        self.left = np.repeat(self.ends, self.sizes) - np.arange(len(self.hashes))  # words from here to the document's end
        self.window = window
        self.unit = int(docs["unit"].iloc[0]) if len(docs) else 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors and their keys: windows at cover positions only, so short that each long match holds an aligned one."""
        size = self.window - PERIOD + 1
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= size))
        return at, _rolling(self.hashes[:, 0], size, _BASES[0])[at][:, None]

    def candidates(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of whole windows that hold one of the repeated anchors, and their 128-bit keys."""
        n = len(self.hashes)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.maximum(anchors - PERIOD + 1, 0), 1)
        np.add.at(step, anchors + 1, -1)
        starts = np.flatnonzero((np.cumsum(step)[:n] > 0) & (self.left >= self.window))
        keys = np.stack([_rolling(self.hashes[:, i], self.window, _BASES[i]) for i in (0, 1)], axis=1) if n >= self.window else np.zeros((0, 2), np.uint64)
        return starts, keys[starts]

    def removed(self, starts: np.ndarray) -> pd.DataFrame:
        n = len(self.hashes)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + self.window, -1)
        gone = np.cumsum(step)[:n] > 0
        rows = []
        for doc_id, text, b in zip(self.docs["doc_id"], self.docs["text"], self.ends):
            words = text.encode().split()
            mine = gone[b - len(words) : b]
            if mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
                text = b" ".join([w for w, g in zip(words, mine.tolist()) if not g])
            else:
                spans, text = [], b" ".join(words)
            rows.append((doc_id, len(words), int(mine.sum()), spans, text.decode()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "removed", "kept_text"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, removed word spans, kept_text.

    Words are separated by white space (space and control characters 9 to 13).  Each word
    covered by a window of `window` words whose sequence also starts anywhere else, in any
    document, is removed; windows are judged on the input.  kept_text is the other words
    joined by one space.  Null texts have no words; documents shorter than a window lose
    nothing; all copies of a repeated passage go; an empty table gives an empty result.

    Only windows of `window` - 20 words at 5 of 21 positions are hashed first.  Any two
    equal windows share such an anchor at the same distance from their start, so whole
    windows need a look only around anchors that occur twice; these are compared by 128
    bits over the corpus.  No pairs are made: a passage of any frequency costs each unit
    of documents one entry.  A unit sends one row to each bucket that it has keys for, so there are never more rows
    than distinct keys; a bucket takes the keys of UNITS_PER_BUCKET units on average.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    units = input_units(docs)
    bits = max(1, (-(-units // UNITS_PER_BUCKET) - 1).bit_length())
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(units)).cast("int").alias("unit"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    groups = rows.groupBy("unit")

    def ask_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        u = _Unit(pdf, window)
        return repeats.ask(u.unit, u.anchors()[1], bits)

    def found(u: _Unit, answer: pd.DataFrame):
        at, keys = u.anchors()
        return u.candidates(at[repeats.read_answer(keys, bits, answer)])

    def ask_windows(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        u = _Unit(pdf, window)
        return repeats.ask(u.unit, found(u, answer)[1], bits)

    def finish(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        u = _Unit(pdf, window)
        starts, keys = found(u, answer[answer["step"] == 1] if len(answer) else _NONE)
        hits = repeats.read_answer(keys, bits, answer[answer["step"] == 2] if len(answer) else _NONE)
        return u.removed(starts[hits])

    first = repeats.answers(groups.applyInPandas(ask_anchors, repeats.REQUEST))
    second = repeats.answers(groups.cogroup(first.groupBy("unit")).applyInPandas(ask_windows, repeats.REQUEST))
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return groups.cogroup(both.groupBy("unit")).applyInPandas(finish, RESULT)


_NONE = pd.DataFrame({"bucket": [], "flags": [], "step": []})
