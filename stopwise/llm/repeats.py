"""Which keys occur more than once in the whole corpus, asked and answered in bulk.

A unit is a group of documents that one task holds.  It sends each of its distinct keys
once, sorted and cut into buckets, as one binary row per bucket, with a bit for keys that
it holds twice itself.  A bucket's task sums over all units and sends one bit per key
back.  A key that fills the corpus therefore costs one entry per unit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

REQUEST = "unit int, bucket int, width int, keys binary, twice binary"
ANSWER = "unit int, bucket int, flags binary"


def _distinct(keys: np.ndarray):
    """Distinct rows of an (n, width) array in order, the index of each row among them, and their counts."""
    order = np.argsort(keys[:, 0])
    ranked = keys[order]
    if keys.shape[1] > 1 and ((ranked[1:, 0] == ranked[:-1, 0]) & (ranked[1:, 1:] != ranked[:-1, 1:]).any(axis=1)).any():
        order = np.lexsort(keys.T[::-1])  # different keys agree in their first number
        ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[at], inverse, np.diff(np.append(at, len(keys)))


def _parts(distinct: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that have keys; there may be many more buckets than keys."""
    top = distinct[:, 0] >> np.uint64(64 - bits) if bits else np.zeros(len(distinct), np.uint64)
    filled, at = np.unique(top, return_index=True)
    return list(zip(filled.tolist(), at.tolist(), [*at[1:].tolist(), len(top)]))


def ask(unit: int, keys: np.ndarray, bits: int) -> pd.DataFrame:
    distinct, _, counts = _distinct(keys)
    rows = [(unit, b, keys.shape[1], distinct[x:y].tobytes(), np.packbits(counts[x:y] > 1).tobytes()) for b, x, y in _parts(distinct, bits)]
    return pd.DataFrame(rows, columns=["unit", "bucket", "width", "keys", "twice"])


def read_answer(keys: np.ndarray, bits: int, answer: pd.DataFrame) -> np.ndarray:
    """For each of the keys that were asked: does it occur more than once?"""
    if not len(keys):
        return np.zeros(0, bool)
    distinct, inverse, _ = _distinct(keys)
    flags, told = np.zeros(len(distinct), bool), dict(zip(answer["bucket"], answer["flags"]))
    for b, x, y in _parts(distinct, bits):
        flags[x:y] = np.unpackbits(np.frombuffer(told[b], np.uint8))[: y - x]
    return flags[inverse]


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    width = int(rows["width"].iloc[0])
    keys = [np.frombuffer(k, "<u8").reshape(-1, width) for k in rows["keys"]]
    times = [1 + np.unpackbits(np.frombuffer(t, np.uint8))[: len(k)].astype(np.int64) for k, t in zip(keys, rows["twice"])]
    _, inverse, _ = _distinct(np.concatenate(keys))
    found = np.bincount(inverse, weights=np.concatenate(times))[inverse] > 1
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pd.DataFrame({"unit": rows["unit"], "bucket": rows["bucket"], "flags": [np.packbits(f).tobytes() for f in np.split(found, cuts)]})


def answers(requests: DataFrame) -> DataFrame:
    return requests.groupBy("bucket").applyInPandas(_count, ANSWER)
