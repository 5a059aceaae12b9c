"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a memo; two generations of it take about 50 MB, in every Python worker.
MEMO = 150_000
#: Characters that the keys of a memo's generation have at most, and those of one key.
MEMO_SIZE, LONG_KEY = 8_000_000, 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one will do on a single machine only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and computes it once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing will read any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's limit of rows in an Arrow batch. Whole texts travel in these batches, several copies of them at
    once in an executor and its Python workers, and the default of 10000 rows is made for numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def input_units(df: DataFrame, per_partition: int = 4, least: int = 8) -> int:
    """How many groups of documents to work on at once: follows the size of the input by its number of partitions."""
    return max(least, per_partition * df.rdd.getNumPartitions())


class Memo(dict):
    """key -> make(key), of strings or bytes; two generations, so that common keys stay when it is full.

    Full means `most` entries or MEMO_SIZE characters. Very long keys are made each time.
    """

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most, {}, 0

    def __missing__(self, key):
        if len(key) > LONG_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most or self.held > MEMO_SIZE:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += len(key)
        return value

    def trim(self) -> None:
        """Gives the older generation back, for when a task ends and its process waits for other work."""
        self.old = {}


#: A word's bytes up to this number stand for themselves in its key; longer ones are hashed.
_OWN = 15


def _tables():
    import numpy as np

    white, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    white[[9, 10, 11, 12, 13, 32]] = True
    lower[65:91] += 32
    return white, lower, np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_keys(texts: list[str], lower: bool = False):
    """The words of the texts, in order, as two 64-bit numbers each: an (n, 2) array; and how many each text has.

    Equal words have equal keys in every process. Words of up to 15 bytes have keys of their own: their bytes and their
    length, mixed by steps that can be undone. Longer words are given by 120 bits of a hash. lower: A-Z count as a-z.
    """
    import numpy as np
    from hashlib import blake2b

    is_white, lowered, mask = _tables()
    parts = [t.encode() for t in texts]
    raw = b" ".join(parts) + bytes([32]) * 17
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = lowered[data]
        raw = data.tobytes()
    white = is_white[data[:-16]]
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(white) and not white[0]:
        turn = np.concatenate(([0], turn))
    starts, ends = turn[::2], turn[1::2]
    per_text = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))))
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from every place
    size = ends - starts
    a = eight[starts] & mask[np.minimum(size, 8)]
    b = eight[starts + 8] & mask[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > _OWN).tolist():
        digest = blake2b(raw[starts[i] : ends[i]], digest_size=15).digest() + b"\xff"
        a[i], b[i] = np.frombuffer(digest, "<u8")
    first = scrambled(b ^ scrambled(a))
    return np.stack([first, scrambled(a ^ first * np.uint64(0x9E3779B97F4A7C15))], axis=1), per_text


def release_memory() -> None:
    """For when a task ends: gives Arrow's and the C library's free memory back to the system. A Python worker waits for
    other work then, which may never come."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def scrambled(x):
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    import numpy as np

    x = x.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))
