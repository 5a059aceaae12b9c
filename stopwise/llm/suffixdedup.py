"""Removal of byte strings that an earlier document has: shards' Burrows-Wheeler transforms are merged, bucket by bucket."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bwt import Merge, transforms
from .common import discard, release_memory, scrambled, stored, text_of

SIZE = 50
#: Bytes of the strings whose hashes route longer ones.
ANCHOR = 16
#: Bytes of text that a shard has; a longer document is a shard of its own.
SHARD = 2 << 20
#: Contexts of one anchor that a bucket may have to take together; strings around more frequent ones are routed by themselves.
HOT = 20_000
#: A bucket's task merges it in parts, by so many more bits of the key: the merge's arrays fit a core's cache then.
PART_BITS = 4
#: A routing key's low bits hold a count on the way.
_COUNT = np.uint64(0xFFFF)

_SHARD = "ids binary, sizes binary, text binary"
_ASK, _TOLD = "shard long, bucket int, keys binary", "shard long, bucket int, codes binary"
_PIECES, _FOUND = "shard long, bucket int, parts binary, symbols binary, docs binary", "shard long, bucket int, found binary"
RESULT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
#: Null ids come after all others.
_LAST = np.iinfo(np.int64).max


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents side by side, compressed. Ids, sizes and text of a shard are one row."""
    ids, texts, held = [], [], 0

    def row() -> pa.RecordBatch:
        known = np.array([_LAST if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids])
        sizes = np.array([len(t) for t in texts], np.int64)
        packed = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        columns = [np.stack([known, null.astype(np.int64)]).tobytes(), sizes.tobytes(), packed]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["ids", "sizes", "text"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_buffer().to_pybytes()
            if ids and held + len(text) > SHARD:
                yield row()
                ids, texts, held = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            held += len(text)
    if ids:
        yield row()
    release_memory()


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _routes(raw: bytes, width: int) -> np.ndarray:
    """The least hash of `width` anchors, from each place. In blocks that fit a core's cache."""
    n, block = len(raw) - ANCHOR + 1, 1 << 15
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = np.empty(n - width + 1, np.uint64)
    for a in range(0, len(out), block):
        b = min(a + block, len(out)) + width - 1
        h = eight[a:b] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += eight[a + 8 : b + 8]
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        out[a : b - width + 1] = _least(h, width)
    return out


class _Shard:
    """The documents of one shard, and the pieces of their text: runs of strings of `size` bytes with one routing key."""

    def __init__(self, row, size: int, copies: pd.DataFrame):
        self.shard, self.size = int(row["shard"]), size
        self.ids, self.null = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.raw = pa.decompress(row["text"], decompressed_size=int(self.sizes.sum()), codec="zstd", asbytes=True)
        self.ends = np.cumsum(self.sizes)
        n, width = len(self.raw), size - ANCHOR + 1
        #: Documents whose whole text an earlier one has: nothing else need be known of them.
        self.copied = np.zeros(len(self.ids), bool)
        if len(copies):
            first = dict(zip(copies["digest"].iloc[0], copies["first"].iloc[0]))
            self.copied[:] = [first.get(d, i) < i for d, i in zip(self.digests(), self.ids.tolist())]
        #: Where strings start that lie in one document, and their documents.
        count = np.where(self.copied, 0, np.maximum(self.sizes - size + 1, 0))
        self.starts = np.arange(count.sum()) + np.repeat(self.ends - self.sizes - (np.cumsum(count) - count), count)
        if not len(self.starts):
            self.first = self.count = np.zeros(0, np.int64)
            self.doc, self.key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        least = _routes(self.raw, width)[self.starts]
        turn = np.ones(len(least), bool)
        turn[1:] = least[1:] != least[:-1]
        turn[(np.cumsum(count) - count)[count > 0]] = True
        at = np.flatnonzero(turn)
        if np.diff(at, append=len(least)).max() > width:  # one key goes on for long, as in repetitive text
            run = np.repeat(at, np.diff(at, append=len(least)))
            at = np.flatnonzero((np.arange(len(least)) - run) % width == 0)
        self.first, self.count = self.starts[at], np.diff(at, append=len(least))
        self.doc, self.key = np.searchsorted(self.ends, self.first, "right"), scrambled(least[at]) & ~_COUNT

    def digests(self) -> list[bytes]:
        return [blake2b(self.raw[end - size : end], digest_size=16).digest() for size, end in zip(self.sizes.tolist(), self.ends.tolist())]

    def ask(self, bits: int) -> pd.DataFrame:
        """Distinct keys, each with the number of contexts that it has here: 2 at least where it occurs twice."""
        eight = np.ndarray((max(len(self.raw) - 7, 0),), "<u8", self.raw, strides=(1,)) if len(self.raw) > 7 else np.zeros(0, np.uint64)
        context = scrambled(eight[self.first] + scrambled(eight[self.first + self.count + self.size - 9] + self.count.astype(np.uint64))) if len(self.first) else self.key
        order = np.lexsort((context, self.key))
        key, context = self.key[order], context[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        differs = fresh.copy()
        differs[1:] |= context[1:] != context[:-1]
        at = np.flatnonzero(fresh)
        contexts = np.add.reduceat(differs.astype(np.int64), at) if len(at) else at
        contexts = np.maximum(contexts, np.minimum(np.diff(np.append(at, len(key))), 2))
        packed = key[at] | np.minimum(contexts, int(_COUNT)).astype(np.uint64)
        rows = [(self.shard, b, packed[x:y].tobytes()) for b, x, y in _parts(packed, bits)]
        return pd.DataFrame(rows, columns=["shard", "bucket", "keys"])

    def codes(self, told: pd.DataFrame) -> np.ndarray:
        """For each piece: 0 its key occurs once in the corpus, 1 more often, 2 in very many contexts."""
        distinct, inverse = np.unique(self.key, return_inverse=True)
        found = b"".join(c for _, c in sorted(zip(told["bucket"], told["codes"])))
        return np.frombuffer(found, np.uint8)[inverse] if len(distinct) else np.zeros(0, np.uint8)

    def result(self, gone: np.ndarray) -> pd.DataFrame:
        """gone: flags of bytes to remove."""
        rows = []
        for i in np.flatnonzero(self.copied & (self.sizes >= self.size)).tolist():
            gone[self.ends[i] - self.sizes[i] : self.ends[i]] = True
        flags = gone.view(np.int8)
        for i, (doc_id, null, size, end) in enumerate(zip(self.ids.tolist(), self.null.tolist(), self.sizes.tolist(), self.ends.tolist())):
            mine, text = flags[end - size : end], self.raw[end - size : end]
            edge = np.flatnonzero(np.diff(mine, prepend=0, append=0)).tolist() if mine.any() else []
            spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
            if spans:
                inner = [0, *edge, size]
                text = b"".join(text[a:b] for a, b in zip(inner[::2], inner[1::2]))
            rows.append((None if null else doc_id, size, size - len(text), spans, text))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "removed", "kept"]).astype({"doc_id": "Int64"})


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the filled buckets of sorted keys."""
    top = keys >> np.uint64(64 - bits)
    at = np.flatnonzero(np.diff(top, prepend=top[:1] + np.uint64(1)))
    return zip(top[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)])


class _Pieces:
    """The distinct pieces of a shard whose keys occur elsewhere, bucket by bucket, and where they occur.

    A piece around a frequent key is cut into its strings, which go to the buckets of their own bytes.
    """

    def __init__(self, s: _Shard, codes: np.ndarray, bits: int):
        self.s = s
        raw, size, shift = s.raw, s.size, np.uint64(64 - bits)
        mine = np.flatnonzero(codes == 1)
        first, count, doc, key = s.first[mine], s.count[mine], s.doc[mine], s.key[mine]
        hot = np.flatnonzero(codes == 2)
        if len(hot):
            many = s.count[hot]
            single = np.arange(many.sum()) + np.repeat(s.first[hot] - (np.cumsum(many) - many), many)
            eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
            own = np.zeros(len(single), np.uint64)
            for i in [*range(0, size - 7, 8), size - 8]:
                own = scrambled(own + eight[single + i])
            first, count = np.concatenate((first, single)), np.concatenate((count, np.ones(len(single), np.int64)))
            doc, key = np.concatenate((doc, np.repeat(s.doc[hot], many))), np.concatenate((key, own))
        order = np.argsort(key >> shift, kind="stable")
        self.first, self.count, bucket = first[order], count[order], (key >> shift)[order]
        docs = s.ids[doc[order]]
        numbers: dict[tuple, int] = {}
        self.texts, self.bucket, self.piece = [], [], np.empty(len(order), np.int64)
        for i, (a, b, k) in enumerate(zip(self.first.tolist(), (self.first + self.count + size - 1).tolist(), bucket.tolist())):
            text = raw[a:b]
            n = numbers.setdefault((k, text), len(numbers))
            if n == len(self.texts):
                self.texts.append(text)
                self.bucket.append(k)
            self.piece[i] = n
        #: The smallest document of each piece, and occurrences in others.
        self.docs = np.full(len(self.texts), _LAST, np.int64)
        np.minimum.at(self.docs, self.piece, docs)
        self.later = docs > self.docs[self.piece]
        self.bucket = np.array(self.bucket, np.int64)
        self.sizes = np.array([len(t) + 1 for t in self.texts], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def _entries(self, bits: int = PART_BITS) -> Iterator[tuple[int, int, int]]:
        """(bucket, begin, end) by pieces; without bits, the same for parts of buckets."""
        bucket = self.bucket >> bits
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        return zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)])

    def transformed(self) -> pd.DataFrame:
        """One row per bucket: the transforms of the shard's pieces for its parts, and their documents."""
        parts = np.array(list(self._entries(0)), np.int64).reshape(-1, 3)
        rows = []
        if len(parts):
            text = np.frombuffer(b"\xff".join(self.texts) + b"\xff", np.uint8) + np.uint8(1)  # the end becomes 0
            edges = np.append(self.begin[parts[:, 1]], len(text))
            out = transforms(text, edges)
            #: Part, symbols and pieces.
            sizes = np.stack([parts[:, 0], np.diff(edges), parts[:, 2] - parts[:, 1]], axis=1)
            for b, p, q in self._entries():
                i, j = np.searchsorted(parts[:, 1], (p, q))
                rows.append((self.s.shard, b, sizes[i:j].tobytes(), out[edges[i] : edges[j]].tobytes(), self.docs[p:q].tobytes()))
        return pd.DataFrame(rows, columns=["shard", "bucket", "parts", "symbols", "docs"])

    def gone(self, found: pd.DataFrame) -> np.ndarray:
        """Flags of the bytes to remove. found has, for each bucket, a bit for each symbol of the pieces sent there."""
        n = len(self.s.raw)
        step = np.zeros(n + 1, np.int64)
        answers, flags = dict(zip(found["bucket"], found["found"])), np.zeros(int(self.sizes.sum()), bool)
        for b, p, q in self._entries():
            x, y = self.begin[p], self.begin[q - 1] + self.sizes[q - 1]
            flags[x:y] = np.unpackbits(np.frombuffer(answers[b], np.uint8))[: y - x]
        # Every string of every occurrence: its place in the text and in the pieces.
        within = np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        at = np.repeat(self.first, self.count) + within
        hit = flags[np.repeat(self.begin[self.piece], self.count) + within] | np.repeat(self.later, self.count)
        step[at[hit]] += 1  # every string is in one piece, so places differ
        step[at[hit] + self.s.size] -= 1
        return np.cumsum(step)[:n] > 0


def _copies(shards: DataFrame, size: int) -> DataFrame:
    """For each shard the digests (128 bits) of texts that several documents have, with the least id of all of these.

    A shard names each of its texts once, so a text that fills the corpus costs one narrow row per shard.
    """

    def digests(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                s = _Shard(row, size, _NO_COPIES)
                found = pd.DataFrame({"digest": s.digests(), "id": s.ids})[s.sizes >= size]
                per = found.groupby("digest")["id"].agg(first="min", n="count").reset_index()
                yield per.assign(shard=s.shard)[["shard", "digest", "first", "n"]]

    w = Window.partitionBy("digest")
    rows = shards.mapInPandas(digests, "shard long, digest binary, first long, n long")
    rows = rows.withColumns({"first": F.min("first").over(w), "n": F.sum("n").over(w)}).filter("n > 1")
    return rows.groupBy("shard").agg(*[F.collect_list(c).alias(c) for c in ("digest", "first")])


_NO_COPIES = pd.DataFrame({"digest": [], "first": []})


def _told(rows: pd.DataFrame) -> pd.DataFrame:
    """What is known of a bucket's keys over all shards: see _Shard.codes."""
    packed = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
    both = np.concatenate(packed)
    _, inverse = np.unique(both & ~_COUNT, return_inverse=True)
    times = np.bincount(inverse, weights=(both & _COUNT).astype(np.float64))[inverse]
    codes = (times > 1).astype(np.uint8) + (times > HOT).astype(np.uint8)
    cuts = np.cumsum([len(k) for k in packed])[:-1]
    return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"], "codes": [c.tobytes() for c in np.split(codes, cuts)]})


def _merged(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each shard's pieces a bit for each symbol: does a string start here that a smaller document has?"""
        symbols, docs = ([np.frombuffer(x, kind) for x in rows[c]] for c, kind in (("symbols", np.uint8), ("docs", np.int64)))
        found = [np.zeros(len(s), bool) for s in symbols]
        waiting: dict[int, list[tuple]] = {}
        for i, raw in enumerate(rows["parts"]):
            at = doc = 0
            for part, n, pieces in np.frombuffer(raw, np.int64).reshape(-1, 3).tolist():
                waiting.setdefault(part, []).append((symbols[i][at : at + n], docs[i][doc : doc + pieces], found[i][at : at + n]))
                at, doc = at + n, doc + pieces
        for shards in waiting.values():
            flags = _earlier([s for s, _, _ in shards], np.concatenate([d for _, d, _ in shards]), size)
            at = 0
            for s, _, out in shards:
                out[:] = flags[at : at + len(s)]
                at += len(s)
        return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"], "found": [np.packbits(f).tobytes() for f in found]})

    return run


def _earlier(shards: list[np.ndarray], docs: np.ndarray, size: int) -> np.ndarray:
    """Flags of the places, in the shards' texts one after the other, where a string starts that a smaller document has."""
    merge = Merge(shards)
    piece, left = merge.pieces()
    order, begins = merge.repeated(size)
    found = np.zeros(len(merge.symbols), bool)
    if len(order):
        mine = docs[piece[order]]
        least = np.repeat(np.minimum.reduceat(mine, begins), np.diff(np.append(begins, len(order))))
        hit = order[mine > least]
        # Pieces lie one after the other with their ends; `left` symbols before its end is the string's place.
        length = np.zeros(len(docs), np.int64)
        np.maximum.at(length, piece, left)
        ends = np.cumsum(length + 1) - 1
        found[ends[piece[hit]] - left[hit]] = True
    return found


def remove_earlier(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, removed byte spans, kept bytes.

    Texts are UTF-8 bytes.  Each byte covered by a string of `size` bytes that also starts in a document with a smaller id
    is removed; strings are judged on the input.  Documents with one id remove nothing of each other, and a null id counts
    as the largest.  A null text is empty; texts shorter than `size` lose nothing; cuts may fall inside a character, so
    `kept` is binary.  An empty table gives an empty result.

    A shard is some 2 MB of documents as they lie in the input.  Documents whose whole text a smaller id has go at once
    (128-bit digests); what follows is about all others.  Every string belongs to the least hash of its 16-byte
    substrings, its key, so equal strings have equal keys, and neighbours mostly share one: runs of strings with one key
    are pieces.  Keys that occur once in the corpus end there.  The others' pieces go to the buckets of their keys as
    Burrows-Wheeler transforms, and a bucket's task merges the transforms of all shards by refining their interleave, in
    parts that differ in further bits of the key.  The merge compares symbols, not hashes.  A shard sends each distinct piece once; strings
    around keys with over HOT contexts have buckets of their own, so one bucket never takes a frequent phrase's whole
    surroundings.
    """
    if size < ANCHOR + 8:
        raise ValueError(f"size must be {ANCHOR + 8} bytes or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    shards = stored(rows.mapInArrow(_shards, _SHARD).withColumn("shard", F.monotonically_increasing_id()))
    n = shards.count()
    # A bucket takes the keys and pieces of two shards.
    key_bits = max(1, (n // 2).bit_length())

    copies = stored(_copies(shards, size))

    def ask(pdf: pd.DataFrame, copied: pd.DataFrame) -> pd.DataFrame:
        return _Shard(pdf.iloc[0], size, copied).ask(key_bits)

    def pieces(row, known: pd.DataFrame) -> _Pieces:
        shard = _Shard(row, size, known[known["digest"].notna()])
        return _Pieces(shard, shard.codes(known[known["codes"].notna()]), key_bits + PART_BITS)

    def send(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return pieces(pdf.iloc[0], known).transformed()

    def finish(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        p = pieces(pdf.iloc[0], known)
        return p.s.result(p.gone(known[known["found"].notna()]))

    def by_shard(*answers: DataFrame) -> object:
        all_answers = answers[0]
        for other in answers[1:]:
            all_answers = all_answers.unionByName(other, allowMissingColumns=True)
        return shards.groupBy("shard").cogroup(all_answers.groupBy("shard"))

    told = stored(by_shard(copies).applyInPandas(ask, _ASK).groupBy("bucket").applyInPandas(_told, _TOLD))
    sent = by_shard(copies, told).applyInPandas(send, _PIECES)
    found = sent.groupBy("bucket").applyInPandas(_merged(size), _FOUND)
    return by_shard(copies, told, found).applyInPandas(finish, RESULT)
