"""Balanced contiguous shards by a global prefix sum of byte sizes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored, text_of

#: Ranges of the content hash, and parts into which the rows of one text are dealt, at least; rows for each of them.
RANGES, PARTS, PART_ROWS = 4096, 256, 100_000
#: A group of equal texts over a 200th of a shard is placed by itself, so there are 200 * shards of them at most.
LARGE = 200


def _place(groups: list[tuple[int, int, int]], total: int, n_shards: int) -> tuple[list[tuple], list[float], list[int]]:
    """Large groups (hash, bytes, rows), the largest first, each to the shard with most room if that holds it whole.

    Returns (hash, shard, first slot) of these, the room that each shard has left, and its slots so far.
    """
    room, slots, placed = [total / n_shards] * n_shards, [0] * n_shards, []
    for h, size, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        shard = max(range(n_shards), key=lambda s: (room[s], -s))
        if size <= room[shard]:
            placed.append((h, shard, slots[shard]))
            room[shard] -= size
            slots[shard] += n
    return placed, room, slots


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot, whole (all equal texts were put into one shard).

    Size is the UTF-8 length of the text (null: 0) plus 1.  Every shard gets the same bytes: first large groups of equal
    texts that fit it whole (see _place), then a stretch of all other documents, which stand in one order by content
    hash, part and id.  The byte position of a row is the sum of three prefix sums: over the totals of hash ranges, over
    the totals of (hash, part) inside a range, and over rows inside a (hash, part).  No step holds more than one range's
    totals or one part's rows in a task, however often a text is repeated.

    The order is cut where the shards' rooms end.  A group of equal texts that is no large one goes whole where its
    middle falls, so shards differ by a 200th at most; a large one that no shard could hold is cut row by row.  With
    groups that fit shards, no text is in two of them.  slot counts a shard's rows from 0.

    Rows with null or repeated ids are placed like all others; rows that agree in id and text are alike; an empty
    table gives no rows.
    """
    n_rows = docs.count()
    n_ranges, n_parts = max(RANGES, n_rows // PART_ROWS), max(PARTS, n_rows // PART_ROWS)
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    ).withColumns(
        {
            # Ranges follow the order of the hash.
            "r": F.floor((F.shiftright("h", 32) + 2**31) * n_ranges / 2.0**32).cast("int"),
            "part": F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_parts)).cast("int"),
        }
    )
    parts = stored(rows.groupBy("r", "h", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    groups = parts.groupBy("h").agg(F.sum("bytes").alias("g_bytes"), F.sum("n").alias("g_n"))
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    large = groups.filter(F.col("g_bytes") * (LARGE * n_shards) > F.lit(total))
    placed, room, slots = _place([tuple(r) for r in large.collect()], total, n_shards)  # LARGE * n_shards rows at most
    schema = "h long, own_shard int, own_slot long"
    own = F.broadcast(docs.sparkSession.createDataFrame(placed, schema))
    cuts = [sum(room[: i + 1]) for i in range(n_shards - 1)]

    parts_ = parts.join(own, "h", "left")
    stretch = F.col("own_shard").isNull().cast("long")  # placed groups take no room in the order of the others
    parts_ = parts_.withColumns({"s_bytes": F.col("bytes") * stretch, "s_n": F.col("n") * stretch})
    ranges = parts_.groupBy("r").agg(F.sum("s_bytes").alias("r_bytes"), F.sum("s_n").alias("r_n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: n_ranges at most
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = ranges.select("r", sum_before("r_bytes", before).alias("r_from"), sum_before("r_n", before).alias("r_first"))
    inside = Window.partitionBy("r").orderBy("h", "part").rowsBetween(Window.unboundedPreceding, -1)
    of_text = Window.partitionBy("r", "h")
    mine_before = of_text.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts_.withColumns(
        {
            "p_from": sum_before("s_bytes", inside),
            "p_first": sum_before("s_n", inside),
            "g_first": sum_before("n", mine_before),
            "g_bytes": F.sum("bytes").over(of_text),
        }
    ).withColumn("g_from", F.min("p_from").over(of_text))
    offsets = offsets.join(ranges, "r").select(
        "h", "part", "own_shard", "own_slot", "g_first", "g_bytes",
        F.expr("r_from + p_from").alias("p_from"), F.expr("r_first + p_first").alias("p_first"), F.expr("r_from + g_from").alias("g_from"),
    )
    mine = Window.partitionBy("h", "part").orderBy("doc_id", "size")
    at = F.col("p_from") + F.sum("size").over(mine.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    number = F.row_number().over(mine) - 1
    placed_rows = rows.join(offsets, ["h", "part"]).withColumns({"at": at, "number": number})
    small = F.col("g_bytes") * (LARGE * n_shards) <= F.lit(total)
    middle = F.when(small, F.col("g_from") + F.col("g_bytes") / 2).otherwise(F.col("at") + F.col("size") / 2)
    shard = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("middle"))) if cuts else F.lit(0)
    placed_rows = stored(
        placed_rows.withColumn("middle", middle).select(
            "doc_id", "size", "text_crc32", "h",
            F.coalesce("own_shard", shard).cast("int").alias("shard"),
            (F.col("own_slot") + F.col("g_first") + F.col("number")).alias("own_slot"),
            (F.col("p_first") + F.col("number")).alias("row"),
            (small | F.col("own_shard").isNotNull()).alias("whole"),
        )
    )
    discard(parts)
    firsts = placed_rows.filter("own_slot is null").groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    after = F.element_at(F.array(*[F.lit(n).cast("long") for n in slots]), F.col("shard") + 1)
    slot = F.coalesce("own_slot", F.col("row") - F.col("first") + after)
    out = placed_rows.join(F.broadcast(firsts), "shard", "left")
    return out.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "whole")
