"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of a block at most; a corpus of fewer than 4096 such blocks has smaller ones.
BLOCK = 1024
#: Shards that the blocks are dealt to, each with quotas of its own.
N_SHARDS = 16
#: Parts into which a source's documents are dealt at least, and documents of a part.
PARTS, PART_ROWS = 256, 100_000
SEED = 17
#: Multipliers for the seeded order of a source's blocks: primes, the first that does not divide their number is used.
_FACTORS = (611_953, 700_001, 786_433, 611_957)


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight; a target stops at most * size, the excess is shared anew by weight."""
    total, fixed = float(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in open_)
        rest = total - sum(fixed.values())
        over = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else rest * weights[i] / weight for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def quotas(shares: list[float], seats: int, limits: list[int]) -> list[int]:
    """Sainte-Lague: seats go to the highest quotients share / (2 * got + 1), none beyond its limit.

    All seats above a quotient are given at once; the quotient is found by bisection, so
    the work does not grow with the seats.  The last seats go one by one.
    """
    seats = min(seats, sum(n for s, n in zip(shares, limits) if s > 0))
    if seats <= 0:
        return [0] * len(shares)

    def above(x: float) -> list[int]:  # seats with a quotient of more than x
        return [min(n, max(0, -int(-(s / x - 1) // 2))) if s > 0 else 0 for s, n in zip(shares, limits)]

    low, high = 0.0, max(shares) * 2
    for _ in range(200):
        x = (low + high) / 2
        if x in (low, high):
            break
        low, high = (low, x) if sum(above(x)) <= seats else (x, high)
    got = above(high)
    heap = [(-s / (2 * g + 1), i) for i, (s, g, n) in enumerate(zip(shares, got, limits)) if s > 0 and g < n]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(shares: list[float], seats: int, limits: list[int], n_shards: int) -> list[list[int]]:
    """Quotas [shard][source]: seats are awarded by highest quotient, one after the other; each shard gets an equal run of
    them. An award never depends on how many follow, so quotas of the first shards together are those of so many seats."""
    sums = [quotas(shares, seats * h // n_shards, limits) for h in range(n_shards + 1)]
    return [[b - a for a, b in zip(x, y)] for x, y in zip(sums, sums[1:])]


def source_plan(totals: DataFrame, weights=WEIGHTS, most: int = 3, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per source: its size and target, the words to take, blocks, quotas, and where each shard's words end.

    totals has one row per source (source, words).  Sources go by code point, null last; the weights repeat in that
    order.  The plan is made from these rows alone: about 100 bytes a source, in the driver.

    take = round(target) words are taken in a seeded order of the source's blocks, gone through anew when it ends.  A
    shard's quota says how many blocks of that order are its own; the last shard's run ends at `take`, so it differs
    from its quota by the rest of a block or two.
    """
    spark = totals.sparkSession
    rows = sorted(((r["source"], int(r["words"] or 0)) for r in totals.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most) if sum(sizes) else [0.0] * len(rows)
    block = max(1, min(BLOCK, sum(sizes) // 4096))
    take = [min(round(g), most * n) for g, n in zip(goal, sizes)]
    got = shard_quotas(goal, sum(take) // block, [most * -(-n // block) for n in sizes], n_shards)
    out = []
    for i, (source, n) in enumerate(rows):
        full = n // block
        factor = next(f for f in _FACTORS if full % f)  if full else 1
        mine = [q[i] for q in got]
        ends = [min(take[i], block * sum(mine[: h + 1])) for h in range(n_shards - 1)]
        out.append((source, n, float(goal[i]), take[i] // max(1, n), take[i] % max(1, n), block, full, (SEED * 2654435761 + i * 40503) % max(1, full), factor, mine, ends))
    return spark.createDataFrame(
        out,
        "source string, source_size long, target double, copies long, extra long, block long, full_blocks long, first_block long, factor long, shard_quotas array<long>, shard_ends array<long>",
    )


#: Where block b of a source stands in the seeded order of its blocks, in words; a last, shorter block stands last.
_PLACE = "(CASE WHEN b < full_blocks THEN pmod((b + first_block) * factor, full_blocks) ELSE full_blocks END) * block"

#: The words that are taken of a document that begins at word _a of its source: a piece for each copy and block.
_PIECES = f"""
    CASE WHEN _size = 0 OR copies + extra = 0 THEN array() ELSE
    filter(flatten(transform(sequence(0L, copies - CASE WHEN extra > 0 THEN 0L ELSE 1L END), c ->
        transform(sequence(_a div block, (_a + _size - 1) div block), b -> named_struct(
            'copy', c,
            'shard', size(filter(shard_ends, e -> e <= c * source_size + {_PLACE} + greatest(_a - b * block, 0L))),
            'start', greatest(_a, b * block) - _a,
            'end', least(_a + _size, (b + 1) * block, CASE WHEN c < copies THEN _a + _size ELSE b * block + extra - {_PLACE} END) - _a
        )))), p -> p.end > p.start) END"""


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    into: str = "mix",
) -> DataFrame:
    """The documents with a struct column `into` (an input column of that name is replaced): size, source_size, target,
    taken, copies (whole repeats), pieces (copy, shard, and words from start to end), shard_quotas of the source.

    Each source's documents stand in a seeded order, cut into blocks of equal size.  Sainte-Lague apportionment gives each
    shard a quota of blocks of each source, and the shard takes so many from the source's blocks in their seeded order
    (see source_plan).  So every word is taken as often as any other of its source or once more, no document more than
    `most` times, and a source's taken words are its target, rounded.

    Null or empty texts have size 0 and nothing is taken of them; a null source is a source; order ties are broken by
    id, size and text, so reruns agree; rows that repeat an id are documents of their own; an empty table gives an
    empty result.
    """
    keep = [c for c in docs.columns if c != into]
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    n_parts = max(PARTS, docs.count() // PART_ROWS)
    part = F.pmod(F.shiftright(F.xxhash64(F.lit(SEED), F.col("_id"), F.col("_size")), 8), F.lit(n_parts)).cast("int")
    whole = F.struct(*[F.col(f"`{c}`") for c in keep])  # in one column, so that no name of theirs meets one of the plan's
    rows = docs.select(whole.alias("_doc"), F.col(id_col).alias("_id"), word_count(text_col).alias("_size"), key.alias("_key"), F.xxhash64(F.lit(SEED), F.col(text_col)).alias("_tie"))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(SEED), F.col("_id"))).withColumn("_part", part)
    parts = stored(rows.groupBy("_key", "_part").agg(F.sum("_size").alias("words")))
    totals = parts.groupBy("_key").agg(F.sum("words").alias("words"))
    totals = totals.select(F.when(F.col("_key") != "n", F.substring("_key", 2, 1 << 30)).alias("source"), "words")
    plan = source_plan(totals, weights, most)
    plan = plan.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(plan, "_key")
    inside = Window.partitionBy("_key", "_part").orderBy("_order", "_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(parts, ["_key", "_part"]).withColumn("_a", F.col("_from") + F.sum("_size").over(inside) - F.col("_size"))
    placed = placed.withColumn("_pieces", F.expr(_PIECES))
    taken = F.aggregate("_pieces", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = F.struct(
        F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "copies", F.col("_pieces").alias("pieces"), "shard_quotas"
    )
    return placed.select("_doc.*", out.alias(into))


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixture itself, with the columns of docs: one row per whole copy, and one whose text is the
    words of the partial copy joined by spaces.  A partial copy that covers the document is whole.

    Documents of which nothing is taken, null and empty ones among them, give no row; an empty table gives none.
    """
    m = mix(docs, text_col=text_col, into="_mix", **options)
    words = F.expr(f"regexp_extract_all({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    spans = F.filter("_mix.pieces", lambda p: p["copy"] == F.col("_mix.copies"))
    m = m.filter(F.col("_mix.taken") > 0).withColumn("_spans", spans)
    slices = F.transform("_spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    whole = F.expr("aggregate(_spans, 0L, (s, x) -> s + x.end - x.start) = _mix.size")
    part = F.when(whole, F.col(text_col)).otherwise(F.array_join(F.flatten(slices), " "))
    rest = F.when(F.size("_spans") > 0, F.array(part)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col(text_col), F.col("_mix.copies").cast("int")), rest)
    return m.withColumn("_text", F.explode(texts)).select(*[F.col("_text").alias(c) if c == text_col else c for c in docs.columns])
