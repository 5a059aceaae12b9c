"""Near-duplicates by bottom-k sketches of one hash function, verified by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release_memory, scrambled, stored, text_of, word_keys
from .components import components
from .exact import one_of_each

#: Retained values of a sketch, and how many of them a pair at the threshold shares at least: of the
#: K smallest of its union 0.8 K = 77 are shared on average, with deviation 3.9, so 56 are but for 5e-8.
K, SHARED = 96, 56
THRESHOLD = 80  # per cent
#: Members of a list that others are compared with in one round, and rounds before all pairs that are left.
HEADS, ROUNDS = 16, 2
#: Classes of a list from which on pairs are looked for by what sets differ in from a common core.
LARGE = 64

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    keys, counts = word_keys(texts, lower=True)
    hashes = keys[:, 0]
    factors = [np.uint64(_FACTORS[i % 5] + 2 * (i // 5)) for i in range(size)]
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i, f in enumerate(factors):
        if n > 0:
            rolled += hashes[i : i + n] * f
    rolled = scrambled(rolled)
    a = 0
    for d in counts.tolist():
        b = a + d
        if not d:
            yield np.zeros(0, np.uint64)
        elif d < size:
            short = np.uint64(d)
            for h in hashes[a:b]:
                short = (short * np.uint64(_FACTORS[0]) + h) & np.uint64(0xFFFFFFFFFFFFFFFF)
            yield scrambled(np.array([short]))
        else:
            yield np.unique(rolled[a : b - size + 1])
        a = b


def _sketcher(size: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("sig", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        old = np.seterr(over="ignore")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sigs, ns, lists = [], [], []
                for s in shingle_sets(part.column(2).to_pylist(), size):
                    ns.append(len(s))
                    # The whole set in 128 bits: the sums of two scramblings of its members.
                    sigs.append(np.array([s.sum(dtype=np.uint64), scrambled(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() + len(s).to_bytes(4, "little") if len(s) else None)
                    lists.append(s[:k].view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sigs, pa.binary()), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)
        np.seterr(**old)
        release_memory()

    return run


def _sets(size: int):
    schema = pa.schema([("row", pa.binary()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                lists = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], schema=schema)
        release_memory()

    return run


def _could_match(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {THRESHOLD} * greatest({a}, {b})"


def _least_shared(n: str):
    """Members that a set of n shares at least with any set at the threshold."""
    return F.expr(f"({THRESHOLD} * {n} + 99) div 100")


def _rare_lists(values: DataFrame, shared, by: tuple[str, ...] = (), keep: tuple[str, ...] = ("n",)) -> DataFrame:
    """Inverted lists (value, cid, n, rest) of the rarest values of each set, of values (cid, n, k, value); by: columns that
    tell separate families of sets apart.

    Of k values `shared` at least are common to any match.  So the rarest k - shared + 1 of
    the one set and of the other meet, in the order by frequency; values that no other set has
    come first, and a set with fewer than `shared` others enters no list.  rest is how many
    values a match can share at most if this is the first that it shares.
    """
    # Written, so that the join is a plain one, which Spark splits where very many sets have a value.
    often = stored(values.groupBy(*by, "value").agg(F.count("*").alias("df")).filter("df > 1"))
    mine = Window.partitionBy(*by, "cid")
    found = values.join(often, [*by, "value"]).withColumns({"rank": F.row_number().over(mine.orderBy("df", "value")), "with_others": F.count("*").over(mine)})
    return found.withColumn("rest", F.col("with_others") - F.col("rank") + 1).filter(F.col("rest") >= shared).select(*by, "value", "cid", *keep, "rest")


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    return lists.join(label.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _several(known: DataFrame, compared: int = 0) -> DataFrame:
    """Lists of more than `compared` classes with more than one component, and the component that most of them are in."""
    per = known.groupBy("value", "label").agg(F.count("*").alias("m"))
    main = F.max_by("label", F.struct("m", "label")).alias("main")
    several = per.groupBy("value").agg(main, F.count("*").alias("labels"), F.sum("m").alias("size"))
    return stored(several.filter(f"labels > 1 and size > {compared}"))


#: What the first value that a pair shares leaves to be shared, against what its sizes ask for.
_ENOUGH = f"label_a <> label_b and least(rest_a, rest_b) >= ({THRESHOLD} * (n_a + n_b) + {99 + THRESHOLD}) div {100 + THRESHOLD}"


def _side(known: DataFrame, s: str, *more: str) -> DataFrame:
    return known.select("value", *more, F.col("cid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "label", "rest")])


def _ordered(p: DataFrame) -> DataFrame:
    """Distinct pairs (a < b)."""
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")


def _with_heads(known: DataFrame, turn: int) -> DataFrame:
    """Pairs of each class that is not in the main component of its longest open list with HEADS members of that list, those of the
    main component first. They join most of a large group of near copies at a cost that grows with its size."""
    open_ = known.join(_several(known), "value")
    longest = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("size"), "value"))
    mine = _side(open_.filter("label <> main").withColumn("place", longest).filter("place = 1"), "a")
    order = Window.partitionBy("value").orderBy((F.col("label") != F.col("main")).cast("int"), F.xxhash64(F.lit(turn), "cid"), "cid")
    heads = _side(open_.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEADS), "b")
    return _ordered(mine.join(heads, "value").filter("label_a <> label_b"))


def _differences(known: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """What the classes of large lists differ in from the core of the list's main component: the members that more than half of
    its classes in such lists have.

    main, cid, n, differences (members that only the class or only the core has), u, room.  Classes that differ in more than
    their own size are left out.  With m members missing and e extra ones, u = 100 m + T e, room = (100 - T) |core|: two sets
    reach the threshold T just if (100 + T) times their common differences is at least the sum of both u less room.
    """
    family = stored(known.join(large.select("value", "main"), "value").select("main", "cid", "label").distinct())
    own = family.filter("label = main").join(sets.select("cid", "members"), "cid")
    most = family.filter("label = main").groupBy("main").agg(F.count("*").alias("classes"))
    held = own.select("main", F.explode("members").alias("value")).groupBy("main", "value").agg(F.count("*").alias("m"))
    core = stored(held.join(most, "main").filter("2 * m > classes").groupBy("main").agg(F.collect_list("value").alias("core")))
    found = family.select("main", "cid").join(sets, "cid").join(core, "main")
    found = found.withColumns({"missing": F.array_except("core", "members"), "extra": F.array_except("members", "core")})
    found = found.filter("size(missing) + size(extra) <= n").withColumn("differences", F.concat("missing", "extra"))
    out = stored(found.selectExpr("main", "cid", "n", "differences", f"100L * size(missing) + {THRESHOLD}L * size(extra) as u", f"{100 - THRESHOLD}L * size(core) as room"))
    discard(family, core)
    return out


def _with_middle(near: DataFrame) -> DataFrame:
    """Pairs of classes that are so close to their core that they match the class closest to it. If two classes differ in so
    little together that they match whatever the differences are, both are among these."""
    middle = near.groupBy("main").agg(F.min(F.struct("u", "cid", "label")).alias("middle"))
    found = near.join(middle, "main").filter("u + middle.u <= room and label <> middle.label")
    return _ordered(found.select(F.col("cid").alias("a"), F.col("middle.cid").alias("b")))


def _by_differences(near: DataFrame) -> DataFrame:
    """All other pairs of classes near a core that are in different components and can match if this is the first difference
    from the core that they share. One of the two is open: too far from the core for _with_middle."""
    least = near.groupBy("main").agg(F.min("u").alias("least"))
    near = near.join(least, "main").withColumn("open", F.expr("u + least > room"))
    # What the differences ask for at least, whatever the other class: it has an u of `least` or more, to an open class one of
    # T % of what this is above room (it shares no more than all its differences), and beside others it is open itself.
    need = f"case when open then u - room + greatest(least, {THRESHOLD} * (u - room) div 100) else u - least + 1 end"
    near = near.withColumn("need", F.expr(f"({need} + {99 + THRESHOLD}) div {100 + THRESHOLD}")).filter("size(differences) >= need")
    values = near.select("main", "cid", "label", "u", "room", "open", "need", F.explode("differences").alias("value"))
    lists = stored(_rare_lists(values, F.col("need"), by=("main",), keep=("label", "u", "room", "open")))
    x, y = (lists.select("main", "value", F.col("cid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("label", "u", "room", "open", "rest")]) for s in ("a", "b"))
    enough = f"label_a <> label_b and (not open_b or a < b) and {100 + THRESHOLD} * least(rest_a, rest_b) >= u_a + u_b - room_a"
    pairs = stored(_ordered(x.filter("open_a").join(y, ["main", "value"]).filter(enough)))
    discard(lists)
    return pairs


def _between_components(known: DataFrame, large: DataFrame, near: DataFrame) -> DataFrame:
    """All pairs of a list that are in different components still and can match if this is the first value that they share,
    but those of two classes near the same core."""
    near = near.select(F.col("main").alias("core"), "cid", F.lit(True).alias("near"))
    open_ = known.join(_several(known), "value").join(large.select("value", F.col("main").alias("core")), "value", "left")
    open_ = stored(open_.join(near, ["core", "cid"], "left").withColumns({"near": F.col("near").isNotNull(), "other": F.col("label") != F.col("main")}))
    far = _side(open_.filter("other and not near"), "a").join(_side(open_, "b"), "value").filter(_ENOUGH)
    rest = _side(open_.filter("other and near"), "a").join(_side(open_.filter("not other and not near"), "b"), "value").filter(_ENOUGH)
    pairs = stored(_ordered(far.select("a", "b").unionByName(rest.select("a", "b"))))
    discard(open_)
    return pairs


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose full sets reach the threshold."""
    x, y = (sets.select(*[F.col(c).alias(c + s) for c in ("cid", "n", "members")]) for s in ("_x", "_y"))
    p = pairs.join(x, F.col("a") == F.col("cid_x")).join(y, F.col("b") == F.col("cid_y"))
    p = p.withColumn("both", F.size(F.array_intersect("members_x", "members_y")))
    return p.filter(f"100 * both >= {THRESHOLD} * (n_x + n_y - both)").select("a", "b")


def _full_sets(ids: DataFrame, classes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """cid, n, members of the classes in ids, made again from their representatives' texts."""
    need = classes.select("cid", F.col("top.row").alias("row"), "n").join(ids, "cid")
    texts = rows.join(need.select("row"), "row", "left_semi").select("row", "text").dropDuplicates(["row"])
    full = texts.mapInArrow(_sets(size), "row binary, members array<long>")
    return full.join(need, "row").select("cid", "n", "members")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Of (a, b) class pairs those whose full sets reach the threshold.

    The bottom k of the union of both sketches estimates the similarity and drops pairs far
    below; the full sets of the rest, made again from the texts, decide.
    """
    brief = classes.select("cid", "n", "sketch")
    x, y = (brief.select(*[F.col(c).alias(c + s) for c in brief.columns]) for s in ("_x", "_y"))
    p = pairs.join(x, F.col("a") == F.col("cid_x")).join(y, F.col("b") == F.col("cid_y"))
    union = F.slice(F.sort_array(F.array_union("sketch_x", "sketch_y")), 1, K)
    both = F.size(F.array_intersect(F.array_intersect("sketch_x", "sketch_y"), "union"))
    p = p.withColumn("union", union).filter(both * K >= F.size("union") * SHARED).select("a", "b")
    p = stored(p)
    ids = p.select(F.col("a").alias("cid")).unionByName(p.select(F.col("b").alias("cid"))).distinct()
    return _exact(p, _full_sets(ids, classes, rows, size))


def _row(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text, also where an id is null or stands for several texts."""
    return F.unhex(F.md5(F.encode(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(" "), text_of(text_col)), "UTF-8")))


def _components_of(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, row, sig, n, sketch), and the component of each class: sig, class_size, first.

    first is the (unnamed, doc_id, row) of the component's document with the smallest id, null ids last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), _row(id_col, text_col).alias("row"))
    own = stored(rows.select("doc_id", "row", "text").mapInArrow(_sketcher(size, K), "doc_id long, row binary, sig binary, n long, sketch array<long>"))
    top = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = own.filter("sig is not null").groupBy("sig").agg(F.min(top).alias("top"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))
    values = classes.select("cid", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    small = K * THRESHOLD // 100
    shared = F.when(F.col("n") <= small, _least_shared("n")).otherwise(F.lit(SHARED))
    lists = stored(_rare_lists(values, shared).drop("rest"))
    heads = stored(lists.groupBy("value").agg(F.min(F.struct("cid", "n")).alias("head"), F.count("*").alias("m")).filter("m > 1"))
    stars = lists.join(heads, "value").filter("cid <> head.cid").filter(_could_match("n", "head.n")).groupBy(F.col("head.cid").alias("a"), F.col("cid").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
    stars = stored(stars)
    links = stored(_verified(stars, classes, rows, size))
    label = components(links)
    discard(links)
    # Classes in lists that hold several components are looked at once more, by their whole sets. The two
    # of a sketch list of two have been compared; of the lists of whole sets no pair has been.
    again = stored(lists.join(_several(_labelled(lists, label), compared=2).select("value"), "value", "left_semi").select("cid").distinct())
    discard(lists)
    done = [stars, again]
    if again.count():
        sets = stored(_full_sets(again, classes, rows, size))
        members = sets.select("cid", "n", F.col("n").alias("k"), F.explode("members").alias("value"))
        lists = stored(_rare_lists(members, _least_shared("n")))
        done += [sets, lists]
        seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        for turn in range(ROUNDS + 3):
            known = stored(_labelled(lists, label))
            if turn == ROUNDS:
                large = _several(known, LARGE)
                near = _differences(known, large, sets)
                done += [large, near]
            if turn < ROUNDS:
                pairs = _with_heads(known, turn)
            elif turn == ROUNDS:
                pairs = _with_middle(_labelled(near, label))
            elif turn == ROUNDS + 1:
                pairs = _by_differences(_labelled(near, label))
            else:
                pairs = _between_components(known, large, near)
            pairs = stored(pairs.join(seen, ["a", "b"], "left_anti"))
            discard(known)
            done.append(pairs)
            if not pairs.count():
                continue
            seen = seen.unionByName(pairs)
            new = stored(_exact(pairs, sets))
            if new.count():
                label = components(label.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(new))
            discard(new)
    discard(*done)
    label = label.select(F.col("id").alias("cid"), "label")
    named = classes.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = named.groupBy("label").agg(F.min("top").alias("first"))
    return own, named.join(first, "label").select("sig", "class_size", "first")


def near_duplicates(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, class_size, component_id, kept.

    A document's set is its distinct `size`-word shingles, A-Z lower-cased; with fewer
    words, the whole sequence; null and empty texts have no set and are linked with
    nothing.  Documents with similarity 0.8 or more are linked; component_id is the smallest id
    that can be reached; a document is kept if it has that id itself.  A null id is
    larger than any other and, where no other is in the component, stands as null.

    1. Documents with the same set are one class, whatever their number.
    2. Each class keeps the K smallest values of its set.  Sketches that must share so many
       values share one of their rarest k - shared + 1 (exact for small sets): only these
       enter inverted lists, so a passage in a third of all documents makes no pairs
       unless it is most of them.
    3. Of each list, all classes are compared with its first; links form components.
    4. Classes in lists that hold several components are listed anew by their whole sets,
       where four fifths must be shared; pairs between components of a list are compared.
       In large lists those near a common core are paired by the differences from it that
       they share, so copies that changed in places of their own are not. So no link that
       matters is lost, and a list of n near copies costs about n comparisons.
    """
    own, named = _components_of(docs, size, id_col, text_col)
    named = named.select("sig", "class_size", F.col("first.doc_id").alias("component_id"))
    out = own.select("doc_id", F.col("n").alias("n_shingles"), F.col("sig").alias("own_sig"))
    out = out.join(named, out["own_sig"] == named["sig"], "left")
    cid = F.when(F.col("own_sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("class_size", F.lit(1)).alias("class_size"), cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def dedup_near(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with its smallest id (null ids last), with all its columns; rows without a set stay.

    Rows that repeat an id and its text are one document and stay once, that with the smallest hash of all columns; another
    text under the same id, or without an id, is a document of its own; an empty table gives an empty result.
    """
    own, named = _components_of(docs, size, id_col, text_col)
    kept = named.select(F.col("first.row").alias("_row")).unionByName(own.filter("sig is null").select(F.col("row").alias("_row"))).distinct()
    rows = docs.withColumn("_row", _row(id_col, text_col)).join(kept, "_row", "left_semi")
    return one_of_each(rows, ["_row"], text_col).select(*docs.columns)
