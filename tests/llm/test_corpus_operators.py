"""Each operator against a brute-force version, on rows with every awkward case, and on an empty table."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from stopwise.llm import exact, htmltext, langid, minhash, mixing, packing, sharding, substring, tokencount, tokenizer, topk
from stopwise.llm.components import components
from stopwise.llm.queries import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(t or "")


def brute_mix(rows, n_shards):
    """Targets by water-filling, seats one by one, blocks in seeded order: the words that each source gives each shard."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, list(names)
    while left:
        rest, w = total - sum(target.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 3 * sizes[s]]
        target |= {s: 3.0 * sizes[s] if over else rest * weight[s] / w for s in over or left}
        left = [s for s in left if s not in target]
    block = max(1, min(1024, total // 4096))
    take = {s: min(round(target[s]), 3 * sizes[s]) for s in names}
    seats, got, given = sum(take.values()) // block, Counter(), [Counter() for _ in range(n_shards)]
    for seat in range(seats):
        s = max((s for s in names if got[s] < 3 * -(-sizes[s] // block)), key=lambda s: (target[s] / (2 * got[s] + 1), -names.index(s)))
        got[s] += 1
        given[next(h for h in range(n_shards) if seat < seats * (h + 1) // n_shards)][s] += 1
    return sizes, target, take, given, block


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).select("doc_id", "source", "text", "mix.*").collect()
    assert len(got) == len(rows)
    sizes, target, take, given, block = brute_mix(rows, mixing.N_SHARDS)
    taken, in_shard = Counter(), defaultdict(Counter)
    for r in got:
        n = len(words(r["text"]))
        assert (r["size"], r["source_size"], r["target"]) == (n, sizes[r["source"]], pytest.approx(target[r["source"]]))
        times = Counter(i for p in r["pieces"] for i in range(p["start"], p["end"]))
        # Every word of a source is taken `copies` times or once more; a copy holds a word once.
        assert set(times) <= set(range(n)) and all(r["copies"] <= times[i] <= min(3, r["copies"] + 1) for i in range(n))
        assert r["taken"] == sum(times.values()) <= 3 * n and len({(p["copy"], p["start"]) for p in r["pieces"]}) == len(r["pieces"])
        assert r["shard_quotas"] == [q[r["source"]] for q in given]
        taken[r["source"]] += r["taken"]
        for p in r["pieces"]:
            in_shard[r["source"]][p["shard"]] += p["end"] - p["start"]
    assert {s: taken[s] for s in take} == take
    for s, n in take.items():  # each shard has its quota of blocks, the last one what is left to the target
        for h in range(mixing.N_SHARDS - 1):
            assert abs(in_shard[s][h] - min(given[h][s] * block, n)) <= block
    again = mixing.mix(docs.repartition(3)).select("doc_id", "source", "mix.taken", "mix.pieces")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix(docs).select("doc_id", "source", "mix.taken", "mix.pieces").collect()))
    mixed = mixing.mixed_documents(docs.select("doc_id", "text", "source"))
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_of_many_blocks(spark):
    # 30,000 documents in three sources: shards are near their quotas, and few documents are cut.
    df = spark.range(30_000).selectExpr("id as doc_id", "trim(repeat('w ', cast(20 + id % 700 as int))) as text", "if(id % 3 = 0, 'a', if(id % 50 = 1, 'b', 'c')) as source")
    m = mixing.mix(df).selectExpr("source", "mix.*")
    sums = {r["source"]: r for r in m.groupBy("source").agg({"taken": "sum", "target": "max", "copies": "max"}).collect()}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in sums.values())
    shards = m.selectExpr("source", "shard_quotas", "explode(pieces) as p").groupBy("source", "p.shard").agg({"shard_quotas": "max"}).count()
    assert shards == 3 * mixing.N_SHARDS
    cut = m.filter("exists(pieces, p -> p.copy = copies) and aggregate(filter(pieces, p -> p.copy = copies), 0L, (s, p) -> s + p.end - p.start) < size").count()
    assert cut < 0.4 * 30_000


def test_quotas_equal_seat_by_seat():
    shares, limits, seats = [53.5, 24.0, 23.0, 10.1, 0.0, 2.2], [40, 40, 12, 40, 5, 1], 97
    got = [0] * 6
    for _ in range(seats):
        i = max((i for i in range(6) if got[i] < limits[i] and shares[i] > 0), key=lambda i: shares[i] / (2 * got[i] + 1))
        got[i] += 1
    assert mixing.quotas(shares, seats, limits) == got
    dealt = mixing.shard_quotas(shares, seats, limits, 5)
    assert [sum(x) for x in zip(*dealt)] == got and all(min(q) >= 0 and abs(sum(q) - seats / 5) < 1 for q in dealt)


def test_language(spark, docs, empty):
    import duckdb

    d = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    df = spark.createDataFrame(d, "doc_id long, text string, lang string")
    got = langid.identify_held_out(df).collect()
    lang = {r[0]: r[2] for r in d}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    model = langid.train(docs)
    odd = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (3, 4, 5, 18)] == ["und"] * 4 and odd[6]["lang_pred"] != "und" and odd[4]["kept"] == "clash"
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.filter("doc_id in (3, 4)"), model).collect()} == {"und"}


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_token_counts(docs, rows, empty, library):
    got = tokencount.token_counts(docs, tokenizer_path(), limit=3).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in got)
    assert tokencount.token_counts(empty, tokenizer_path()).count() == 0


def test_transducers_equal_the_library_on_random_text(library):
    rnd = np.random.default_rng(2)
    letters = list("ab '’srtvmdle\n\t 1é!?北<|>   ́") + ["<|endoftext|>", "'re", "    "]
    texts = ["".join(rnd.choice(letters, size=rnd.integers(0, 300))) for _ in range(400)] + ["y" * 3000, "", " "]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.count_tokens(texts, tokenizer_path()).tolist() == [len(x) for x in want]
    got = []
    for _, ids, n in tokenizer.encode(texts, tokenizer_path()):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want


def test_chunk_maps_compose_to_the_sequential_run():
    rnd = np.random.default_rng(4)
    classes = rnd.integers(0, 15, size=40 * tokenizer.CHUNK).astype(np.uint8)
    table, s, want = tokenizer.pretoken_table(), 0, []
    for i, c in enumerate(classes):
        s = table[(s & 15) * 16 + c]
        want.append(s & 15)
    maps = tokenizer.scan_maps(tokenizer.chunk_maps(np.ascontiguousarray(classes.reshape(-1, tokenizer.CHUNK).T)))
    assert maps[:, 0].tolist() == want[tokenizer.CHUNK - 1 :: tokenizer.CHUNK]


def brute_repeats(rows, w):
    seen = Counter(tuple(x[i : i + w]) for x in (words(r[1]) for r in rows) for i in range(len(x) - w + 1))
    out = []
    for r in rows:
        x, gone = words(r[1]), set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone |= set(range(i, i + w))
        out.append((r[0], len(x), len(gone), hashlib.sha256(" ".join(a for i, a in enumerate(x) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 22])
def test_substring(docs, rows, empty, window):
    got = substring.remove_repeats(docs, window).collect()
    mine = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got)
    assert mine == Counter(brute_repeats(rows, window))
    assert sum(r["n_removed"] for r in got) > 0 and all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)
    assert substring.remove_repeats(empty).count() == 0


def test_difference_cover():
    diffs = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert diffs == set(range(substring.PERIOD))


def test_packing(docs, rows, empty, library):
    got = packing.pack(docs, tokenizer_path()).collect()
    texts = defaultdict(list)  # id -> token ids of its documents
    for r in rows:
        texts[r[0]].append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences, places = defaultdict(list), Counter()
    for r in got:
        fits = [t for t in texts[r["doc_id"]] if len(t) == r["doc_tokens"]]
        piece = fits[0][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        places.update((r["doc_id"], r["doc_tokens"], i) for i in range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"], r["tier"], r["step"]))
    # Each token of each document lies in exactly one piece.
    assert places == Counter((i, len(t), x) for i, own in texts.items() for t in own for x in range(len(t)))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        s.sort()
        total = sum(x[1] for x in s)
        assert [x[0] for x in s] == np.cumsum([0] + [x[1] for x in s])[:-1].tolist() and total <= 1024
        assert {x[2:4] for x in s} == {(total, next(t for t in packing.TIERS if total <= t))} and len({x[4] for x in s}) == 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packing_fills_sequences_and_balances_steps(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(df.unionByName(df.withColumn("text", F.substring("text", 1, 400))), tokenizer_path()).toPandas()
    used = rows.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert padding <= 0.005 * used.sum()
    first = rows.drop_duplicates("sequence_id")
    assert set(first["tier"]) == set(packing.TIERS)
    steps = rows.groupby("step")["length"].sum()
    assert len(steps) > 5 and steps.max() - steps.min() <= 2 * sum(packing.TIERS)  # one sequence of each tier, and the few that stay emptier
    assert (first.groupby(["step", "tier"]).size().groupby("tier").agg(lambda x: x.max() - x.min()) <= 1).all()


def test_plan_places_every_rest_once():
    rnd = np.random.default_rng(0)
    kinds = {
        "even": rnd.integers(1, 1024, 3000), "one": np.full(3000, 700), "halves": np.full(2000, 768), "long": rnd.integers(600, 1023, 3000), "short": rnd.integers(1, 200, 5000),
        "mixed": np.concatenate([rnd.integers(513, 1000, 1500), rnd.integers(257, 512, 1500), rnd.integers(3, 256, 4000)]), "single": np.array([5]),
    }
    for name, lengths in kinds.items():
        counts = dict(zip(*np.unique(lengths, return_counts=True)))
        plan = packing.Plan({int(k): int(v) for k, v in counts.items()})
        by_key = defaultdict(list)
        for key, lo, hi, *_ in plan.slots:
            by_key[key].append((lo, hi))
        for key, runs in by_key.items():  # ranks without gap or overlap
            runs.sort()
            assert [a for a, _ in runs] == [0] + [b for _, b in runs][:-1]
        ends = {key: runs[-1][1] for key, runs in by_key.items()}
        assert all(plan.whole[r] <= n for r, n in counts.items())
        cut = Counter()
        for r, n in counts.items():
            for _, size in packing._cuts(int(r)):
                cut[2048 + size] += int(n) - plan.whole[r]
        assert {k: n for k, n in ends.items() if k > 2048} == {k: n for k, n in cut.items() if n}
        used = sum((hi - lo) // k * t for _, lo, hi, k, o, _, t, _ in plan.slots if o == 0)
        room = sum((hi - lo) // k * (0 if t & (t - 1) == 0 else 1024 - t) for _, lo, hi, k, o, _, t, _ in plan.slots if o == 0)
        assert used == lengths.sum() == plan.tokens
        assert room <= (1024 if name == "single" else 0.01 * used if len(counts) > 1 else 0.03 * used), (name, room / used)
        if name == "mixed":
            assert min(plan.of_tier) > 300 and sum(plan.of_tier) == plan.sequences


def test_html(spark):
    page = "<title>T</title><style>.x{display:none}</style><h1>Head</h1><p>One<p>Two<br>three &amp; four<div class=x>gone</div><ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>Name<th>Qty<tr><td>Apple<td>10</table><pre>  a\n   b</pre>1 < 2<script>x='</p>'</script><span hidden>no</span>"
    want = "Head\n\nOne\n\nTwo\nthree & four\n\n- a\n- b\n  1. c\n\nName   Qty\nApple  10\n\n  a\n   b\n\n1 < 2"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, "<p>x"), (1, "<div" * 3 + ">y</b></table>z"), (5, "<div>" * 3000 + "deep")], "page_id long, html string")
    got = {(r["page_id"], r["text"]) for r in htmltext.extract_text(pages).collect()}
    assert {(1, want), (2, ""), (3, ""), (None, "x"), (5, "deep")} <= got and len(got) == 6
    assert htmltext.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "css, shown",
    [
        ("@media print { .x {display:none} }", True), ("@media (max-width:600px){.x{display:none}}", True), ("@media screen and (max-width:9px){a{b:c} .x{display:none}}", True), ("@media print{@media screen{.x{display:none}}}", True),
        ("@supports (display:grid){.x{display:none}}", True), (".y{.x{display:none}}", True), ("@import 'a.css'; @media print{.y{display:none}} .x{display:none}", False), ("@media screen{.x{display:none}}", False),
        ("@media print, screen { @layer a { .x { display : none } } }", False), (".y{content:'}'} .x{display:none}", False), ("/* } */ .y, .x {color:red;display:none;.z{color:red}}", False), (".x{display:none", False),
    ],
)
def test_html_conditional_rules(css, shown):
    assert htmltext.visible_text(f"<style>{css}</style><p>One<p class=x>Two") == ("One\n\nTwo" if shown else "One")


def test_html_media_of_sheets_and_text_of_drawings_and_formulas():
    assert htmltext.visible_text("<style media=print>.x{display:none}</style><p class=x>One") == "One"
    assert htmltext.visible_text("<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> be") == "Let x=2 be"
    drawing = "<svg viewBox='0 0 9 9'><title>t</title><defs><text>d</text></defs><defs/><path d='M0'/><text>Sales</text><text x=1>2024</text></svg>"
    assert htmltext.visible_text(f"<p>One {drawing} two</p><p>three") == "One\nSales\n2024\ntwo\n\nthree"


@pytest.mark.parametrize(
    "table, want",
    [
        ("<tr><td rowspan=2>A<td>b<tr><td>c", "A  b\n   c"),
        ("<tr><td>a<td rowspan=0>R<td>b<tr><td>c<td>d<tbody><tr><td>e<td>f<td>g", "a  R  b\nc     d\ne  f  g"),
        ("<tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3", "wide     x\n1     2  3"),
        ("<tr><td rowspan=2 colspan=2>A<td>b<tr><td>c<tr><td>d<td>e<td>f", "A     b\n      c\nd  e  f"),
        ("<tr><td colspan='²'>x<td>y", "x  y"), (f"<tr><td colspan='{'9' * 5000}'>x<td>y", "x  y"), ("<tr><td colspan=-3 rowspan=x>x<td>y", "x  y"), (f"<tr><td rowspan={'0' * 5000}2>x<td>y<tr><td>z", "x  y\n   z"),
        ("<caption>C</caption><tr><td>a<td><table><tr><td>b<td>c</table>", "C\na  b  c"),
    ],
)
def test_html_cells_that_span(table, want):
    assert htmltext.visible_text(f"<table>{table}</table>") == want


def test_html_of_any_depth_and_length_takes_time_in_proportion():
    import time

    def took(page):
        start = time.process_time()
        text = htmltext.visible_text(page)
        return time.process_time() - start, text

    for make in (
        lambda n: "<div>" * n + "deep", lambda n: "<table><tr><td>" * n + "deep", lambda n: "<div><table><tr><td>" + "<b>" * n + "</div>" * n + "deep", lambda n: "<li><span>" * n + "deep",
        lambda n: "<p>" + "<svg><g>" * n + "<text>deep</text>", lambda n: "<p>some words here</p>" * n + "deep",
    ):
        small, large = took(make(2000)), took(make(16_000))
        assert "deep" in small[1] and "deep" in large[1] and large[0] < 8 * 4 * small[0] + 0.5
    assert htmltext.visible_text("<p>" + "x " * 1_000_000) == ("x " * 1_000_000).strip()


def test_html_rows_that_repeat_and_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "<p>a", "q"), (1, "<p>a", "q"), (1, "<p>b", None)], "page_id long, html string, text string").withColumn("n_chars", F.lit("clash"))
    assert sorted(map(tuple, htmltext.extract_text(pages).collect())) == [(1, "a", 1), (1, "a", 1), (1, "b", 1)]


def test_html_words_of_pages():
    import duckdb
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = None, []

        def handle_starttag(self, tag, attrs):
            self.skip = tag if tag in ("script", "style", "title") else self.skip

        def handle_endtag(self, tag):
            self.skip = None if tag == self.skip else self.skip

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet' WHERE html IS NOT NULL").fetchall():
        p = Plain()
        p.feed(html)
        p.close()
        assert "".join(htmltext.visible_text(html).replace("\n- ", "\n").removeprefix("- ").split()) == "".join("".join(p.out).split())


def test_exact(docs, rows, empty):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    keep = {k: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for k, g in groups.items()}
    got = exact.exact_groups(docs).collect()
    want = Counter((r[0], keep[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact.dedup_exact(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.exact_groups(empty).count() == 0 and exact.dedup_exact(empty).count() == 0


def brute_near(rows, size):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for r in rows:
        x = words(low(r[1]))
        sets.append(frozenset(tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))) if x else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("size", [4, 5])
def test_near(docs, rows, empty, size):
    got = minhash.near_duplicates(docs, size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows, size)
    left = minhash.dedup_near(docs, size)
    assert left.columns == docs.columns and left.count() == len({r["component_id"] for r in got})
    assert minhash.near_duplicates(empty).count() == 0


def test_near_in_a_family_around_the_threshold(spark):
    rnd = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    made = []
    for i in range(160):
        x = list(base)
        for p in rnd.choice(150, size=rnd.integers(1, 9), replace=False):
            x[p] = f"e{i}_{p}"
        made.append((1000 - i, " ".join(x)))
    made += [(2000 + i, " ".join(base[:60] + [f"v{i}_{k}" for k in range(40)])) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(made, 4)


def test_near_copies_far_from_each_other_are_not_all_compared(spark, monkeypatch):
    # Half of the copies changed too much to match the text that they come from, and in places of their own.
    compared = []
    exact_pairs = minhash._exact
    monkeypatch.setattr(minhash, "_exact", lambda pairs, sets: compared.append(pairs.count()) or exact_pairs(pairs, sets))
    rnd = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    made = [(5000, " ".join(base))]
    for i in range(500):
        x = list(base)
        for p in rnd.choice(150, size=1 + i % 7, replace=False):
            x[p] = f"e{rnd.integers(40)}"
        made.append((1000 + i, " ".join(x)))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 5).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(made, 5)
    assert sum(compared[1 + minhash.ROUNDS :]) < 2 * len(made)


@pytest.mark.parametrize("seed", range(3))
def test_near_by_differences_from_a_core(spark, monkeypatch, seed):
    # Without rounds of heads, and in lists of all sizes: copies of texts that are there or not, with words put in, left out, changed
    # and changed alike, copies of copies, and texts between two others.
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "LARGE", 2)
    rnd = np.random.default_rng(seed)
    made = []
    for f in range(4):
        base = [f"w{f}_{i}" for i in range(100)]
        origins = [base, base[:70] + [f"v{f}_{i}" for i in range(30)], [f"u{f}_{i}" for i in range(12)] + base[12:]]
        for i in range(60):
            x = list(origins[i % 3])
            for _ in range(rnd.integers(1, 6)):
                p, k = int(rnd.integers(len(x))), rnd.integers(4)
                x[p : p + int(rnd.integers(1, 4)) * (k == 2)] = [] if k == 2 else [f"e{rnd.integers(3)}"] * (1 + (k == 3))
            origins.append(x)
            if i % 5 == 0:
                origins[rnd.integers(3)] = x
            made.append((len(made), " ".join(x)))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(made, 4)


def test_near_copies_made_of_passages_that_others_share(spark):
    # P is the rarest passage of both copies; where the third document of its lists comes first, the copies meet in whole-set lists of two only.
    said = lambda name, n: " ".join(f"{name}_{i}" for i in range(n))
    made = []
    for f in range(12):
        p, q, r = (said(f"{x}{f}", n) for x, n in (("p", 14), ("q", 37), ("r", 42)))
        made += [f"{p} a{f} {q}", f"{p} b{f} {q}", f"{p} c{f} {r}"]
        made += [f"{q} {said(f'd{f}_{k}', 30)}" for k in range(3)] + [f"{r} {said(f'e{f}_{k}', 35)}" for k in range(3)]
    made = list(enumerate(made))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(made, 4)
    assert sum(r["doc_id"] != r["component_id"] for r in got) == 12


def test_near_keeps_one_row_of_each_component_whatever_its_ids(spark):
    said = lambda name: " ".join(f"{name}{i}" for i in range(40))
    made = [(None, said("a")), (None, said("b")), (None, said("b") + " more"), (None, said("c")), (5, said("d")), (5, said("e")), (5, said("e")), (3, said("f")), (6, said("f") + " more"), (6, said("g")), (7, ""), (7, said("h"))]
    left = {(r["doc_id"], r["text"]) for r in minhash.dedup_near(spark.createDataFrame(made, "doc_id long, text string"), 4).collect()}
    assert left - {made[1], made[2]} == {made[i] for i in (0, 3, 4, 5, 7, 9, 10, 11)} and len(left) == 9


def test_near_without_ids_in_whole_sets(spark):
    # A chain of near copies and a text by itself, all without ids.
    base = [f"w{i}" for i in range(150)]
    made = [(None, " ".join([f"e{j}" for j in range(7 * i)] + base[7 * i :])) for i in range(20)]
    made.append((None, "something else " * 30))
    assert minhash.dedup_near(spark.createDataFrame(made, "doc_id long, text string"), 4).count() == 2


def test_components(spark):
    rnd = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rnd.integers(0, 400, size=(260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in links for x in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}


def test_shards(docs, rows, empty):
    got = sharding.byte_shards(docs, 4).collect()
    size = lambda r: len((r[1] or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r), zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.byte_shards(empty).count() == 0


def brute_shards(rows, n_shards):
    """Bytes of each shard if all were cut at equal targets, and the texts that fit a shard."""
    sizes = Counter()
    for _, text in rows:
        sizes[text] += len((text or "").encode()) + 1
    target = sum(sizes.values()) / n_shards
    return target, {t for t, n in sizes.items() if n <= target}


@pytest.mark.parametrize("copies", [[], [1500], [40] * 30, [9000], [700, 650, 600, 500]])
def test_shards_are_even_and_keep_equal_texts_together(spark, copies):
    rows = [(i, "x" * (i % 90) + str(i // 2)) for i in range(4000)] + [(9000 + 10_000 * g + i, f"the same text {g}") for g, n in enumerate(copies) for i in range(n)]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16).toPandas()
    target, fits = brute_shards(rows, 16)
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 16 and (total - target).abs().max() <= target / 200 + 200
    slots = got.groupby("shard")["slot"].agg(["min", "max", "count", "nunique"])
    assert (slots["min"] == 0).all() and (slots["max"] + 1 == slots["count"]).all() and (slots["nunique"] == slots["count"]).all()
    split = {r: n for r, n in got.groupby("text_crc32")["shard"].nunique().items()}
    assert all(split[zlib.crc32((t or "").encode())] == 1 for t in fits)
    whole = got.groupby("text_crc32")["whole"].all()
    assert all(split[c] == 1 for c in whole[whole].index) and whole.all() == ({r[1] for r in rows} == fits)


def test_large_groups_are_placed_whole_where_they_fit():
    groups = [(1, 50, 5), (2, 60, 6), (3, 30, 3), (4, 120, 12), (5, 40, 4)]
    placed, room, slots = sharding._place(groups, 400, 4)
    assert placed == [(2, 0, 0), (1, 1, 0), (5, 2, 0), (3, 3, 0)] and room == [40, 50, 60, 70] and slots == [6, 5, 4, 3]


def brute_top(rows, every, k):
    """All scores as whole numbers of any size: rows that repeat an id are candidates of their own."""
    ok = [(i, tuple(math.floor(Fraction(x) * 256) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for q, v in sorted({x for x in ok if x[0] % every == 0}):
        s = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q and len(w) == len(v))[:k]
        want.update((q, n + 1, c, max(-(2**63), min(2**63 - 1, -x))) for n, (x, c) in enumerate(s))
    return want


def test_top_k(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rnd.normal(size=4)]) for i in range(120)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (None, [1.0] * 4), (204, [1.0, 2.0]), (250, [3.0, 1.0])]
    rows += [(300 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(9)] + [(300, [5.0, 5.0, 5.0, 5.0]), (303, [5.0, 5.0, 5.0, 5.0]), (350, []), (351, []), (400, [1.0] * 4), (400, [-1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "x", "key", "pack", "tile", "dim", "score", "rank")})
    for size in (1 << 22, 64):  # packs of two vectors: several tiles, merged as a tree
        monkeypatch.setattr(topk, "PACK_BYTES", size)
        v = topk.quantised(frame)
        got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v.filter("vec_id % 50 = 0"), v, 5).collect())
        assert got == brute_top(rows, 50, 5)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_top_k_of_vectors_of_any_size(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=3) * 10.0 ** rnd.integers(0, 13)]) for i in range(80)] + [(90, [1e200, -1e200, 1.0]), (91, [-1.7e308, 0.0, 2.0]), (92, [2.0**20 + 0.5, 1.0, 1.0]), (95, [2.0**52 + 0.5, 3.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v.filter("vec_id % 5 = 0 and vec_id < 90"), v, 4).collect())
    want = brute_top(rows, 5, 4)
    assert got == Counter({x: n for x, n in want.items() if x[0] < 90})


def test_top_k_of_scores_beyond_38_digits_goes_by_size(spark):
    sizes = [3.0e37, 1.0e25, 9.0e25, -1.0e25, -9.0e25, 2.0e30, -2.0e30, 1.0, 0.0]
    rows = [(0, [1.0e20]), *((i + 1, [x]) for i, x in enumerate(sizes))]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v.filter("vec_id = 0"), v, 9).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 6, 3, 2, 8, 9, 4, 5, 7]
    assert got[0]["score"] == 2**63 - 1 and got[-1]["score"] == -(2**63)


def test_html_layout_stays_in_proportion_and_loses_nothing():
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>z" + "<tr><td>a<td>b" * 2000 + "</table>"
    text = htmltext.visible_text(wide)
    assert len(text) < 10 * len(wide) and text.split() == ["w" * 20_000, "z"] + ["a", "b"] * 2000
    nested = htmltext.visible_text("<ul><li>x" * 3000)
    assert nested.split() == ["-", "x"] * 3000 and len(nested) < 150_000
    assert nested.split("\n")[:3] == ["- x", "  - x", "    - x"]
    before = time.perf_counter()
    spans = htmltext.visible_text("<table>" + "<tr><td colspan=1000 rowspan=1000>x" * 1000 + "</table>")
    assert spans.split() == ["x"] * 1000 and time.perf_counter() - before < 1
    page = "<table>" + "<tr><td rowspan=60000>x" * 3000 + "</table>"
    tall = htmltext.visible_text(page)
    assert tall.split() == ["x"] * 3000 and len(tall) < 20 * len(page)


def test_html_columns_are_aligned_up_to_the_width():
    rows = "<tr><td>one<td>" + "m" * 30 + "<td>end<tr><td>" + "n" * 150 + "<td>k<td>end<tr><td><td>b"
    lines = htmltext.visible_text(f"<table>{rows}</table>").split("\n")
    at = htmltext.WIDEST + 2
    assert lines[0] == "one".ljust(at) + "m" * 30 + "  end" and lines[1] == "n" * 150 + "  k" + "  end" and lines[2] == " " * at + "b"


def packed_right(pieces, rows, library):
    """Each token of each document lies in exactly one piece, and pieces fill sequences without gaps."""
    sequences, places, want = defaultdict(list), Counter(), Counter()
    for i, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, len(ids), int(x), n) for n, x in enumerate(zlib.crc32(ids[k : k + 1].tobytes()) for k in range(len(ids))))
    by_doc = defaultdict(list)
    for i, text in rows:
        by_doc[i].append(np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    for r in pieces:
        fits = [d for d in by_doc[r["doc_id"]] if len(d) == r["doc_tokens"] and zlib.crc32(d[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        piece = fits[0][r["start"] : r["start"] + r["length"]]
        places.update((r["doc_id"], r["doc_tokens"], zlib.crc32(piece[k : k + 1].tobytes()), r["start"] + k) for k in range(len(piece)))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert places == want
    for s in sequences.values():
        s.sort()
        assert [x for x, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 1024


def test_pipeline_stages(spark, docs, rows, library):
    """Each stage's rows against a brute-force version, on its own input."""
    import corpus_pipeline as cp

    stages, key = dict(cp.STAGES), lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    left = docs.select("doc_id", "text", "lang", "source", "n_chars")
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out = stages["language"](spark, left, "").cache()
    assert Counter(map(tuple, out.collect())) == Counter(letters)

    groups = defaultdict(list)
    for r in letters:
        groups[norm(r[1])].append(r)
    best = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    out = stages["exact"](spark, out, "").cache()
    assert Counter(map(tuple, out.collect())) == Counter(best)

    component = {(i, n): c for i, n, c in brute_near(best, 5)}
    assert len(component) == len({(i, n) for i, n, _ in brute_near(best, 5)})
    kept = {c for (i, _), c in component.items()}
    out = stages["near"](spark, out, "").cache()
    left_ids = [r["doc_id"] for r in out.collect()]
    assert Counter(left_ids) == Counter(kept) and set(map(tuple, out.collect())) <= set(best)

    mixed_from = [tuple(r) for r in out.collect()]
    out = stages["mixture"](spark, out, "").cache()
    got = out.collect()
    _, _, take, _, _ = brute_mix(mixed_from, mixing.N_SHARDS)
    words_of = Counter()
    for r in got:
        words_of[r["source"]] += len(words(r["text"]))
        of = next(x for x in mixed_from if x[0] == r["doc_id"])
        assert r["n_chars"] == len(r["text"]) and not Counter(words(r["text"])) - Counter(words(of[1])) and (r["lang"], r["source"]) == of[2:4]
    assert all(words_of[s] == n for s, n in take.items())

    packed_right(stages["packed"](spark, out, "").collect(), [(r["doc_id"], r["text"]) for r in got], library)


def test_pipeline_of_an_empty_table_and_of_rows_without_ids(spark, docs, library):
    import corpus_pipeline as cp

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.select(columns).limit(0), "").count() == 0
    odd = spark.createDataFrame([(None, f"some text number {i} of {'many ' * (i % 3)}words", None, None, None) for i in range(6)] + [(None, None, None, None, None), (None, "", None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        odd = stage(spark, odd, "").cache()
        assert odd.columns == columns and odd.count() == 6, name
    packed_right(cp.STAGES[-1][1](spark, odd, "").collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], library)


def test_language_machines_grow_with_the_languages_not_with_their_pairs():
    codes = [f"x{i}" for i in range(100)]
    assert len(langid.machines_of(codes)) == 100 and langid.machines_of(["en"]) == []
    assert langid.machines_of(["de", "en", "es", "fr"]) == [("", "germanic", ""), ("", "romance", ""), ("germanic", "de", "en"), ("romance", "es", "fr")]


def test_language_of_close_and_distant_languages(spark):
    said = {"de": "der Hund und die Katze gehen nicht über die Straße", "en": "the dog and the cat do not walk over the street", "nl": "de hond en de kat lopen niet over de straat", "fr": "le chien et le chat ne vont pas dans la rue", "xx": "zqx vuk zzq qxz kvu"}
    df = spark.createDataFrame([(i, t, k) for k, t in said.items() for i in range(len(k), 60, 3)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == sorted(said)
    for k, t in said.items():
        lang, score = model.predict([t, t.upper(), t * 50])
        assert lang == [k] * 3 and all(0 < s <= 1 for s in score)
    only = langid.train(df.filter("lang = 'fr'"))
    assert only.predict(["anything"])[0] == ["fr"]


def test_word_keys_are_equal_just_for_equal_words():
    from stopwise.llm.common import word_keys

    rnd = np.random.default_rng(9)
    letters = list("ab\x00\x7fAZéß漢😀 \t\n\x0b\x0c\r\x1c\x85  ")
    texts = ["".join(rnd.choice(letters, size=rnd.integers(0, 60))) for _ in range(500)]
    texts += ["", " ", "x" * 14, "x" * 15, "x" * 16, "x" * 16 + "y", "x" * 8, "x" * 8 + "\x00", "y" * 300_000, "y" * 300_001, "\x00", "\x00\x00", "a" * 7 + "é", " lead", "trail "]
    for lower in (False, True):
        low = (lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if lower else (lambda t: t)
        keys, counts = word_keys(texts, lower)
        want = [words(low(t)) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        flat = [w for x in want for w in x]
        pairs = set(zip(flat, map(tuple, keys.tolist())))
        assert len(pairs) == len(set(flat)) == len({k for _, k in pairs}) > 300
    assert word_keys([])[0].shape == (0, 2) and word_keys([""])[1].tolist() == [0]
    assert (word_keys(["one two three"])[0][1] == word_keys(["two"])[0][0]).all()


def test_repeats_tell_keys_apart_that_agree_in_part():
    from stopwise.llm import repeats

    keys = np.array([[5, 1], [5, 2], [5, 1], [7, 1], [5, 3], [7, 1]], np.uint64)
    distinct, inverse, counts = repeats._distinct(keys)
    assert distinct.tolist() == [[5, 1], [5, 2], [5, 3], [7, 1]] and counts.tolist() == [2, 1, 1, 2]
    assert (distinct[inverse] == keys).all()


def test_mixture_takes_columns_of_any_name(spark, docs):
    """Names that the plan uses inside are the caller's to use."""
    names = ["target", "copies", "extra", "block", "factor", "source_size", "shard_quotas", "_size", "_key", "_part", "words"]
    plain = docs.select("doc_id", "text", "source")
    named = plain.withColumns({c: F.lit("mine") for c in names})
    both = [sorted((r["doc_id"] or -1, r["mix"]["taken"], r["mix"]["target"]) for r in mixing.mix(d).collect()) for d in (plain, named)]
    assert both[0] == both[1]
    out = mixing.mixed_documents(named)
    assert out.columns == named.columns and out.filter(" or ".join(f"`{c}` <> 'mine'" for c in names)).count() == 0
