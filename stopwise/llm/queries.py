"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark, sf_dir):
    from .mixing import mix

    m = mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.pieces")


def mix_targets(spark, sf_dir):
    """What op1 takes of each source, beside its target."""
    m = op1_mix_sources(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = m.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
    return sums.withColumn("target", F.round("target", 6))


def op6_html_text(spark, sf_dir):
    from .htmltext import extract_text

    return extract_text(_read(spark, sf_dir, "pages"))


def op7_exact_dedup(spark, sf_dir):
    from .exact import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_byte_shards(spark, sf_dir):
    from .sharding import byte_shards

    s = byte_shards(_read(spark, sf_dir, "documents"), n_shards=16)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "whole")


def op10_exact_top_k(spark, sf_dir):
    from .topk import quantised, top_k

    v = quantised(_read(spark, sf_dir, "embeddings"))
    return top_k(v.filter("vec_id % 50 = 0"), v, k=5)


def op4_substring_dedup(spark, sf_dir):
    from .substring import remove_repeats

    r = remove_repeats(_read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash_dedup(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op2_language_id(spark, sf_dir):
    from .langid import identify_held_out

    return identify_held_out(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark, sf_dir):
    from .tokencount import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_suffix_dedup(spark, sf_dir):
    from .suffixdedup import remove_earlier

    r = remove_earlier(_read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """op12's input: doc_id and text. In the documents whose checksum ends in 0 the words from place a on repeat p of them."""
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    rest = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get("words", (F.col("a") + i % F.col("p")).cast("int")))
    planted = F.concat_ws(" ", F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), rest))
    return d.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    from .periodic import collapse_runs

    r = collapse_runs(with_planted_runs(_read(spark, sf_dir, "documents")))
    # By exponent, an exact fraction; then by start and period: the order in which runs come.
    higher = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda b, x: F.when(higher(x, b), x).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    r = r.withColumns({"best": best, "listed": listed})
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_token_counts, op4_substring_dedup, op5_packing, op6_html_text, op7_exact_dedup, op8_minhash_dedup, op9_byte_shards, op10_exact_top_k, op11_suffix_dedup, op12_periodic_runs, op13_whitening, mix_targets, pipeline)}

ORACLE_SQL = {
    # With sources in order of the level at which they reach their limit, the level of all others follows from sums.
    "mix_targets": r"""
        WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
        k AS (SELECT *, 3 * size / weight AS reached, row_number() OVER (ORDER BY 3 * size / weight) AS i FROM w),
        l AS (SELECT k.i, ((SELECT sum(size) FROM k) - coalesce(sum(3 * b.size), 0)) / nullif((SELECT sum(weight) FROM k) - coalesce(sum(b.weight), 0), 0) AS level, any_value(k.reached) AS reached
              FROM k LEFT JOIN k b ON b.i < k.i GROUP BY k.i),
        f AS (SELECT min_by(level, i) AS level FROM l WHERE reached >= level),
        t AS (SELECT source, size, CAST(least(3 * size, weight * level) AS DOUBLE) AS target FROM k, f)
        SELECT source, size AS source_size, round(target, 6) AS target, CAST(least(round_even(target, 0), 3 * size) AS BIGINT) AS taken FROM t""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS rn,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op10_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM d),
        p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
        k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM p ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    # Strings are cut from parts of 500 bytes, in hexadecimal digits; then islands of the places where repeated ones start.
    "op11_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        b AS (SELECT r, doc_id, n, k, substr(h, 2 * k + 1, 1098) AS part FROM (SELECT *, unnest(range(0, n - 49, 500)) AS k FROM d WHERE n >= 50)),
        s AS (SELECT r, doc_id, k + i AS pos, substr(part, 2 * i + 1, 100) AS w FROM (SELECT *, unnest(range(0, least(500, n - k - 49))) AS i FROM b)),
        m AS (SELECT w, min(doc_id) AS least_id FROM s GROUP BY w),
        g AS (SELECT r, pos, coalesce(pos > lag(pos) OVER (PARTITION BY r ORDER BY pos) + 50, true) AS opens FROM s JOIN m USING (w) WHERE least_id < doc_id),
        i AS (SELECT r, pos, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY pos) AS island FROM g),
        p AS (SELECT r, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY r, island),
        k AS (SELECT p.r, p.a, p.b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY p.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY p.r ORDER BY a), 0))) AS ahead FROM p JOIN d USING (r)),
        t AS (SELECT r, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS upto, string_agg(ahead, '' ORDER BY a) AS kept FROM k GROUP BY r)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)""",
    "op8_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w JOIN m ON m.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
}
