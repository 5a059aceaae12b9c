"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release_memory, stored, text_of

#: Language codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
}
#: Labelled documents that the classifiers learn from, for each language at most.
SAMPLE = 500
#: Sampled ids that are sent to every task at most (16 bytes each).
BROADCAST = 100_000
BITS = 16
ORDERS = (1, 2, 3)
#: Characters of the short passages that are learned beside whole texts.
PASSAGES = (40, 160)
SLAB = 400_000
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"own:{lang}")


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hashed character n-grams of this order at every position where one begins."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ points[i : i + n]) * np.uint32(_FACTORS[i])
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint32)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, scaled to length 1."""
    index, count = np.unique(np.concatenate([_grams(_points(text), o) for o in ORDERS]), return_counts=True)
    value = count / max(1.0, float(np.sqrt((count.astype(float) ** 2).sum())))
    return index, value


_SAMPLES = "lang string, key long, size long, index binary, value binary"


def _sampler(batches):
    """Features of sampled documents: of the whole text and of two short passages, so that short documents are learned
    too. A row has 2**BITS n-grams at most, six bytes each."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    schema = pa.schema(list(zip(("lang", "key", "size", "index", "value"), types)))
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for lang, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            places = [(key * 7919 + i * 104729) % max(1, len(text) - size + 1) for i, size in enumerate(PASSAGES)]
            for t in (text, *(text[p : p + size] for p, size in zip(places, PASSAGES))):
                index, value = _features(t)
                row = (lang, key, len(index), index.astype("<u2").tobytes(), value.astype("<f4").tobytes())
                for column, x in zip(columns, row):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine, by dual coordinate descent over sparse rows of length 1. Both signs
    weigh the same, however many rows they have."""
    w, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    most = {s: c * len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (1.0, -1.0)}
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            y = float(sign[i])
            new = min(max(alpha[i] - (y * float(w[index] @ value) - 1), 0.0), most[y])
            if new != alpha[i]:
                w[index] += (new - alpha[i]) * y * value
                alpha[i] = new
    return w


def machines_of(langs: list[str]) -> list[tuple[str, str, str]]:
    """(level, first, second) of every machine: at level "" one for each family against all others, and inside a
    family one for each pair of its languages. So codes that are families of their own add one machine each."""
    families = sorted({family_of(x) for x in langs})
    out = [("", f, "") for f in families] if len(families) > 1 else []
    for f in families:
        out += [(f, a, b) for a, b in combinations([x for x in langs if family_of(x) == f], 2)]
    return out


def _fit(pdf):
    """One machine from its samples."""
    pdf = pdf.sort_values(["lang", "key", "size"], kind="stable")
    rows = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(pdf["index"], pdf["value"])]
    w = linear_svm(rows, pdf["sign"].to_numpy(float))
    return pd.DataFrame({"machine": [int(pdf["machine"].iloc[0])], "weights": [w.astype("<f4").tobytes()]})


class Model:
    """The family whose machine is surest, then votes of one-versus-one machines among its languages."""

    def __init__(self, langs: list[str], weights: dict[int, bytes]):
        self.langs = sorted(langs)
        self.families = sorted({family_of(x) for x in self.langs})
        self.machines = machines_of(self.langs)
        self.weights = [np.frombuffer(weights[m], "<f4") for m in range(len(self.machines))]
        self.of_family = [[m for m, (level, *_) in enumerate(self.machines) if level == f] for f in ("", *self.families)]

    def _slab(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text, and its score. A machine's margin is the mean weight of a text's n-grams."""
        parts = [_points(t) for t in texts]
        points, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        grams, starts, stops = [], [], []
        for o in ORDERS:
            g = _grams(points, o)
            first = np.minimum(np.concatenate(([0], ends[:-1])), len(g))
            starts.append(first)
            stops.append(np.minimum(np.maximum(ends - o + 1, first), len(g)))  # n-grams across two texts are left out
            grams.append(g)
        number = np.maximum(sum(b - a for a, b in zip(starts, stops)), 1)

        def margins(m: int, mine: np.ndarray) -> np.ndarray:
            total, w, every = np.zeros(len(mine)), self.weights[m], len(mine) == len(texts)
            for g, a, b in zip(grams, starts, stops):
                a, b = a[mine], b[mine]
                if not every:  # the n-grams of these texts only
                    g = np.concatenate([g[x:y] for x, y in zip(a.tolist(), b.tolist())])
                    b = np.cumsum(b - a)
                    a = np.concatenate(([0], b[:-1]))
                sums = np.concatenate(([0.0], np.cumsum(w[g], dtype=np.float64)))
                total += sums[b] - sums[a]
            return total / number[mine]

        everyone = np.arange(len(texts))
        sure = lambda x: 1 / (1 + np.exp(np.clip(-40 * x, -50, 50)))
        family, score = np.zeros(len(texts), np.int64), np.ones(len(texts))
        if self.of_family[0]:
            m = np.stack([margins(i, everyone) for i in self.of_family[0]], axis=1)
            family = np.argmax(m, axis=1)
            p = sure(m)
            score = p[everyone, family] / np.maximum(p.sum(axis=1), 1e-12)
        lang = np.zeros(len(texts), np.int64)
        for f, own in enumerate(self.of_family[1:]):
            mine = np.flatnonzero(family == f)
            names = [i for i, x in enumerate(self.langs) if family_of(x) == self.families[f]]
            if not len(mine) or len(names) == 1:
                lang[mine] = names[0]
                continue
            votes, share = np.zeros((len(mine), len(names))), np.zeros((len(mine), len(names)))
            for i in own:
                _, a, b = self.machines[i]
                a, b = names.index(self.langs.index(a)), names.index(self.langs.index(b))
                m = margins(i, mine)
                p = sure(m)
                share[:, a] += p
                share[:, b] += 1 - p
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
            best = np.argmax(votes + share / (len(names) + 1), axis=1)  # the share breaks ties
            lang[mine] = np.array(names)[best]
            score[mine] *= share[np.arange(len(best)), best] / (len(names) - 1)
        return lang, score

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= SLAB):
                size += len(texts[b])
                b += 1
            lang[a:b], score[a:b] = self._slab(texts[a:b])
            a = b
        return [self.langs[i] for i in lang], score


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE
) -> Model:
    """Learns from at most per_language documents of each language, those with the smallest hash of their id.

    Rows without language, letters or id are left out; ties of the hash go to the smaller id, and rows that repeat a chosen
    id are learned from together; an empty table gives a model that knows no language.

    Each machine is fitted in a task of its own from the samples of its languages.  Only weights reach the driver, 2**BITS
    numbers for each machine.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    w = Window.partitionBy("lang").orderBy("key", "doc_id")
    # The sampled ids are sought first, among narrow rows; only their texts are read again.
    narrow = rows.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.abs(F.xxhash64(F.lit(3), id_col) % (1 << 40)).alias("key")
    )
    ids = narrow.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_language).select("doc_id", "key").distinct()
    ids = stored(ids)
    sent = F.broadcast(ids) if ids.count() <= BROADCAST else ids  # else a join that shuffles the texts
    chosen = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen = chosen.join(sent, "doc_id").select("lang", "key", "text")
    samples = stored(chosen.mapInArrow(_sampler, _SAMPLES))
    langs = sorted(r["lang"] for r in samples.select("lang").distinct().collect())  # the known languages
    signs = []
    for m, (level, a, b) in enumerate(machines_of(langs)):
        for x in langs:
            if level == "":
                signs.append((m, x, 1 if family_of(x) == a else -1))
            elif x in (a, b):
                signs.append((m, x, 1 if x == a else -1))
    weights = {}
    if signs:
        dealt = samples.join(F.broadcast(spark.createDataFrame(signs, "machine int, lang string, sign int")), "lang")
        fitted = dealt.groupBy("machine").applyInPandas(_fit, "machine int, weights binary")
        weights = {r["machine"]: bytes(r["weights"]) for r in fitted.collect()}
    discard(ids, samples)
    return Model(langs, weights)


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and a score from 0 to 1 (input columns of these names are replaced).

    Only the text decides.  Null texts and texts without a letter are `und` with score 0.
    Every row is predicted by itself from its whole text; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in into]
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # 2**BITS weights for each family and each pair inside a family

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = len(texts)
            lang, score = shipped.value.predict(texts.tolist()) if shipped.value.langs else (["und"] * n, np.zeros(n))
            yield pd.DataFrame({"lang": lang, "score": score})
        release_memory()

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, letters.alias("_letters"), predict(text_of(text_col)).alias("_p"))
    return rows.select(*keep, F.when(F.col("_letters"), F.col("_p.lang")).otherwise("und").alias(into[0]), F.when(F.col("_letters"), F.col("_p.score")).otherwise(0.0).alias(into[1]))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents that are not held out and predicts all of them."""
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
