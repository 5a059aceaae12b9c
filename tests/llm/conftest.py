import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def some_rows():
    base = " ".join(f"term{i} and" for i in range(120))
    rows = [
        (1, "Hello big world", "en", "a", 15), (2, "Hello  big\tworld", "en", "a", 16), (3, "", "en", None, 0), (4, None, None, "b", None), (5, "12 34 !!", "en", "b", 8), (6, LONG, "en", "c", len(LONG)),
        (7, base, "en", "a", 1), (8, base + " extra", "en", "b", 1), (9, base.replace("term5 ", "other "), "en", "b", 1), (10, f"x y {PASSAGE} z", "fr", "a", 1), (11, f"{PASSAGE} tail end", "fr", "c", 1),
        (12, "Größe über Straße", "de", "c", 1), (13, "a<|endoftext|>b", "en", "d", 1), (14, "don't  we'll\n\n  'tis", "en", "d", 1), (None, "an unnamed text", "en", "a", 1), (15, "Hello big world", "en", "a", 15),
        (16, "twice", "en", "a", 5), (16, "twice", "en", "a", 5), (17, "日本語 テキスト", "ja", "e", 1), (18, "\x0b\x0c", "en", "e", 2), (19, "the the the the the the", "en", "e", 1), (20, "A B C", "en", "a", 1), (21, "a b c", "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages; extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(some_rows(), DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("size", "mix", "kept", "h", "score", "lang_pred", "part", "n", "unit", "norm", "label")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def rows():
    return some_rows()
