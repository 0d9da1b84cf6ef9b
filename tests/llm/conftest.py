import pytest

#: null, empty, blank, short, repeated, very long; keys repeat and are null
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "The same text twice over, word for word, in two rows here."), (5, "The same text twice over, word for word, in two rows here."), (6, "The same text twice over, word for word, in two rows here."), (None, "A row without a key, but with some words in it all the same."), (7, LONG), (8, "x" * 100_000), (9, "emoji 🎉 and é́ combining \u0000 nul")]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with extra columns whose names clash with outputs."""
    extra = "lang string, source string, n_chars long, score string, spans string, kept string, language string, n_words string, class_id string, base_failed string, length string, host string, media string, text_key string, node string, term string"
    rows = [(k, t, "en", "src0", len(t or ""), *["x"] * 13) for k, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").cache()
