import pytest

ODD = [
    (1, "The cat sat on the mat and then it went away again.", "en", 5),
    (2, None, "en", None),
    (3, "", "en", 0),
    (4, " \n\t ", None, 3),
    (1, "The cat sat on the mat and then it went away again.", "en", 5),
    (None, "Le chat est sur le tapis, et puis il s'en va.", "fr", 1),
    (6, "12345 !!! 678", "de", 2),
    (7, "word " * 60_000, "en", 9),
    (8, "ß   日本語 😀 \x00 é", "xx", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, and columns named like those the operators add."""
    rows = [(*r, 0.5, "x", 7, True, 1, "a") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score double, lang_pred string, component_id long, kept boolean, n_tokens long, label string").repartition(2)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
