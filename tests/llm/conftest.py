import pytest

EXTRA = "size long, key string, fp long, h long, n long, row long, score double, x string, base long, extra long, target double, component long, spans string, range int"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    more = (7, "k", 1, 2, 3, 4, 0.5, "x", 1, 2, 0.5, 3, "s", 1)
    long = " ".join(f"word{i % 911}" for i in range(30_000))
    rows = [
        (1, "Hello world, this is a first small text for the test.", "en", "b", 52, *more),
        (1, "Hello world, this is a first small text for the test.", "en", "b", 52, *more),
        (2, None, None, None, None, *more),
        (3, "", "en", "a", 0, *more),
        (4, "   \n\t ", "en", "a", 6, *more),
        (5, "one", "fr", "a", 3, *more),
        (6, long, "en", "a", len(long), *more),
        (None, "no id here at all, é日本 \u0001\u0002", "en", "c", 20, *more),
        (8, "Hello world, this is a first small text for the test.", "en", None, 52, *more),
    ]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
