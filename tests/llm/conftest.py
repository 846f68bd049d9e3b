import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from orrery.llm.shared import ship

    ship(spark)


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns with the names that operators add."""
    rows = [
        (1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, None), (3, "the same words stand in this line of text twice", "en", None, None, "y"), (4, "the same words stand in this line of text twice", "en", "b", 5, "y"),
        (4, "the same words stand in this line of text twice", "en", "b", 5, "y"), (None, "a row without an id has some words too", None, None, None, None), (5, "word " * 30_000, "de", "b", 1, "z"), (6, "\n\n \n\t", "fr", "c", 4, "z"), (7, "1 2 3 !!! ☃", "es", "c", 9, "z"),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, {}"
    return lambda *names: spark.createDataFrame([r[:5] + (r[5],) * len(names) for r in rows], kinds.format(", ".join(f"`{n}` string" for n in names)) if names else kinds[:-4])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
