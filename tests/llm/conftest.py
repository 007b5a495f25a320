import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Rows as a Parquet table, read again."""
    def store(rows, schema=DOCUMENTS, parts=3):
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture(scope="session")
def odd_documents(stored):
    """Nulls everywhere, empty and very long texts, repeated rows and texts, odd characters."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", None), (None, "text without an id here", None, None, 3), (3, "", "en", "a", 0),
        (4, long, "en", "a", len(long)), (5, "one two three four five six seven eight nine ten eleven", "en", "b", 1),
        (5, "one two three four five six seven eight nine ten eleven", "en", "b", 1),
        (6, "one two three four five six seven eight nine ten eleven", None, "b", 1),
        (7, "a" * 5000, "de", "b", 5000), (8, " \n\t\n ", "fr", None, 5), (9, "über Straße 漢字 \U0001f600 \x00 end", "de", "c", 9),
        (10, long + " tail", "en", "a", 1), (None, None, None, None, None),
    ]
    return stored(rows)


@pytest.fixture(scope="session")
def no_documents(stored):
    return stored([], parts=1)
