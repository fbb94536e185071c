import tempfile

import pytest

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))

# null, empty, blank, very long, repeated and tied rows; other columns with names the operators use
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "a"),
    (2, None, "b"),
    (3, "", "c"),
    (4, " \t\n ", "d"),
    (5, LONG, "e"),
    (6, "alpha  beta gamma\ndelta epsilon zeta eta theta", "f"),
    (7, "x", "g"),
    (7, "x", "g"),
    (8, LONG + " tail", "h"),
    (None, "no id here", "i"),
    (None, None, None),
    (9, "Ünï cödé 😀 中文 \x00 ​", "j"),
]
CLASHES = ["ids", "spans", "row", "kept", "component_id", "text_sha256", "toxicity", "may_repeat", "dropped_id", "toxic"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return docs.withColumns({name: F.lit(f"extra {name}") for name in CLASHES})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture
def tables(spark):
    """Write tables into a new folder; returns its path."""

    def write(**frames):
        path = tempfile.mkdtemp(prefix="run-")
        for name, frame in frames.items():
            frame.write.parquet(f"{path}/{name}.parquet")
        return path

    return write
