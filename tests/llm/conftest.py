import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest table, all of it."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


#: Nulls, empty texts, ties, repeated rows, a text of many words.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "one"),
    (5, "the same line\nthe same line\n\nthe same line"),
    (5, "the same line\nthe same line\n\nthe same line"),
    (6, " ".join(f"w{i}" for i in range(3000))),
    (7, " ".join(f"w{i}" for i in range(3000)) + " tail"),
    (8, "ÀÉ ß \x0b x\x0cy 漢字 #*$%&|<>"),
    (None, "row without an id that has some words"),
    (9, "a " * 500),
    (10, " ".join(f"w{i}" for i in range(100, 140))),
]


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names clash with those that operators add."""
    rows = [(i, t, f"extra{n}", n, True, 1.0) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n_words int, kept boolean, score double")
