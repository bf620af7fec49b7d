import pytest

# Columns that operators use inside; given as inputs, they must not clash.
CLASHING = ("ids", "f", "key", "name", "part", "spans", "high", "low", "at", "maybe", "label", "score", "gone", "leak", "carried", "canon", "lang")

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))

EDGES = [
    (None, None), (None, "a text without an id, token = abcdefgh"), (1, ""), (2, None), (3, "one"), (3, "one"), (4, " \t\n "), (5, LONG), (6, LONG + " x"), (7, "ÀÉ ß naïve 日本語 🎉"),
    (8, "Der " * 400), (9, "Der " * 400), (10, "it's we'll\n\n  x\ty"),
]


@pytest.fixture(scope="session")
def edges(spark):
    columns = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, *["x"] * len(CLASHING)) for i, t in EDGES]
    return spark.createDataFrame(rows, f"doc_id long, text string, {columns}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
