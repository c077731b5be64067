import pytest

SF = "/root/testdata/sf0.001"
LINES = ["a line that many documents hold, surely", "  A LINE that many documents hold, surely\t", "short", ""]
#: doc_id, text, lang, source: nulls, empty texts, copies, repeated rows, one long text.
ODD = [
    (1, "The cat sat on the mat.\n" + LINES[0], "en", "s1"),
    (2, "The cat sat on the mat.\n" + LINES[0], "en", "s1"),
    (3, LINES[1] + "\n" + LINES[0] + "\n" + LINES[0], "en", None),
    (4, "", None, "s2"),
    (5, None, "en", "s2"),
    (6, " \n\t\n", None, None),
    (7, "word " * 30_000 + "end", "en", "s1"),
    (8, "été à l'école, 漢字 \U0001f389 12%", "fr", "s3"),
    (8, "été à l'école, 漢字 \U0001f389 12%", "fr", "s3"),
    (9, LINES[0] + "\nx", "en", "s3"),
    (None, "no id at all", "en", "s1"),
    (None, None, None, None),
    (2**62 + 1, "The cat sat on the mat.", "en", "s1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with further columns whose names clash with those of results and, but for case, of inputs."""
    rows = [(*r[:4], k, "t", True, 1.5) for k, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, TEXT string, group_size boolean, hash double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
