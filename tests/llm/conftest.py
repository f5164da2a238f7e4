import os

import pytest

DATA = os.environ.get("TESTDATA", "/root/testdata")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A ``documents`` frame from texts (ids from 1) or (id, text) pairs, with ``extra`` columns of any name."""

    def make(texts, extra=()):
        pairs = [t if isinstance(t, tuple) else (i + 1, t) for i, t in enumerate(texts)]
        rows = [(i, t, None, "s", None if t is None else len(t), *(f"x{i}" for _ in extra)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in extra))

    return make


#: Names that the operators use inside; a table may have columns called so.
CLASHING = ("score", "node", "sig", "hub", "pos", "th", "h", "item_id", "part", "seq", "n_removed", "component_id", "label", "t", "base", "ids", "n_shingles", "gone", "gone_id", "gone_th", "cut", "toxic", "arrival", "__gone", "__th", "__id", "__cut", "__toxic", "__arrival")
#: Null, empty, blank, tied, repeated and very long texts, null and repeated ids.
HARD = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "nobody knows this"), (None, None), (7, "long " * 60_000), (8, "w" * 200_000), (9, "\x00 naïve 日本語 \U0001f600")]


@pytest.fixture(scope="session")
def hard(make_docs):
    return make_docs(HARD, CLASHING)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([], CLASHING)
