import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp string, target string, _id string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns of names that the operators use inside."""

    def make(texts, sources=None, ids=None):
        rows = []
        for k, t in enumerate(texts):
            i = k if ids is None else ids[k]
            s = f"s{k % 3}" if sources is None else sources[k]
            rows.append((i, t, None, s, None if t is None else len(t), f"r{k}", "f", "t", "i"))
        return spark.createDataFrame(rows, SCHEMA)

    return make
