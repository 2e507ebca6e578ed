import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, lang_pred string, uid string, size string, line string, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows, with extra columns whose names operators use."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), 0, "s", "l", "u", "z", "x", "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA).coalesce(2)

    return make


