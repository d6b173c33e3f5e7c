import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        extra = "cast(null as string) as n_words, 'x' as kept, 1 as score, array(1) as spans, 0 as size, 'y' as _row"
        return frame.selectExpr("*", *extra.split(", "))

    return make
