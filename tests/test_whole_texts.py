"""Queries that run an operator over whole texts see every word of them."""

from docspark import queries

SF = "/root/testdata/sf0.001"


def test_headings_and_cuts_are_of_whole_texts(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    assert any(len(t) > 90 and "\n" in t for t in texts.values())
    headings = {r.doc_id: r.heading for r in queries.QUERIES["heading_prefix"](spark, SF).collect()}
    assert headings.keys() == texts.keys() and all(headings[i].endswith(t) for i, t in texts.items())
    for r in queries.QUERIES["truncate_words"](spark, SF).collect():
        words = texts[r.doc_id].split()
        if len(words) > 25:
            assert r.short == " ".join(words[:25]) + "..."


def test_similarity_is_of_whole_texts(spark, tmp_path):
    text = "abcd" * 150 + "e" * 200
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert abs(queries.QUERIES["gold_similarity"](spark, str(tmp_path)).first().ned - 0.75) < 1e-12
