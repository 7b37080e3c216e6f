"""Rows that repeat an id, in partitions of their own, keep what no smaller id has."""

from claimloom.llm import recompression


def test_repeated_rows_keep_their_text(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, "before it " + text + " after it")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in recompression.dedup(docs).collect())
    assert got == [(1, 40, 0), (1, 40, 0), (2, 44, 40)]
