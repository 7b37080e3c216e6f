"""Every operator on odd rows and on an empty table: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from claimloom.llm import line_dedup, media, mixing, ordinal, packing, recompression, simhash, suffix_index, token_counts, winnowing

OPERATORS = {
    "packing": packing.pack_documents,
    "mixing": mixing.mix,
    "recompression": recompression.dedup,
    "suffix_index": suffix_index.dedup,
    "winnowing": winnowing.edited_fingerprints,
    "line_dedup": line_dedup.dedup,
    "simhash": simhash.near_duplicates,
    "ordinal": lambda d: ordinal.classify(d, None),
    "media": lambda d: media.digests(media.encode_column(d)),
    "token_counts": token_counts.token_counts,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](odd).collect()
    if name == "packing":
        pieces = [r for r in got if r.piece == 0]
        assert len(pieces) == 9 and sum(r.length == 1 for r in pieces) == 3
    else:
        assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[None]) == 2 and len(by[1]) >= 2
    if name == "mixing":
        assert all(r.taken <= 3 * r["size"] for r in got) and by[2][0]["size"] == 0
    if name == "recompression":
        assert by[4][0].n_removed == 0 and by[5][0].n_removed == by[5][0].n_words == 60_000
        assert all(r.n_removed == 0 for r in by[None] + by[1])
    if name == "suffix_index":
        assert by[4][0].n_removed == by[4][0].n_bytes == by[5][0].n_removed and by[6][0].n_removed == 200_000
    if name == "simhash":
        assert by[1][0].component_id == 1 and by[5][0].component_id == 4 and by[2][0].component_id == 2 == by[3][0].component_id
        assert {r.component_id for r in by[None]} == {None, 2}
    if name == "line_dedup":
        assert {r.n_removed for r in by[1]} == {0} and by[5][0].n_removed == 1 and by[2][0].text is None and by[4][0].key == "clash"
    if name == "ordinal":
        assert all(r.keep for r in got)
    if name == "media":
        assert by[2][0].payload_bytes == 64 and by[2][0].media_sha256 == by[3][0].media_sha256
    if name == "token_counts":
        assert by[2][0].n_tokens == 0 and by[6][0].n_bytes == 200_000


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows.withColumn("n_chars", F.char_length("text").cast("long")), str(tmp_path))
            if stage is not corpus_pipeline.packing_stage:
                assert got.columns == [*rows.columns, "n_chars"], name
            assert got.count() >= 0
