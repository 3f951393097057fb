"""The registered chunk queries keep a text's tail, however long."""

from lodestone.operators import chunking
from lodestone.plans import catalog


def test_no_chunk_is_dropped(spark, tmp_path):
    text = " ".join(f"word{k} ends here." for k in range(60000))
    row = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    row.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    want = chunking.split_text(text)
    assert len(want) > chunking.MOST_CHUNKS
    for name in ("chunk_documents_text", "ingest_chunks_by_strategy"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).orderBy("chunk_index").collect()
        assert [r.chunk for r in got] == want and {r.total_chunks for r in got} == {len(want)}
