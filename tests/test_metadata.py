"""Merged metadata of hits: precedence, absent maps, hidden values."""

from lodestone.operators import fusion
from pyspark.sql import functions as F

SCHEMA = "id int, info map<string,string>, metadata map<string,string>, components array<map<string,string>>, chunk_index int"


def merged(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    m = fusion.merged_metadata(F.col("info"), F.col("metadata"), F.col("components"), F.col("chunk_index"), F.lit(3))
    return [r.m for r in df.select("id", m.alias("m")).orderBy("id").collect()]


def test_absent_maps_give_root_fields_and_defaults(spark):
    nothing, nulls = merged(spark, (None, None, None, 1), ({"url": None}, {"word_count": None}, [None], None))
    empty = dict.fromkeys(("source_url", "document_id", "created_at", "last_modified", "repo_name", "project_id", "file_path"), "")
    assert nothing == {**empty, "chunk_index": "1", "total_chunks": "3", "conversion_failed": "false", "is_excel_sheet": "false"}
    assert nulls == {k: v for k, v in nothing.items() if k != "chunk_index"}


def test_later_maps_win(spark):
    info, nested = {"url": "u", "source": "repo"}, {"section_title": "nested", "file_name": "0", "file_directory": "a/b//", "character_count": "0", "char_count": "", "line_count": "0", "sub_chunk_index": "9"}
    parts = [{"section_title": "first", "source_url": "part", "_own": "x"}, None, {"section_title": "second", "project_id": None, "Api_Key_Name": "k", "tokens": "t"}]
    (got,) = merged(spark, (info, nested, parts, 1))
    assert got["section_title"] == "second" and got["source_url"] == "part" and got["project_id"] is None and got["repo_name"] == "repo"
    assert got["file_path"] == "a/b/0" and got["char_count"] == "0" and got["chunk_index"] == "9"
    assert "_own" not in got and got["Api_Key_Name"] == got["tokens"] == "[REDACTED]"
