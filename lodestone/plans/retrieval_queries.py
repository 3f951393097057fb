"""Retrieval, fusion and facet queries (Q, R, H, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import facets, fusion, postings, query as understanding, retrieval, search
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.storage import folder

#: The queries: every benchmark item whose id is divisible by 20, with its whole text.
_Q = "q AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark WHERE item_id % 20 = 0)"
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def whole_batch(spark, sf):
    """Every benchmark item whose id is divisible by 20, with its whole text."""
    return table(spark, sf, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def _tokens(name, source, key):
    return f"{name} AS (SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]{{2,}}')) AS token FROM {source}) WHERE token NOT IN ({_STOP}) GROUP BY ALL)"


_TOK = f"{_Q}, {_tokens('qt', 'q', 'query_id')}, docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_tokens('dt', 'docs', 'doc_id')}"
_SPARSE = f"""{_TOK}, sp0 AS (SELECT query_id, doc_id, round(sum(d.tf * 2.2 / (d.tf + 1.2) * (1 + ln(q.tf))), 6) AS score FROM dt d JOIN qt q USING (token) GROUP BY ALL),
 sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp0)"""
_BM = f"""len AS (SELECT doc_id, sum(tf) AS len FROM dt GROUP BY 1), fact AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len), dfq AS (SELECT token, count(*) AS df FROM dt GROUP BY 1),
 raw AS (SELECT token, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfq, fact), mean AS (SELECT avg(raw) AS mean FROM raw), idf AS (SELECT token, avgdl, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean),
 bm0 AS (SELECT query_id, d.doc_id, round(sum(idf * d.tf * 2.5 / (d.tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl)) * q.tf), 6) AS score FROM dt d JOIN qt q USING (token) JOIN idf USING (token) JOIN len ON len.doc_id = d.doc_id GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm0 WHERE score > 0)"""


_SPARSE_SQL = f"WITH {_SPARSE} SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM sp WHERE rank <= 20"
_BM_SQL = f"WITH {_TOK}, {_BM} SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM bm WHERE rank <= 20"


@query("search_sparse", _SPARSE_SQL)
@query("search_sparse_whole", _SPARSE_SQL)
def sparse(spark, sf):
    d = results(spark, sf)
    return _long(retrieval.in_blocks(whole_batch(spark, sf), lambda q: retrieval.sparse(q, d, 20)))


@query("search_bm25", _BM_SQL)
@query("search_bm25_whole", _BM_SQL)
def bm25(spark, sf):
    d = results(spark, sf)
    return _long(retrieval.in_blocks(whole_batch(spark, sf), lambda q: retrieval.bm25(q, d, 20)))


@query("search_bm25_stored", _BM_SQL)
def bm25_stored(spark, sf):
    path = folder(spark, "postings")
    postings.build(results(spark, sf), path)
    return _long(retrieval.in_blocks(whole_batch(spark, sf), lambda q: postings.bm25(spark, path, q, 20)))


def _long(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("sparse_encode_documents", f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_tokens('dt', 'docs', 'doc_id')} SELECT doc_id, token, CAST(tf AS BIGINT) AS tf, round(tf * 2.2 / (tf + 1.2), 6) AS w FROM dt")
def encode_documents(spark, sf):
    return retrieval.encode_documents(results(spark, sf), "doc_id", "text").withColumn("w", F.round("w", 6))


_VEC = "v AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT doc_id, label, list_transform(v, x -> x / sqrt(list_inner_product(v, v))) AS v FROM v)"


def points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("v"))


def whole_vectors(spark, sf):
    return points(spark, sf).where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "v")


_DENSE_SQL = f"""WITH {_VEC}, h AS (SELECT q.doc_id AS query_id, p.doc_id, list_inner_product(p.v, q.v) AS exact, round(list_inner_product(p.v, q.v), 6) AS score FROM u p, u q WHERE q.doc_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE exact >= 0.1)
SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10"""
_FILTERED_SQL = _DENSE_SQL.replace("% 20 = 0)", "% 20 = 0 AND p.label IN (1, 3))").replace(" WHERE exact >= 0.1", "")


@query("search_dense", _DENSE_SQL)
@query("search_dense_whole", _DENSE_SQL)
def dense(spark, sf):
    return _long(retrieval.dense_blocks(whole_vectors(spark, sf), points(spark, sf), 10, 0.1))


@query("search_dense_filtered", _FILTERED_SQL)
@query("search_dense_filtered_whole", _FILTERED_SQL)
def dense_filtered(spark, sf):
    return _long(retrieval.dense_blocks(whole_vectors(spark, sf), points(spark, sf), 10, where=F.col("label").isin(1, 3)))


_LISTS = f"""{_SPARSE}, {_BM}, v AS (SELECT query_id, doc_id, rank AS vr, score AS vs FROM sp WHERE rank <= 30), k AS (SELECT query_id, doc_id, rank AS kr, score AS ks FROM bm WHERE rank <= 30),
 m AS (SELECT query_id, doc_id, vr, kr, coalesce(vs, 0.0) AS vs, coalesce(ks, 0.0) AS ks FROM v FULL JOIN k USING (query_id, doc_id)),
 f AS (SELECT *, coalesce(0.6 / (60 + vr), 0.0) + coalesce(0.3 / (60 + kr), 0.0) AS rrf, count(*) OVER (PARTITION BY query_id) AS n FROM m)"""


def lists(spark, sf):
    d, q = results(spark, sf), whole_batch(spark, sf)
    return retrieval.in_blocks(q, lambda b: retrieval.sparse(b, d, 30)), retrieval.in_blocks(q, lambda b: retrieval.bm25(b, d, 30))


_SEARCH_HYBRID_WRRF_SQL = f"WITH {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(rrf, 9) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10"


@query("search_hybrid_wrrf", _SEARCH_HYBRID_WRRF_SQL)
@query("search_hybrid_wrrf_whole", _SEARCH_HYBRID_WRRF_SQL)
def hybrid(spark, sf):
    fused = fusion.wrrf(*lists(spark, sf), 0.6, 0.3).withColumn("score", F.round("score", 9))
    return _long(retrieval.top_k(fused, 10).select("query_id", "doc_id", "score", "rank"))


_FUSION_MODES_AND_THRESHOLD_SQL = f"""WITH {_LISTS}, s AS (SELECT query_id, doc_id, CASE WHEN n >= 10 THEN 'wrrf' ELSE 'linear' END AS mode, round(CASE WHEN n >= 10 THEN rrf ELSE 0.6 * vs + 0.3 * ks END, 9) AS score, CASE WHEN n >= 10 THEN 0.3 * 0.9 / 61 ELSE 0.3 END AS least FROM f)
SELECT query_id, doc_id, mode, score FROM s WHERE score > least"""


@query("fusion_modes_and_threshold", _FUSION_MODES_AND_THRESHOLD_SQL)
@query("fusion_modes_and_threshold_whole", _FUSION_MODES_AND_THRESHOLD_SQL)
def fusion_modes(spark, sf):
    return fusion.combined(*lists(spark, sf), 0.6, 0.3, 0.3)


_FUSION_LINEAR_SCORES_SQL = f"""WITH {_LISTS}, w AS (SELECT query_id, doc_id, 0.6 * vs + 0.3 * ks + 0.1 * (doc_id % 10) AS raw FROM m) SELECT query_id, doc_id, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN round(raw / max(raw) OVER (PARTITION BY query_id), 9) ELSE 0.0 END AS score FROM w"""


@query("fusion_linear_scores", _FUSION_LINEAR_SCORES_SQL)
@query("fusion_linear_scores_whole", _FUSION_LINEAR_SCORES_SQL)
def fusion_linear(spark, sf):
    return linear(lists(spark, sf))


def linear(both):
    m = fusion.merge(*both).select("query_id", "doc_id", F.coalesce("vs", F.lit(0.0)).alias("vs"), F.coalesce("ks", F.lit(0.0)).alias("ks"), (F.col("doc_id") % 10).alias("ms"))
    return fusion.linear_scores(m, 0.6, 0.3, 0.1).select("query_id", "doc_id", "score")


_FUSION_MIN_MAX_SQL = f"""WITH {_SPARSE}, t AS (SELECT query_id, doc_id, score FROM sp WHERE rank <= 50) SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 9) ELSE 0.0 END AS scaled FROM t WINDOW w AS (PARTITION BY query_id)"""


@query("fusion_min_max", _FUSION_MIN_MAX_SQL)
@query("fusion_min_max_whole", _FUSION_MIN_MAX_SQL)
def fusion_min_max(spark, sf):
    d = results(spark, sf)
    hits = retrieval.in_blocks(whole_batch(spark, sf), lambda q: retrieval.sparse(q, d, 50))
    return fusion.min_max(hits, "score", "query_id").select("query_id", "doc_id", "scaled")


_BOOST = """least(0.5, 0.8 * 0.05 + CASE WHEN source_type = 'git' THEN (1.4 - 1) * 0.2 ELSE 0 END + CASE WHEN source_type = 'confluence' THEN (1.2 - 1) * 0.2 ELSE 0 END + CASE WHEN has_code_blocks THEN 0.15 ELSE 0 END + CASE WHEN has_tables THEN 0.12 ELSE 0 END
 + CASE WHEN section_level <= 2 THEN 0.10 WHEN section_level = 3 THEN 0.05 ELSE 0 END + CASE WHEN word_count > 500 THEN 0.10 WHEN word_count > 100 THEN 0.05 ELSE 0 END + CASE WHEN is_converted AND file_type IN ('docx', 'xlsx', 'pdf') THEN 0.08 ELSE 0 END + CASE WHEN is_excel_sheet THEN 0.12 ELSE 0 END
 + CASE WHEN list_has_any(list_transform(entities, x -> lower(x)), ['data table', 'entity 3']) THEN 0.10 ELSE 0 END + CASE WHEN list_has_any(list_transform(topics, x -> lower(x)), ['data table', 'entity 3']) THEN 0.08 ELSE 0 END)"""


@query("boost_factors", f"WITH {R} SELECT doc_id, round(CAST({_BOOST} AS DOUBLE), 6) AS factor FROM results")
def boost(spark, sf):
    factor = fusion.boost({"git": 1.4, "confluence": 1.2}, 0.8, ("code", "tables"), ("data table", "entity 3"))
    return results(spark, sf).select("doc_id", F.round(factor, 6).alias("factor"))


_BUS = " OR ".join(f"contains(lower(source_title), '{w}') OR contains(lower(text), '{w}')" for w in fusion.BUSINESS)


@query("filter_content_types", f"WITH {R} SELECT doc_id, has_code_blocks AS code, {_BUS} AS business, contains(section_type, 'guide') AS guide FROM results")
def content_types(spark, sf):
    return results(spark, sf).select("doc_id", *[fusion.content_filter((k,)).alias(k) for k in ("code", "business", "guide")])


@query("result_titles", f"WITH {R} SELECT doc_id, source_title AS title FROM results")
def titles(spark, sf):
    return results(spark, sf).select("doc_id", fusion.chosen_title().alias("title"))


_S = lambda x: f"CAST({x} AS STRING)"
#: Payload of a result, as text: root, nested metadata, and two components, of which the first may lack.
_ROOT = {"url": "source_url", "document_id": "document_id", "source": "source", "created_at": _S("created_day")}
_NESTED = {
    "file_name": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE file_name END", "file_directory": f"CASE WHEN doc_id % 3 = 0 THEN concat('dir', {_S('doc_id % 5')}, '/') END", "file_size": _S("file_size"),
    "file_type": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE file_type END", "original_file_type": "'original'", "char_count": _S("doc_id % 3"), "line_count": _S("doc_id % 100"),
    "sub_chunk_index": f"CASE WHEN doc_id % 5 = 0 THEN {_S('doc_id % 4 + 10')} END", "section_title": "section_type",
}
_PARTS = ({"section_title": "source_title", "depth": _S("depth"), "_own": "'x'"}, {"Author_Token": "author", "word_count": _S("word_count")})
_OWN = {
    "file_path": f"CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat('dir', {_S('doc_id % 5')}, '/', file_name) ELSE file_name END",
    "original_filename": _NESTED["file_name"], "file_size": _NESTED["file_size"], "original_file_type": "CASE WHEN doc_id % 4 = 0 THEN 'original' ELSE file_type END",
    "char_count": _S("CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 ELSE doc_id % 3 END"), "chunk_index": _S("CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 + 10 ELSE chunk_index END"), "total_chunks": "'4'", "conversion_failed": "'false'", "is_excel_sheet": "'false'",
}
_MERGED = [
    *[f"SELECT doc_id, 0 AS p, '{k}' AS k, {v} AS v FROM results" for k, v in {"source_url": "source_url", "document_id": "document_id", "created_at": _S("created_day"), "last_modified": "''", "repo_name": "coalesce(source, '')", "project_id": "coalesce(source, '')"}.items()],
    *[f"SELECT doc_id, 1, '{k}', {v} FROM results WHERE {v} IS NOT NULL" for k, v in {**_OWN, "section_title": "section_type"}.items()],
    *[f"SELECT doc_id, 2, '{k}', {_PARTS[0][k]} FROM results WHERE doc_id % 6 <> 0" for k in ("section_title", "depth")],
    "SELECT doc_id, 3, 'Author_Token', '[REDACTED]' FROM results", f"SELECT doc_id, 3, 'word_count', {_S('word_count')} FROM results",
]


@query("result_metadata", f"WITH {R}, e AS ({' UNION ALL '.join(_MERGED)}) SELECT doc_id, k AS field, v AS value FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY p DESC) = 1")
def metadata(spark, sf):
    m = lambda fields: "map(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    r = results(spark, sf).selectExpr("doc_id", f"{m(_ROOT)} AS info", f"{m(_NESTED)} AS metadata", f"array(CASE WHEN doc_id % 6 <> 0 THEN {m(_PARTS[0])} END, {m(_PARTS[1])}) AS components", "chunk_index")
    merged = fusion.merged_metadata(F.col("info"), F.col("metadata"), F.col("components"), F.col("chunk_index"), F.lit(4))
    return r.select("doc_id", F.explode(merged).alias("field", "value"))


@query("result_deduplicate", f"WITH {R}, k AS (SELECT doc_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY doc_id) AS r FROM results) SELECT doc_id, parent_id FROM k WHERE parent_id IS NULL OR r = 1")
def deduplicate(spark, sf):
    return fusion.deduplicate(results(spark, sf).select("doc_id", "parent_id"), "parent_id", [F.col("doc_id")])


@query("result_diversity")
def diversity(spark, sf):
    d = results(spark, sf)
    hits = retrieval.in_blocks(whole_batch(spark, sf), lambda q: retrieval.sparse(q, d, 50)).join(d.select("doc_id", "source_type", "section_type", "source"), "doc_id")
    return fusion.diversify(hits.select("query_id", "doc_id", "score", "source_type", "section_type", "source"), 0.5, 20)


_RESULT_RERANK_SQL = rf"""WITH {_SPARSE}, w AS (SELECT s.query_id, s.doc_id, s.score, list_distinct(regexp_extract_all(lower(q.text), '\w+')) AS qw, list_distinct(regexp_extract_all(lower(substr(d.text, 1, 1000)), '\w+')) AS dw, d.text FROM sp s JOIN q USING (query_id) JOIN docs d ON d.doc_id = s.doc_id WHERE rank <= 30),
 r AS (SELECT query_id, doc_id, round(len(list_intersect(qw, dw)) / greatest(len(qw), 1), 6) AS rerank_score, score FROM w WHERE trim(text) <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, doc_id) AS rank FROM r)
SELECT query_id, doc_id, rerank_score, CAST(rank AS BIGINT) AS rank FROM o WHERE rank <= 10"""


@query("result_rerank", _RESULT_RERANK_SQL)
@query("result_rerank_whole", _RESULT_RERANK_SQL)
def rerank(spark, sf):
    d = results(spark, sf)
    return retrieval.in_blocks(whole_batch(spark, sf), lambda q: reranked(d, q))


def reranked(d, q):
    hits = retrieval.sparse(q, d, 30).drop("rank").join(q.withColumnRenamed("text", "asked"), "query_id").join(d.select("doc_id", "text"), "doc_id")
    # Java's \w is ASCII by default, as is the oracle's.
    return _long(fusion.rerank(hits, F.col("asked"), F.col("text"), 10).select("query_id", "doc_id", "rerank_score", "rank"))


@query("search_field_query", f"WITH {R} SELECT doc_id, source_type, 1.0::DOUBLE AS score FROM results WHERE source_type = 'confluence' AND chunk_index = 0 AND (project_id IN ('en', 'src3') OR source IN ('en', 'src3')) ORDER BY doc_id LIMIT 100")
def field_query(spark, sf):
    parsed = understanding.parse('source_type:confluence chunk_index:0 colour:red')
    where = understanding.predicate(parsed, ("en", "src3"))
    return retrieval.filter_only(results(spark, sf), where, 100).select("doc_id", "source_type", "score")


_KNOWN = rf'\b(?:{"|".join(understanding.FIELDS)}):(?:"[^"]+"|[^\s"]+)'
_ASK = "concat('source_type:git title:\"API Docs\" colour:red ', coalesce(text, ''), ' chunk_index:3')"


@query("query_parse_fields", rf"""WITH q AS (SELECT item_id, {_ASK} AS t FROM benchmark) SELECT item_id, array_to_string(list_transform(regexp_extract_all(t, '{_KNOWN}'), x -> replace(x, '"', '')), ';') AS fields, trim(regexp_replace(regexp_replace(t, '{_KNOWN}', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS clean FROM q""")
def parse_fields(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit('source_type:git title:"API Docs" colour:red '), F.coalesce("text", F.lit("")), F.lit(" chunk_index:3")).alias("t"))
    return understanding.parse_table(q, "t").select("item_id", F.array_join("fields", ";").alias("fields"), "clean")


_PREF = ", ".join(rf"regexp_matches(lower(t), '\b({'|'.join(w)})\b') AS {k}" for k, w in understanding.PREFERENCES.items())
_ASK2 = "concat(CASE item_id % 4 WHEN 0 THEN 'how does the api code fail? ' WHEN 1 THEN 'business requirements and goals ' WHEN 2 THEN 'What is the overview table ' ELSE 'fix setup guide error ' END, coalesce(text, ''))"


@query("query_context", rf"""WITH q AS (SELECT item_id, {_ASK2} AS t FROM benchmark) SELECT item_id, contains(t, '?') OR regexp_matches(lower(t), '^\s*({'|'.join(understanding.QUESTION_WORDS)})\b') AS is_question,
 len(list_filter(regexp_split_to_array(trim(lower(t)), '\s+'), w -> w <> '')) < 5 AS is_broad, len(list_filter(regexp_split_to_array(trim(lower(t)), '\s+'), w -> w <> '')) > 7 AS is_specific, {_PREF} FROM q""")
def query_context(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", F.expr(_ASK2).alias("t"))
    return q.select("item_id", *[c.alias(k) for k, c in understanding.context(F.col("t")).items()])


_EXP = "CASE " + " ".join(f"WHEN contains(lower(t), '{k}') THEN t || ' {v}'" for k, v in understanding.SYNONYMS) + " ELSE t END"


@query("query_expansion", f"WITH q AS (SELECT item_id, {_ASK2} AS t FROM benchmark) SELECT item_id, {_EXP} AS expanded FROM q")
def query_expansion(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", F.expr(_ASK2).alias("t"))
    return q.select("item_id", understanding.expand(F.col("t")).alias("expanded"))


_INT = ", ".join(f"('{i.name}', [{', '.join(repr(k) for k in i.keywords)}], {i.weight})" for i in understanding.INTENTS)


@query("query_intents", f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower({_ASK2}), '[a-z]+')) AS w FROM benchmark), i(intent, words, weight) AS (VALUES {_INT}),
 s AS (SELECT item_id, intent, round(len(list_intersect(w, words)) / len(words) * weight, 6) AS score FROM q, i), r AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS top, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, intent) AS rank FROM s)
SELECT item_id, max(CASE WHEN rank = 1 THEN CASE WHEN top < 0.3 THEN 'general' ELSE intent END END) AS "primary", CAST(max(top) AS DOUBLE) AS confidence, coalesce(string_agg(CASE WHEN rank BETWEEN 2 AND 4 AND score > 0 AND score >= 0.3 * top THEN intent END, ',' ORDER BY intent), '') AS secondary FROM r GROUP BY item_id""")
def query_intents(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", F.expr(_ASK2).alias("t"))
    return understanding.intents(q, "item_id", "t")


@query("expand_document", f"WITH {R} SELECT doc_id, group_id, chunk_index FROM results WHERE 'g' || CAST(group_id AS VARCHAR) = 'g7' ORDER BY chunk_index LIMIT 500")
def expand_document(spark, sf):
    chunks = results(spark, sf).withColumn("document_id", F.concat(F.lit("g"), F.col("group_id").cast("string")))
    return retrieval.expand_document(chunks, "g7").select("doc_id", "group_id", "chunk_index")


@query("expand_chunk_context", """SELECT l_orderkey, l_linenumber, CAST(count(*) OVER w AS BIGINT) AS context_size, array_to_string(list(CAST(l_partkey AS VARCHAR)) OVER w, ',') AS context FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def expand_chunk_context(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    out = retrieval.chunk_context(li.withColumn("p", F.col("l_partkey").cast("string")), "l_orderkey", "l_linenumber", "p")
    return out.select("l_orderkey", "l_linenumber", "context_size", F.array_join("context", ",").alias("context"))


@query("embedding_batches", f"""WITH {R}, t AS (SELECT doc_id, CAST(least(2000, ceil(length(text) / 4.0)) AS BIGINT) AS tokens, doc_id % 16 AS bucket FROM results WHERE trim(text) <> '') SELECT doc_id, tokens, bucket, CAST(coalesce(sum(tokens) OVER (PARTITION BY bucket ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8000 AS BIGINT) AS batch FROM t""")
def embedding_batches(spark, sf):
    return retrieval.embedding_batches(results(spark, sf), "doc_id", "text", 8000, 2000, F.col("doc_id") % 16)


_FV = {
    "content_type": "[source_type]", "project": "[project_id]", "has_features": "[CASE WHEN has_code_blocks THEN 'code' END, CASE WHEN has_tables THEN 'tables' END, CASE WHEN has_images THEN 'images' END, CASE WHEN has_links THEN 'links' END, CASE WHEN is_attachment THEN 'attachment' END]",
    "entities": "list_transform(entities, x -> lower(trim(x)))", "topics": "list_transform(topics, x -> lower(trim(x)))", "read_time": "[CASE WHEN read_time <= 2 THEN 'quick' WHEN read_time <= 10 THEN 'medium' ELSE 'long' END]",
    "hierarchy_depth": "[CASE WHEN depth <= 2 THEN 'shallow' WHEN depth <= 4 THEN 'medium' WHEN depth IS NOT NULL THEN 'deep' END]", "file_type": "[file_type]", "section_type": "[section_type]", "section_level": "['level_' || CAST(section_level AS VARCHAR)]",
    "word_count": "[CASE WHEN word_count <= 100 THEN 'short' WHEN word_count <= 500 THEN 'medium' WHEN word_count IS NOT NULL THEN 'long' END]", "attachment_type": "[CASE WHEN is_attachment THEN file_type END]",
}
_FROWS = "fr AS (" + " UNION ALL ".join(f"SELECT '{k}' AS facet, unnest(list_filter({v}, x -> x IS NOT NULL)) AS value, doc_id FROM results" for k, v in _FV.items()) + ")"
_FMOST = "CASE facet " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in facets.FACETS.items()) + " END"
_FCOUNT = f"{_FROWS}, fn AS (SELECT facet, value, count(*) AS n FROM fr GROUP BY ALL), fk AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM fn), fc AS (SELECT * FROM fk WHERE rank <= {_FMOST})"


@query("facet_counts", f"WITH {R}, {_FCOUNT} SELECT facet, value, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM fc")
def facet_counts(spark, sf):
    return _long(facets.facet_counts(results(spark, sf)))


@query("facet_order", f"WITH {R}, {_FCOUNT}, c AS (SELECT facet, count(*) AS n_values, CASE facet {' '.join(f'WHEN {f!r} THEN {k}' for k, f in enumerate(list(facets.FACETS)[:9]))} ELSE 999 END AS priority FROM fc GROUP BY facet) SELECT facet, CAST(n_values AS BIGINT) AS n_values, CAST(priority AS BIGINT) AS priority, CAST(row_number() OVER (ORDER BY priority, n_values DESC, facet) AS BIGINT) AS position FROM c")
def facet_order(spark, sf):
    return facets.facet_order(facets.facet_counts(results(spark, sf))).withColumn("position", F.col("position").cast("long"))


@query("facet_filter", f"WITH {R} SELECT doc_id FROM results WHERE source_type IN ('git', 'jira') AND has_code_blocks AND has_links")
def facet_filter(spark, sf):
    return results(spark, sf).where(facets.facet_filter({"content_type": (("git", "jira"), "OR"), "has_features": (("code", "links"), "AND")})).select("doc_id")


@query("facet_search", f"WITH {R}, {_FROWS}, s AS (SELECT facet, value, fr.doc_id FROM fr JOIN results USING (doc_id) WHERE results.has_tables) SELECT facet, value, CAST(count(*) AS BIGINT) AS n FROM s WHERE facet IN ('content_type', 'project', 'read_time') GROUP BY ALL")
def facet_search(spark, sf):
    kept = results(spark, sf).where(facets.facet_filter({"has_features": (("tables",), "OR")}))
    return facets.facet_counts(kept).where(F.col("facet").isin("content_type", "project", "read_time")).select("facet", "value", "n")


@query("facet_refinements", f"WITH {R}, {_FCOUNT}, t AS (SELECT count(*) AS total FROM results) SELECT facet, value, CAST(n AS BIGINT) AS n, round(100 * (1 - n / total), 1) AS reduction FROM fc, t WHERE facet NOT IN ('entities', 'topics') AND rank <= 3 AND n < 0.8 * total ORDER BY reduction DESC, facet, value LIMIT 5")
def facet_refinements(spark, sf):
    return facets.refinements(results(spark, sf), ("entities", "topics")).select("facet", "value", "n", "reduction")


@query("facet_coverage", f"WITH {R}, {_FROWS}, t AS (SELECT count(*) AS total FROM results) SELECT facet, round(100 * count(DISTINCT doc_id) / any_value(total), 1) AS percent FROM fr, t GROUP BY facet")
def facet_coverage(spark, sf):
    return facets.coverage(results(spark, sf))


@query("hierarchy_filter", f"WITH {R} SELECT doc_id FROM results WHERE source_type IN ('confluence', 'localfile') AND parent_id IS NOT NULL AND depth = 3")
def hierarchy_filter(spark, sf):
    return results(spark, sf).where(facets.hierarchy_filter(root_only=False, depth=3)).select("doc_id")


@query("hierarchy_groups", f"""WITH {R}, g AS (SELECT coalesce(string_split(breadcrumb_text, ' > ')[1], source_title) AS root, depth, source_title, doc_id FROM results), o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY coalesce(depth, 0), source_title, doc_id) AS r FROM g)
SELECT root, CAST(count(*) AS BIGINT) AS n, max(depth) AS deepest, max(CASE WHEN r = 1 THEN doc_id END) AS first FROM o GROUP BY root""")
def hierarchy_groups(spark, sf):
    return facets.by_hierarchy(results(spark, sf))


@query("attachment_filter", f"WITH {R} SELECT doc_id FROM results WHERE is_attachment AND file_type IN ('pdf', 'xlsx') AND (file_size IS NULL OR file_size >= 5000) AND (file_size IS NULL OR file_size <= 100000)")
def attachment_filter(spark, sf):
    return results(spark, sf).where(facets.attachment_filter(("pdf", "xlsx"), 5000, 100000)).select("doc_id")


@query("attachment_like", rf"WITH {R} SELECT doc_id FROM results WHERE is_attachment OR file_type IN ('pdf', 'docx', 'xlsx') OR regexp_matches(source_url, '\.[A-Za-z0-9]{{2,4}}$')")
def attachment_like(spark, sf):
    return results(spark, sf).where(facets.attachment_like()).select("doc_id")


_FRIEND = "CASE file_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in facets.FRIENDLY.items()) + " END"


@query("attachment_groups", f"WITH {R} SELECT {_FRIEND} AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM results WHERE is_attachment GROUP BY 1")
def attachment_groups(spark, sf):
    return facets.by_attachment_type(results(spark, sf))


@query("hierarchy_family", f"WITH {R}, c AS (SELECT parent_id AS p, count(*) AS n FROM results WHERE parent_id IS NOT NULL GROUP BY 1) SELECT r.document_id, CAST(coalesce(s.n - 1, 0) AS BIGINT) AS siblings, CAST(coalesce(c.n, 0) AS BIGINT) AS children FROM results r LEFT JOIN c s ON s.p = r.parent_id LEFT JOIN c ON c.p = r.document_id")
def hierarchy_family(spark, sf):
    return facets.family(results(spark, sf))


def asked_with_intents(spark, sf):
    """The whole queries, each opened by words of another intent."""
    opened = F.element_at(F.array(*[F.lit(x) for x in ("How do I fix the api code error? ", "business requirements strategy goals ", "")]), (F.col("query_id") / 20 % 3).cast("int") + 1)
    return whole_batch(spark, sf).withColumn("text", F.concat(opened, "text"))


@query("search_orchestrated", None)
def orchestrated(spark, sf):
    return _long(search.orchestrated(results(spark, sf), asked_with_intents(spark, sf)))


@query("query_configs", None)
def query_configs(spark, sf):
    return understanding.configs(asked_with_intents(spark, sf)).drop("preferences")
