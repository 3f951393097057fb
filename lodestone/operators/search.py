"""The public tools: each one plan, nothing collected before its result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import conflicts, facets, fusion, query, retrieval, similarity
from lodestone.storage import cut


def search(docs: DataFrame, queries: DataFrame, k: int = 20, mode: str = "wrrf", config: query.SearchConfig | None = None, boosted: bool = True) -> DataFrame:
    """Hybrid search of a batch of (query_id, text): sparse and keyword lists, fused, boosted by metadata, best ``k``.

    ``mode``: wrrf, linear (by the number of hits, see ``fusion.combined``) or keyword.
    """
    c = config or query.SearchConfig()
    expanded = queries.withColumn("text", query.expand(F.col("text"))) if c.expand else queries
    fetch = min(c.max_results, 2 * k) * 3
    words = retrieval.bm25(queries, docs, fetch)
    if mode == "keyword":
        hits = words.select("query_id", "doc_id", "score")
    elif mode == "linear":
        hits = fusion.combined(retrieval.sparse(expanded, docs, fetch), words, c.vector_weight, c.keyword_weight, c.min_score).select("query_id", "doc_id", "score")
    else:
        hits = fusion.wrrf(retrieval.sparse(expanded, docs, fetch), words, c.vector_weight, c.keyword_weight).select("query_id", "doc_id", "score")
    if boosted:
        meta = docs.select("doc_id", fusion.boost(c.source_preferences).alias("factor"))
        hits = hits.join(meta, "doc_id").withColumn("score", F.col("score") * (1 + F.col("factor"))).drop("factor")
    best = retrieval.top_k(hits, k)
    shown = docs.select("doc_id", "document_id", "source_type", fusion.chosen_title().alias("title"))
    return best.join(shown, "doc_id")


def vector_leg(docs: DataFrame, queries: DataFrame, fetch: int, embed: Callable[[Column], Column] | None, index: retrieval.Index | None = None) -> DataFrame:
    """The vector list of a batch of (query_id, text): sparse hits, and with ``embed`` their equal-weight rank fusion with dense hits.

    Where ``docs`` has vectors ``v``, these are met."""
    sparse = retrieval.in_blocks(queries, lambda q: retrieval.sparse(q, docs, fetch, index=index))
    if embed is None:
        return sparse.select("query_id", "doc_id", "score")
    at = lambda df, key: df.select(key, embed(F.coalesce("text", F.lit(""))).alias("v"))
    vectors = docs.select("doc_id", "v") if "v" in docs.columns else cut(at(docs, "doc_id"), "vectors")
    dense = retrieval.dense_blocks(at(queries, "query_id"), vectors, fetch)
    fused = fusion.wrrf(dense, sparse, 1.0, 1.0).select("query_id", "doc_id", F.round("score", 9).alias("score"))
    return retrieval.top_k(fused, fetch).select("query_id", "doc_id", "score")


def orchestrated(
    docs: DataFrame, queries: DataFrame, k: int = 20, embed: Callable[[Column], Column] | None = retrieval.hashing_embedder, where: Column | None = None, rerank: bool = False, fetch: int | None = None
) -> DataFrame:
    """Search of a batch of (query_id, text) in which each query's intent sets its own weights, threshold, sources and diversity.

    Intents and their configurations; expansion of the vector leg; dense and sparse fused as the vector list, BM25 as the
    keyword list; weighted fusion above each query's threshold; boosts by metadata and by the sources an intent prefers;
    re-ranking, if asked for; diversity where an intent wants it; the best ``k``. ``where`` filters documents before any list
    is made; their texts are read once, for vectors, lengths, frequencies and postings alike. Returns (query_id, doc_id, score, rank, intent, mode) and what is shown of a document.
    """
    some = docs if where is None else docs.where(where)
    c = cut(query.configs(queries), "configs")
    asked = cut(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text")), "asked")
    wide = asked.join(c.select("query_id", "expand"), "query_id").select("query_id", F.when(F.col("expand"), query.expand(F.col("text"))).otherwise(F.col("text")).alias("text"))
    # The most results that any configuration asks for; a query takes what its own does.
    n = fetch or min(max(x.max_results for x in (query.SearchConfig(), *query.BY_INTENT.values())) + 5, 2 * k) * 3
    wide = cut(wide, "wide")
    said = retrieval.read(some, embed=embed)
    index = retrieval.indexed(said, asked, wide)
    vector, keyword = vector_leg(said, wide, n, embed, index), retrieval.in_blocks(asked, lambda q: retrieval.bm25(q, said, n, index=index))
    hits = fusion.combined_each(cut(vector, "vector"), cut(keyword, "keyword"), c.select("query_id", "wv", "wk", "least"))
    meta = some.select("doc_id", "source_type", "section_type", "source", fusion.boost().alias("factor"))
    raised = hits.join(meta, "doc_id").join(c.select("query_id", "intent", "confidence", "most", "diversity", "preferences"), "query_id")
    source = F.coalesce((F.try_element_at("preferences", F.col("source_type")) - 1) * 0.2, F.lit(0.0))
    factor = F.least(F.lit(fusion.BOOST_CAP), F.col("factor") + F.col("confidence") * 0.05 + source)
    raised = cut(raised.withColumn("score", F.round(F.col("score") * (1 + factor), 9)).drop("factor"), "raised")
    if rerank:
        texts = raised.join(asked.withColumnRenamed("text", "asked"), "query_id").join(some.select("doc_id", "text"), "doc_id")
        best = fusion.rerank(texts, F.col("asked"), F.col("text"), n).withColumn("score", F.col("rerank_score"))
        raised = cut(best.select(*raised.columns), "reranked")
    plain = retrieval.top_k(raised.where("diversity = 0"), k).select("query_id", "doc_id", "score")
    parts = [plain]
    for x in sorted({round(min(1.0, c.diversity + more), 6) for c in (query.SearchConfig(), *query.BY_INTENT.values()) for more in (0.0, 0.1)} - {0.0}):
        own = raised.where(F.col("diversity") == x).select("query_id", "doc_id", "score", "source_type", "section_type", "source")
        parts.append(fusion.diversify(own, x, k).select("query_id", "doc_id", "score"))
    best = reduce(DataFrame.unionByName, parts).join(raised.select("query_id", "doc_id", "mode", "intent", "most"), ["query_id", "doc_id"])
    best = retrieval.top_k(best, k).where(F.col("rank") <= F.col("most"))
    shown = docs.select("doc_id", "document_id", "source_type", fusion.chosen_title().alias("title"))
    return best.join(shown, "doc_id").select("query_id", "doc_id", "score", "rank", "intent", "mode", "document_id", "source_type", "title")


def hierarchy_search(docs: DataFrame, queries: DataFrame, k: int = 20, **where) -> DataFrame:
    return search(docs.where(facets.hierarchy_filter(**where)), queries, k)


def attachment_search(docs: DataFrame, queries: DataFrame, k: int = 20, **where) -> DataFrame:
    return search(docs.where(facets.attachment_filter(**where)), queries, k)


def analyze_relationships(docs: DataFrame) -> DataFrame:
    return similarity.scored(similarity.sharing_pairs(docs, "entities", "topics"), docs)


def find_similar_documents(docs: DataFrame, targets, k: int = 5, least: float = 0.7) -> DataFrame:
    return similarity.similar_to(docs, targets, least, k)


def detect_document_conflicts(docs: DataFrame) -> DataFrame:
    return conflicts.detect(docs)


def find_complementary_content(docs: DataFrame, k: int = 5) -> DataFrame:
    return conflicts.complementary(docs, k)


def cluster_documents(docs: DataFrame, strategy: str = "mixed", most: int = 10, least: int = 2) -> DataFrame:
    chosen = similarity.clusters(docs, strategy, most, least)
    return similarity.members(docs, strategy, chosen).select("cluster", "doc_id")


def expand_cluster(members: DataFrame, cluster: str, offset: int, limit: int) -> DataFrame:
    return members.where(F.col("cluster") == cluster).orderBy("doc_id").offset(offset).limit(limit)


expand_document = retrieval.expand_document
expand_chunk_context = retrieval.chunk_context


def answer_json(result: DataFrame) -> DataFrame:
    """Each row as one JSON document, for a protocol's response."""
    return result.select(F.to_json(F.struct("*")).alias("json"))


def export_graph(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    """Nodes and edges as JSON lines, one folder each."""
    nodes.write.mode("overwrite").json(f"{out}/nodes")
    edges.write.mode("overwrite").json(f"{out}/edges")


def redact_metadata(md):
    """A map column without private keys, values of secret keys masked."""
    kept = F.map_filter(md, lambda k, _: ~k.startswith("_"))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(k).rlike("password|secret|token|api_key"), F.lit("***")).otherwise(v))
