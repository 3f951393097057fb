"""Retrieval: exact dense search, sparse and BM25 search over an inverted index, scans and expansions.

Queries come as a table, so a batch of any number runs as one plan. The lists
that are joined are the postings of the queries' tokens only; a query table is
small and Spark broadcasts it by its size.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import cut

# The sparse encoder's stop words, token shape and constants.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
)
TOKEN = r"[A-Za-z0-9_]{2,}"
SPARSE_K1 = 1.2
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
#: Queries that meet the whole table at once.
QUERY_BLOCK = 512
#: Tasks that count the tokens of one part of the input.
DEALT = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def top_k(hits: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def dense(queries: DataFrame, points: DataFrame, k: int, least: float | None = None, where: Column | None = None, key: str = "doc_id", vector: str = "v") -> DataFrame:
    """Exact cosine search: each point meets each query of a small table once; (query_id, key, score, rank).

    Vectors are scaled to length 1 once, so a pair costs one product.
    """
    unit = lambda v: F.transform(v, lambda x: F.when(F.sqrt(dot(F.col(vector), F.col(vector))) > 0, x / F.sqrt(dot(F.col(vector), F.col(vector)))).otherwise(F.lit(0.0)))
    p = points if where is None else points.where(where)
    p = p.select(key, unit(F.col(vector)).alias("_p"))
    q = queries.select("query_id", unit(F.col(vector)).alias("_q"))
    hits = p.join(q, F.lit(True)).select("query_id", key, dot(F.col("_p"), F.col("_q")).alias("score"))
    if least is not None:
        hits = hits.where(F.col("score") >= least)
    return top_k(hits, k, tie=key)


def dense_blocks(queries: DataFrame, points: DataFrame, k: int, least: float | None = None, where: Column | None = None, block: int = QUERY_BLOCK, cut=cut) -> DataFrame:
    """Exact cosine search for a query table of any size: (query_id, doc_id, score, rank), scores to six decimals.

    Queries meet all points in blocks: one block's vectors go out as a matrix, each batch of points keeps its ``k`` best
    hits of each query, and the best of these are ranked. A block costs one pass over the points.
    """
    spark = points.sparkSession
    p = (points if where is None else points.where(where)).select("doc_id", "v")
    parts = []
    for some in query_blocks(queries.select("query_id", "v"), block, cut):
        rows = some.collect()  # at most a few more than ``block``
        if not rows:
            continue
        ids, matrix = np.array([r.query_id for r in rows], np.int64), _unit([r.v for r in rows])
        near = p.mapInArrow(_nearest(spark.sparkContext.broadcast((ids, matrix)), k, least), "query_id long, doc_id long, score double")
        parts.append(cut(top_k(near, k)))
    if not parts:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return reduce(DataFrame.unionByName, parts)


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _nearest(block, k: int, least: float | None):
    def of(batches):
        import pyarrow as pa

        ids, matrix = block.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                doc = part.column(0).to_numpy(zero_copy_only=False)
                exact = matrix @ _unit(part.column(1).to_pylist()).T
                score = np.round(exact, 6) + 0.0
                order = np.lexsort((np.broadcast_to(doc, score.shape), -score))[:, :k]
                best = np.take_along_axis(score, order, 1)
                kept = np.ones(best.shape, bool) if least is None else np.take_along_axis(exact, order, 1) >= least
                query = np.broadcast_to(ids[:, None], best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(query[kept]), pa.array(doc[order][kept], pa.int64()), pa.array(best[kept])], ["query_id", "doc_id", "score"])

    return of


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK, cut=cut) -> list[DataFrame]:
    """The queries dealt by a hash of their id into blocks of about ``block``."""
    blocks = max(1, math.ceil(queries.count() / block))
    if blocks == 1:
        return [queries]
    dealt = cut(queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    return [dealt.where(F.col("_b") == b).drop("_b") for b in range(blocks)]


def in_blocks(queries: DataFrame, run, block: int = QUERY_BLOCK, cut=cut) -> DataFrame:
    """``run`` on each block of the queries, each result written; any number of queries meets the whole table."""
    some = query_blocks(queries, block, cut)
    return run(some[0]) if len(some) == 1 else reduce(DataFrame.unionByName, [cut(run(q)) for q in some])


def every_token(text: str | Column) -> Column:
    """A text's tokens in order, repeats and stop words included, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(text: str | Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """A text's tokens in order, repeats included, as an array."""
    return _without(every_token(text), stop)


def _without(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def tokens(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, token, tf)."""
    return df.select(key, F.explode(terms(text, stop)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def tokens_by(df: DataFrame, key: str, text: str) -> DataFrame:
    """``tokens``, dealt by the key alone: texts are shuffled once, tokens not at all, and groups by the key need no further shuffle.

    A part of the input is dealt to ``DEALT`` tasks, as a task holds the tokens of all its texts at once."""
    some = df.select(key, text)
    return tokens(some.repartition(DEALT * max(1, some.rdd.getNumPartitions()), key), key, text)


def read(docs: DataFrame, key: str = "doc_id", text: str = "text", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, _terms, and with ``embed`` v): every text's tokens, with blanks between them, and its vector, written once for all that ask for them."""
    each = docs.select(key, text, every_token(text).alias("_each"))
    of_tokens = getattr(embed, "of_tokens", None)
    v = [] if embed is None else [(of_tokens(F.col("_each")) if of_tokens else embed(F.coalesce(text, F.lit("")))).alias("v")]
    return cut(each.select(key, F.array_join(_without(F.col("_each")), " ").alias("_terms"), *v), "read")


def _said(docs: DataFrame, text: str) -> Column:
    """The tokens of a row's text, as ``read`` wrote them or from the text."""
    return F.when(F.col("_terms") != "", F.split("_terms", " ")).otherwise(F.array().cast("array<string>")) if "_terms" in docs.columns else terms(text)


@dataclasses.dataclass
class Index:
    """What the sparse and the keyword list of some queries need of all documents."""

    #: (key, token, tf) of the queries' tokens
    posted: DataFrame
    #: (key, len) of the documents with tokens
    lengths: DataFrame
    #: (token, df) of all tokens
    df: DataFrame


def indexed(docs: DataFrame, *queries: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Of texts or of what ``read`` made of them; ``queries`` are tables of (query_id, text)."""
    asked = [q.select(F.explode(terms("text")).alias("token")) for q in queries]
    wanted = cut(reduce(DataFrame.unionByName, asked).distinct(), "wanted")
    return Index(cut(postings(docs, key, text, wanted), "posted"), cut(_lengths(docs, key, text), "lengths"), cut(document_frequency(docs, key, text), "df"))


def _lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(_said(docs, text)).alias("len")).groupBy(key).agg(F.sum("len").alias("len")).where("len > 0")


def postings(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(key, token, tf) of the tokens in ``wanted`` only, other columns of which are carried along.

    ``wanted`` has a row a token and is a written table, so Spark knows its size and, where that is
    small, no token that nobody asks for is shuffled.
    """
    each = docs.select(key, F.explode(_said(docs, text)).alias("token")).join(wanted, "token")
    return each.groupBy(key, *wanted.columns).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, df): the ids that hold a token. A row counts its tokens once where it stands; only rows whose id
    repeats are told apart by id and token."""
    again = cut(docs.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_again"))
    same = F.col(key).eqNullSafe(F.col("_again"))
    once = docs.join(again, same, "left_anti").select(F.explode(F.array_distinct(_said(docs, text))).alias("token"))
    more = docs.join(again, same, "left_semi").select(key, F.explode(_said(docs, text)).alias("token")).distinct().select("token")
    parts = [x.groupBy("token").agg(F.count(F.lit(1)).alias("df")) for x in (once, more)]
    return parts[0].unionByName(parts[1]).groupBy("token").agg(F.sum("df").alias("df"))


def encode_documents(df: DataFrame, key: str, text: str, k1: float = SPARSE_K1) -> DataFrame:
    """Sparse weights tf * (k1 + 1) / (tf + k1)."""
    return tokens_by(df, key, text).withColumn("w", sparse_weight(k1))


def sparse_weight(k1: float = SPARSE_K1) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1)


def encode_queries(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse weights 1 + ln(tf)."""
    return tokens(df, key, text).withColumn("w", 1 + F.log(F.col("tf").cast("double")))


def sparse(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """Products of sparse weights; ``index``: of ``docs`` and these queries at least, where at hand."""
    q = cut(encode_queries(queries, "query_id", text).select("query_id", "token", F.col("w").alias("wq")))
    d = (postings(docs, key, text, cut(q.select("token").distinct())) if index is None else index.posted).withColumn("w", sparse_weight())
    hits = d.join(q, "token").groupBy("query_id", key).agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))
    return top_k(hits, k, tie=key)


def bm25(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """Okapi BM25 over the whole table; a negative idf is replaced by epsilon times the mean idf. Positive scores only.

    ``index``: of ``docs`` and these queries at least, where at hand."""
    lengths = _lengths(docs, key, text) if index is None else index.lengths
    facts = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    q = cut(tokens(queries, "query_id", text).select("query_id", "token", F.col("tf").alias("qtf")))
    df = (cut(document_frequency(docs, key, text)) if index is None else index.df).join(F.broadcast(facts), F.lit(True))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.join(q.select("token").distinct(), "token", "left_semi").join(F.broadcast(mean), F.lit(True))
    idf = cut(idf.select("token", "avgdl", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")))
    posted = (postings(docs, key, text, idf) if index is None else index.posted.join(idf, "token")).join(lengths, key)
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avgdl")))
    hits = posted.withColumn("part", part).join(q, "token").groupBy("query_id", key).agg(F.round(F.sum(F.col("part") * F.col("qtf")), 6).alias("score"))
    return top_k(hits.where("score > 0"), k, tie=key)


def filter_only(points: DataFrame, where: Column, k: int, key: str = "doc_id") -> DataFrame:
    return points.where(where).orderBy(key).limit(k).withColumn("score", F.lit(1.0))


def expand_document(chunks: DataFrame, document: str, most: int | None = 500) -> DataFrame:
    out = chunks.where(F.col("document_id") == document).orderBy("chunk_index")
    return out if most is None else out.limit(most)


def chunk_context(chunks: DataFrame, group: str, index: str, text: str, window: int = 2) -> DataFrame:
    """Every chunk with the texts around it: one window frame instead of a lookup per chunk."""
    by = Window.partitionBy(group).orderBy(index).rangeBetween(-window, window)
    return chunks.withColumn("context", F.collect_list(text).over(by)).withColumn("context_size", F.size("context").cast("long"))


def embedding_batches(texts: DataFrame, key: str, text: str, budget: int, cap: int, bucket: Column) -> DataFrame:
    """Batch numbers by running token sums inside each bucket; blank texts drop out, long ones count as ``cap``."""
    n = F.least(F.lit(cap), F.ceil(F.length(text) / 4)).cast("long")
    t = texts.where(F.trim(text) != "").select(key, n.alias("tokens"), bucket.alias("bucket"))
    before = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("batch", F.floor(F.coalesce(F.sum("tokens").over(before), F.lit(0)) / budget).cast("long"))


def hashed(words: Column, size: int = 64) -> Column:
    """Signed hashes of a text's tokens summed into ``size`` places; zeros of null.

    Tokens are hashed once where they stand; Arrow batches of their places and signs are summed.
    """

    @F.pandas_udf("array<double>")
    def summed(codes: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(c >> 1, weights=1.0 - 2.0 * (c & 1), minlength=size) for c in (np.asarray(x if x is not None else (), np.int64) for x in codes)], dtype=object)

    return summed(F.transform(words, lambda w: (2 * F.pmod(F.xxhash64(w), F.lit(size)) + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("long")))


def hashing_embedder(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding service: ``hashed`` tokens of a text."""
    return hashed(every_token(text), size)


#: The same of a text whose tokens are at hand.
hashing_embedder.of_tokens = hashed
