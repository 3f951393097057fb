"""A stored index for keyword search: posting lists in blocks with their largest values, facts, and replacement in segments.

The index is a folder of tables. ``postings`` has a row for each (token, block) of a segment: ids, frequencies and lengths of the
documents of that block that hold the token, and the largest frequency and least length among them. Tables are
partitioned by segment and a hash of the token, so a search lists the folders of its own tokens and reads no other, and
documents are not read at all. ``frequencies`` has what a segment adds to each token's document frequency, ``forward`` each
document's terms, ``stale`` the versions that later segments replaced, ``facts`` a row a segment with what a score needs of the
whole table: documents, mean length, mean of all idf values.

A search is exact. From the largest values of the asked tokens alone, each block gets a bound on any score in it; the blocks with the
highest bounds are scored first, and then only those whose bound reaches the k-th score found. Documents are dealt
to blocks by their length class, as short documents reach higher scores.

``add`` writes a new segment with new or changed documents; earlier versions become stale and are counted out of the frequencies.
``compact`` writes all live documents as one segment of a new index.

Defined results: documents without tokens are counted nowhere and never found, null texts among them; repeated ids are one document with
all their tokens; a document that is added without tokens is removed; equal scores go to the smaller id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import BM25_B, BM25_EPSILON, BM25_K1, terms, tokens, tokens_by, top_k
from lodestone.storage import cut

#: Folders of tokens, documents of a block on average, blocks that a query scores first for each result wanted.
BUCKETS, BLOCK, FIRST = 64, 128, 0.25

TABLES = {
    "postings": "token string, block string, docs array<long>, tfs array<long>, lens array<long>, most long, least long, segment int, bucket int",
    "frequencies": "token string, n long, segment int, bucket int",
    "forward": "doc long, len long, terms array<struct<token: string, tf: long>>, segment int",
    "stale": "doc long, segment int, since int",
    "facts": "segment int, n long, avgdl double, mean double",
}


def bucket(token: str = "token"):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{path.rstrip('/')}/{table}")


def _write(df: DataFrame, path: str, table: str, *by: str) -> None:
    # A folder gets one file from the one task that its rows are dealt to, in the tokens' order.
    if by:
        spread = df.repartition(*by).sortWithinPartitions(*by, "token") if "token" in df.columns else df.repartition(*by)
        spread.write.mode("append").partitionBy(*by).parquet(f"{path.rstrip('/')}/{table}")
    else:
        df.write.mode("append").parquet(f"{path.rstrip('/')}/{table}")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """A new index of ``docs`` at ``path``."""
    _segment(docs, path, 0, key, text)


def add(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> int:
    """``docs`` as a further segment of the index: they replace earlier documents of their ids. Returns the segment."""
    spark = docs.sparkSession
    number = read(spark, path, "facts").agg(F.max("segment")).first()[0] + 1
    _segment(docs, path, number, key, text)
    return number


def _segment(docs: DataFrame, path: str, number: int, key: str, text: str) -> None:
    spark = docs.sparkSession
    ids = docs.select(F.col(key).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
    each = tokens_by(docs.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("long")), key, text).withColumnRenamed(key, "doc")
    forward = each.groupBy("doc").agg(F.sum("tf").alias("len"), F.collect_list(F.struct("token", "tf")).alias("terms")).withColumn("segment", F.lit(number))
    _write(forward, path, "forward")
    own = read(spark, path, "forward").where(F.col("segment") == number)
    change = own.select(F.explode("terms.token").alias("token"), F.lit(1).alias("n"))
    if number:
        live = live_forward(spark, path).where(F.col("segment") < number)
        old = cut(live.join(ids, "doc", "left_semi").select("doc", "segment", "terms"), "replaced")
        _write(old.select("doc", "segment", F.lit(number).alias("since")), path, "stale")
        change = change.unionByName(old.select(F.explode("terms.token").alias("token"), F.lit(-1).alias("n")))
    else:
        _write(ids.limit(0).select("doc", F.lit(0).alias("segment"), F.lit(0).alias("since")), path, "stale")
    counts = change.groupBy("token").agg(F.sum("n").alias("n")).where("n <> 0")
    _write(counts.withColumn("segment", F.lit(number)).withColumn("bucket", bucket()), path, "frequencies", "segment", "bucket")
    documents = own.count()
    size = max(1, math.ceil(documents / BLOCK))
    # A block: documents of one class of length, by a hash of the id within it.
    block = F.concat_ws(":", F.floor(F.log2("len")).cast("string"), F.pmod(F.xxhash64("doc"), F.lit(max(1, size // 4))).cast("string"))
    # Documents are dealt by their block, so that a block's lists are made where they stand; only whole lists are shuffled.
    dealt = own.select("doc", "len", block.alias("block"), "terms").repartition("block")
    posted = dealt.select("doc", "len", "block", F.explode("terms").alias("t")).select("t.token", "block", F.struct("doc", "t.tf", "len").alias("p"))
    lists = posted.groupBy("token", "block").agg(F.sort_array(F.collect_list("p")).alias("p"), F.max("p.tf").alias("most"), F.min("p.len").alias("least"))
    lists = lists.select("token", "block", F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), "most", "least")
    _write(lists.withColumn("segment", F.lit(number)).withColumn("bucket", bucket()), path, "postings", "segment", "bucket")
    whole = live_forward(spark, path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl")).first()
    by_df = frequencies(read(spark, path, "frequencies")).groupBy("df").agg(F.count(F.lit(1)).alias("m"))
    raw = F.log(F.lit(whole.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    facts = by_df.agg(F.coalesce(F.sum(raw * F.col("m")) / F.sum("m"), F.lit(0.0)).alias("mean")).select(F.lit(number).alias("segment"), F.lit(whole.n).cast("long").alias("n"), F.lit(whole.avgdl).cast("double").alias("avgdl"), "mean")
    _write(cut(facts, "facts"), path, "facts")


def frequencies(changes: DataFrame) -> DataFrame:
    """(token, df): documents that hold a token, from what segments add and take."""
    return changes.groupBy("token").agg(F.sum("n").alias("df")).where("df > 0")


def live_forward(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, "forward").join(read(spark, path, "stale").select("doc", "segment").distinct(), ["doc", "segment"], "left_anti")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The live documents of an index as one segment of a new one."""
    whole = live_forward(spark, path).select("doc", F.array_join(F.flatten(F.transform("terms", lambda t: F.array_repeat(t["token"], t["tf"].cast("int")))), " ").alias("text"))
    build(whole, to, "doc", "text")


def bm25(spark: SparkSession, path: str, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the same as ``retrieval.bm25`` over the live documents, from the index alone."""
    q = cut(tokens(queries, "query_id", text).select("query_id", "token", F.col("tf").alias("qtf"), bucket().alias("bucket")), "asked")
    folders = sorted(r.bucket for r in q.select("bucket").distinct().collect())  # at most BUCKETS
    if not folders:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    facts = read(spark, path, "facts").orderBy(F.desc("segment")).first()
    here = F.col("bucket").isin(folders)
    asked = q.select("token").distinct()
    known = read(spark, path, "frequencies").where(here).join(asked, "token", "left_semi")
    raw = F.log(F.lit(facts.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = frequencies(known).select("token", F.when(raw < 0, BM25_EPSILON * facts.mean).otherwise(raw).alias("idf"))
    weights = cut(q.drop("bucket").join(idf, "token").select("query_id", "token", (F.col("idf") * F.col("qtf")).alias("w")), "weights")
    lists = read(spark, path, "postings").where(here)
    part = lambda tf, n: tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * n / facts.avgdl))
    # A token of negative weight adds nothing to a bound.
    bound = F.greatest(F.lit(0.0), F.col("w")) * part(F.col("most"), F.col("least"))
    heads = lists.select("token", "segment", "block", "most", "least").join(weights, "token").groupBy("query_id", "segment", "block").agg(F.sum(bound).alias("bound"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
    heads = cut(heads.withColumn("place", order), "bounds")
    stale = read(spark, path, "stale").select(F.col("doc").alias("doc_id"), "segment").distinct()

    def scored(blocks: DataFrame) -> DataFrame:
        met = lists.join(weights, "token").join(blocks.select("query_id", "segment", "block"), ["query_id", "segment", "block"])
        each = met.select("query_id", "segment", "w", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
        each = each.select("query_id", "segment", F.col("p.docs").alias("doc_id"), (F.col("w") * part(F.col("p.tfs"), F.col("p.lens"))).alias("part"))
        sums = each.groupBy("query_id", "segment", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
        return sums.join(stale, ["doc_id", "segment"], "left_anti").select("query_id", "doc_id", "score")

    first = max(1, math.ceil(FIRST * k))
    best = cut(top_k(scored(heads.where(F.col("place") <= first)), k).drop("rank"), "best")
    kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("m")).where(F.col("m") == k)
    # Bounds and scores are sums in different orders: leave room for rounding.
    left = heads.where(F.col("place") > first).join(kth, "query_id", "left").where(F.col("bound") * (1 + 1e-9) + 1e-5 >= F.coalesce("kth", F.lit(0.0)))
    return top_k(best.unionByName(scored(left)), k)
