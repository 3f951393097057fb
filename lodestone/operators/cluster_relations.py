"""Quality of clusters and relationships between them, from profiles: no pairs of their members.

A profile is what a cluster's members have in all, as items with counts: shared entities and topics (its key's), source types,
breadcrumbs and their parts, whether there is code, mean size. Two clusters can only be related where they have an item in common:
an entity, a topic, a source type, a breadcrumb that is part of the other's, equal presence of code, or a class of
mean size at most one doubling apart. So pairs of clusters come from an inverted file of the items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard
from lodestone.operators.similarity import cluster_key, clusters
from lodestone.storage import cut

#: Least strength of a relationship, most relationships, what a single common source adds, what content counts,
#: members whose words are compared, and how many characters of their texts.
LEAST, MOST, SINGLE_SOURCE, BOTH_CODE, NO_CODE, SIZE_PART, COMPARED, LEADING = 0.1, 10, 0.3, 0.4, 0.2, 0.3, 5, 200
KINDS = ("entity_overlap", "topic_overlap", "source_similarity", "hierarchical", "content_similarity")


def key_items(strategy: str) -> tuple[Column, Column]:
    """(entities, topics) that a cluster's key names."""
    none = F.array().cast("array<string>")
    if strategy in ("projects", "hierarchy"):
        return none, none
    if strategy in ("entities", "topics"):
        own = F.split("cluster", r"\|")
        return (own, none) if strategy == "entities" else (none, own)
    part = lambda name: F.coalesce(F.split(F.nullif(F.regexp_extract("cluster", rf"(?:^|\|){name}:([^|]*)", 1), F.lit("")), ","), none)
    return part("entities"), part("topics")


def members(results: DataFrame, strategy: str, most: int) -> DataFrame:
    """The rows of the ``most`` largest clusters, with ``cluster``."""
    chosen = clusters(results, strategy, most).select("cluster")
    return results.withColumn("cluster", cluster_key(results, strategy)).join(chosen, "cluster")


def profiles(rows: DataFrame, strategy: str) -> DataFrame:
    """(cluster, n, entities, topics, sources, code, size, placed): a row a cluster."""
    entities, topics = key_items(strategy)
    each = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source_type")).alias("sources"), F.coalesce(F.max("has_code_blocks"), F.lit(False)).alias("code"),
        (F.sum(F.coalesce("word_count", F.lit(0))) / F.count(F.lit(1))).alias("size"),
    )
    return each.select("cluster", "n", entities.alias("entities"), topics.alias("topics"), "sources", "code", "size")


def contained(rows: DataFrame) -> DataFrame:
    """(a, b, n): for two clusters, a before b, the pairs of members of which one's breadcrumb is a run of the other's levels.

    Breadcrumbs are counted as wholes and by all their runs of levels; sums over equal strings give the pairs.
    """
    levels = rows.where("breadcrumb_text IS NOT NULL AND breadcrumb_text <> ''").groupBy("cluster", "breadcrumb_text").agg(F.count(F.lit(1)).alias("m")).withColumn("l", F.split("breadcrumb_text", " > "))
    run = F.flatten(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.transform(F.sequence(F.lit(1), F.size("l") - i + 1), lambda k: F.array_join(F.slice("l", i, k), " > "))))
    whole = cut(levels.groupBy("cluster", F.col("breadcrumb_text").alias("path")).agg(F.sum("m").alias("m")), "whole")
    parts = cut(levels.select("cluster", "m", F.explode(F.array_distinct(run)).alias("path")).groupBy("cluster", "path").agg(F.sum("m").alias("m")), "parts")
    side = lambda df, c, m: df.select("path", F.col("cluster").alias(c), F.col("m").alias(m))

    def meet(x: DataFrame, y: DataFrame, sign: int) -> DataFrame:
        p = side(x, "x", "mx").join(side(y, "y", "my"), "path").where("x <> y")
        return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (sign * F.col("mx") * F.col("my")).alias("n"))

    # Whole in part counts either way once; equal wholes would count twice, and each of their pairs is met from both sides.
    all_ = meet(whole, parts, 2).unionByName(meet(whole, whole, -1))
    return all_.groupBy("a", "b").agg((F.sum("n") / 2).cast("long").alias("n")).where("n > 0")


def relationships(results: DataFrame, strategy: str, most_clusters: int = 10, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(a, b, kind, strength, shared): the strongest relationship of two clusters, above ``least``, the ``most`` strongest; a < b."""
    rows = cut(members(results, strategy, most_clusters).select("cluster", "source_type", "has_code_blocks", "word_count", "breadcrumb_text"), "members")
    p = cut(profiles(rows, strategy), "profiles")
    doubling = F.floor(F.log2("size"))
    tag = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(f"{name}:"), x))
    size = F.when(F.col("size") > 0, F.array(F.concat(F.lit("z:"), doubling.cast("string")), F.concat(F.lit("z:"), (doubling + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    items = F.concat(tag("e", "entities"), tag("t", "topics"), tag("s", "sources"), F.array(F.concat(F.lit("c:"), F.col("code").cast("string"))), size)
    i = p.select(F.explode(F.array_distinct(items)).alias("item"), "cluster")
    paths = cut(contained(rows), "contained")
    pairs = i.select("item", F.col("cluster").alias("a")).join(i.select("item", F.col("cluster").alias("b")), "item").where("a < b").select("a", "b").unionByName(paths.select("a", "b")).distinct()
    f = F.struct("n", "entities", "topics", "sources", "code", "size")
    both = pairs.join(p.select(F.col("cluster").alias("a"), f.alias("x")), "a").join(p.select(F.col("cluster").alias("b"), f.alias("y")), "b").join(paths.withColumnRenamed("n", "placed"), ["a", "b"], "left")
    col = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    in_both = lambda c: F.array_sort(F.array_intersect(*col(c)))
    nothing = F.array().cast("array<string>")
    one = (F.size("x.sources") == 1) & (F.size("y.sources") == 1) & (F.size(in_both("sources")) == 1)
    source = jaccard(*col("sources"))
    share = F.coalesce("placed", F.lit(0)) / (F.col("x.n") * F.col("y.n"))
    code = F.when(F.col("x.code") & F.col("y.code"), F.lit(BOTH_CODE)).when(~F.col("x.code") & ~F.col("y.code"), F.lit(NO_CODE)).otherwise(F.lit(0.0))
    ratio = F.least(*col("size")) / F.greatest(*col("size"), F.lit(1e-300))
    content = code + F.when((F.least(*col("size")) > 0) & (ratio > 0.5), SIZE_PART * ratio).otherwise(F.lit(0.0))
    strengths = [jaccard(*col("entities")), jaccard(*col("topics")), F.when(one, F.least(F.lit(1.0), source + SINGLE_SOURCE)).otherwise(source), share, content]
    shared = [in_both("entities"), in_both("topics"), in_both("sources"), nothing, nothing]
    listed = F.array(*[F.struct(F.round(s, 6).alias("strength"), F.lit(-k).alias("k"), F.lit(kind).alias("kind"), h.alias("shared")) for k, (kind, s, h) in enumerate(zip(KINDS, strengths, shared, strict=True))])
    best = both.select("a", "b", F.array_max(listed).alias("r")).select("a", "b", "r.kind", "r.strength", "r.shared").where(F.col("strength") > least)
    return best.orderBy(F.desc("strength"), "a", "b").limit(most)


def quality(results: DataFrame, strategy: str, coherence: DataFrame, most_clusters: int = 10) -> DataFrame:
    """(cluster, n, coherence, entity_diversity, topic_diversity, size_class, similarity) of the largest clusters.

    ``coherence`` is (cluster, coherence). ``similarity`` is the mean Jaccard of the words of titles and of the texts' first
    LEADING characters over the first COMPARED members by id; null where a cluster has a single one.
    """
    rows = members(results, strategy, most_clusters)
    entities, topics = key_items(strategy)
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "source_title", F.substring(F.coalesce("text", F.lit("")), 1, LEADING))), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    few = rows.withColumn("r", first).where(F.col("r") <= COMPARED).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", words.alias("w")))).alias("m"))
    at = lambda k: F.get("m", F.lit(k))["w"]
    pair = lambda i, j: F.when(F.size("m") > j, jaccard(at(i), at(j)))
    each = [pair(i, j) for i in range(COMPARED) for j in range(i + 1, COMPARED)]
    total, n = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in each]), reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in each])
    like = few.select("cluster", F.when(n > 0, F.round(total / n, 6)).alias("similarity"))
    size = F.when(F.col("n") <= 2, "small").when(F.col("n") <= 5, "medium").when(F.col("n") <= 10, "large").otherwise("very_large")
    p = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    facts = p.select("cluster", "n", F.size(entities).alias("entity_diversity"), F.size(topics).alias("topic_diversity"), size.alias("size_class"))
    return facts.join(coherence.select("cluster", "coherence"), "cluster", "left").join(like, "cluster", "left")
