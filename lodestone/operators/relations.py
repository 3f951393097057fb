"""Similarity of texts, relationships of a target, pairs that a report shows, and what a chain of topics may discover.

Texts are read once a document; pairs carry word sets. Pairs come from shared entities, as in ``similarity``.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.text import jaccard
from lodestone.operators.conflicts import complementary
from lodestone.operators.similarity import _low, similar_to

# Words that do not count in a text's similarity, terms of which two shared ones make texts alike.
STOP_WORDS = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an", "is", "are", "was", "were", "be", "been", "being")
KEY_TERMS = ("authentication", "security", "login", "password", "access", "user", "interface", "design", "app", "mobile")
# Shares of words and entities in the similarity without vectors, least overlap of the smaller text, key terms in common.
TOKEN_SHARE, ENTITY_SHARE, OVERLAP, COMMON_TERMS = 0.7, 0.3, 0.2, 2
# A similar document lies above this; relationships of a kind; pairs that a cluster shows.
SIMILAR, KEPT, SHOWN = 0.5, 5, 50
# Shares of topics, relevance, kinds and length in a chain's potential; kinds of exploration; links of a full chain.
TOPICS, RELEVANCE, TYPES, LENGTH, KINDS, FULL = 0.3, 0.4, 0.2, 0.1, 4, 5


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def read(results: DataFrame) -> DataFrame:
    """(doc_id, f): what the similarity of texts looks at, once a document.

    ``words`` begins with ``plain`` words that are said as they stand; ``said`` has what is said besides these, ``meant`` is the number
    of words that are no stop words."""
    low = F.lower(F.coalesce("text", F.lit("")))
    said = F.filter(F.array_distinct(T.letters(F.coalesce("text", F.lit("")))), lambda w: ~w.isin(*T.KEYWORD_STOP_WORDS))
    terms = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in KEY_TERMS]), lambda t: t.isNotNull())
    r = results.select("doc_id", words(F.col("text")).alias("w"), words(F.col("source_title")).alias("title"), said.alias("s"), terms.alias("terms"), _low("entities").alias("entities"))
    r = r.withColumn("plain", F.array_intersect("w", "s")).withColumn("words", F.concat("plain", F.array_except("w", "plain")))
    meant = F.size(F.filter("w", lambda w: ~w.isin(*STOP_WORDS)))
    return r.select("doc_id", F.struct("words", F.size("plain").alias("plain"), F.array_except("s", "plain").alias("said"), meant.alias("meant"), "title", "terms", "entities").alias("f"))


def text_similarity(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """(a, b, text, lexical, overlap, alike): Jaccard of words without stop words; the similarity without vectors, words and
    entities (1 of two empty texts, 0 of one); whether the smaller text lies in the other for over a fifth; whether titles or key
    terms make them alike."""
    facts = read(results)
    return _compared(pairs.select("a", "b").join(facts.select(F.col("doc_id").alias("a"), F.col("f").alias("x")), "a").join(facts.select(F.col("doc_id").alias("b"), F.col("f").alias("y")), "b"))


def similar_texts(results: DataFrame) -> DataFrame:
    """``text_similarity`` of all pairs that share an entity.

    Documents meet under their entities with their words, so words are shuffled once for each entity of a document, not for
    each of its pairs; a pair counts under the first entity that it shares."""
    each = read(results).select(F.explode("f.entities").alias("item"), "doc_id", "f").where("item IS NOT NULL").repartition("item")
    x, y = each.select("item", F.col("doc_id").alias("a"), F.col("f").alias("x")), each.select("item", F.col("doc_id").alias("b"), F.col("f").alias("y"))
    return _compared(x.join(y, "item").where("a < b").where(F.col("item") == F.array_min(F.array_intersect("x.entities", "y.entities"))))


def _compared(p: DataFrame) -> DataFrame:
    """Pairs (a, b, x, y) of what ``read`` gives."""
    col = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    six = lambda c: F.round(c * (1 + 1e-9), 6)  # noqa: E731  decimal ties, frequent in fractions of powers of 2, go up
    p = p.withColumn("common", F.array_intersect(*col("words")))
    said = lambda z: F.concat(F.slice(F.col(f"{z}.words"), F.lit(1), F.col(f"{z}.plain")), F.col(f"{z}.said"))
    p = p.withColumn("heard", F.size(F.array_intersect(said("x"), said("y"))))
    share = lambda n, a, b: F.when((a > 0) & (b > 0), n / F.greatest(a + b - n, F.lit(1))).otherwise(F.lit(0.0))
    sx, sy = (F.col(f"{z}.plain") + F.size(f"{z}.said") for z in ("x", "y"))
    lexical = F.when((sx == 0) & (sy == 0), 1.0).when((sx == 0) | (sy == 0), 0.0).otherwise(TOKEN_SHARE * share(F.col("heard"), sx, sy) + ENTITY_SHARE * jaccard(*col("entities")))
    least = F.least(*[F.size(w) for w in col("words")])
    overlap = F.when(least > 0, F.size("common") / least > OVERLAP).otherwise(F.lit(False))
    alike = F.arrays_overlap(*col("title")) | (F.size(F.array_intersect(*col("terms"))) >= COMMON_TERMS)
    text = share(F.size(F.filter("common", lambda w: ~w.isin(*STOP_WORDS))), *col("meant"))
    return p.select("a", "b", six(text).alias("text"), six(lexical).alias("lexical"), overlap.alias("overlap"), alike.alias("alike"))


def of_targets(results: DataFrame, targets: Column, k: int = KEPT) -> DataFrame:
    """(a, b, relation, score, rank): for each target row its most similar, complementary and hierarchical relations, ``k`` of each.

    A parent or child scores 1; a target meets only what shares an item with it, or its own address as parent.
    """
    own = results.where(targets).select("doc_id", "document_id", "parent_id")
    similar = similar_to(results, targets, SIMILAR, k + 1).where(F.col("score") > SIMILAR).select("a", "b", F.lit("similar").alias("relation"), "score")
    other = complementary(results, k, targets=own.select("doc_id")).select("a", "b", F.lit("complementary").alias("relation"), "score")
    all_ = results.select(F.col("doc_id").alias("b"), F.col("document_id").alias("their_id"), F.col("parent_id").alias("their_parent"))
    below = own.join(all_, own["document_id"] == all_["their_parent"]).select(F.col("doc_id").alias("a"), "b", F.lit("child").alias("relation"))
    above = own.join(all_, own["parent_id"] == all_["their_id"]).select(F.col("doc_id").alias("a"), "b", F.lit("parent").alias("relation"))
    family = below.unionByName(above).where("a <> b").withColumn("score", F.lit(1.0))
    found = functools.reduce(DataFrame.unionByName, [similar, other, family])
    kind = F.when(F.col("relation").isin("parent", "child"), "hierarchical").otherwise(F.col("relation"))
    rank = F.row_number().over(Window.partitionBy("a", kind).orderBy(F.desc("score"), "b"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def shown_pairs(members: DataFrame, most: int = SHOWN) -> DataFrame:
    """(cluster, a, b, place): the first ``most`` pairs of each cluster of (cluster, doc_id), by ids: a report of bounded size,
    made of as many first members as it takes."""
    need = math.ceil((1 + math.sqrt(1 + 8 * most)) / 2) if most else 0
    first = members.select("cluster", "doc_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id"))).where(F.col("r") <= need)
    a, b = first.select("cluster", F.col("doc_id").alias("a")), first.select("cluster", F.col("doc_id").alias("b"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("a", "b"))
    return a.join(b, "cluster").where("a < b").withColumn("place", place.cast("long")).where(F.col("place") <= most)


def discovery_potential(links: DataFrame) -> DataFrame:
    """(chain, links, potential) of chains of (chain, topic, relevance, exploration)."""
    n = F.count(F.lit(1))
    score = TOPICS * F.countDistinct("topic") / n + RELEVANCE * F.avg("relevance") + TYPES * F.countDistinct("exploration") / KINDS + LENGTH * F.least(F.lit(1.0), n / FULL)
    return links.groupBy("chain").agg(n.alias("links"), F.round(F.least(F.lit(1.0), score), 6).alias("potential"))
