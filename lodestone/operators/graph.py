"""Citation network, knowledge graph and topic relations as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard
from lodestone.operators.similarity import _low
from lodestone.storage import cut

CITES, CONTAINS, SIBLING = 1.0, 2.0, 0.5
DAMPING, ROUNDS = 0.85, 20
#: The reference's most rounds. Rank ends at a change of 1e-6 in all (the reference: 1e-6 a node), hubs at the reference's 1e-8.
MOST_ROUNDS, RANK_TOLERANCE, HUB_TOLERANCE = 100, 1e-6, 1e-8


def citation_edges(results: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst, kind, weight). ``references`` is (doc_id, url, title): an exact URL counts before an exact title, the
    smallest id wins. Children hang on their parents; siblings share one."""
    urls = results.groupBy(F.col("source_url").alias("url")).agg(F.min("doc_id").alias("by_url"))
    names = results.groupBy(F.col("source_title").alias("title")).agg(F.min("doc_id").alias("by_title"))
    cited = references.join(urls, "url", "left").join(names, "title", "left").select(F.col("doc_id").alias("src"), F.coalesce("by_url", "by_title").alias("dst"))
    cited = cited.where("dst IS NOT NULL AND dst <> src").distinct().withColumn("kind", F.lit("cross_reference")).withColumn("weight", F.lit(CITES))
    ids = results.select(F.col("document_id").alias("parent_id"), F.col("doc_id").alias("src"))
    child = results.where(F.col("parent_id").isNotNull()).select("parent_id", F.col("doc_id").alias("dst")).join(ids, "parent_id").select("src", "dst", F.lit("hierarchical_child").alias("kind"), F.lit(CONTAINS).alias("weight"))
    return cited.unionByName(child)


def sibling_edges(results: DataFrame) -> DataFrame:
    """Each child with the next of its parent in id order: a chain says who the siblings are without all their pairs."""
    w = Window.partitionBy("parent_id").orderBy("doc_id")
    s = results.where(F.col("parent_id").isNotNull()).select(F.col("doc_id").alias("src"), F.lead("doc_id").over(w).alias("dst"))
    return s.where("dst IS NOT NULL").withColumn("kind", F.lit("sibling")).withColumn("weight", F.lit(SIBLING))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("cited"), F.sum("o").alias("citing"), (F.sum("i") + F.sum("o")).alias("degree"))


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, cut=cut, tolerance: float | None = None) -> DataFrame:
    """(node, rank) by power iteration with the weight of nodes without edges spread over all; lineage is cut by ``cut``.

    With ``tolerance`` it ends before ``rounds`` where a round moves less rank than that in all.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    rank = nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    for k in range(rounds):
        loose = rank.join(out.select(F.col("src").alias("node")), "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        got = share.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank")
        if tolerance is None:
            rank = cut(nodes.select("node").join(got, "node", "left").join(F.broadcast(loose), F.lit(True)).select("node", new))
            continue
        step = cut(rank.withColumnRenamed("rank", "before").join(got, "node", "left").join(F.broadcast(loose), F.lit(True)).select("node", "before", new))
        rank = step.select("node", "rank")
        if (step.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    return rank


def hits(edges: DataFrame, rounds: int = 20, cut=cut, tolerance: float | None = None) -> DataFrame:
    """(node, hub, authority), each scaled to sum 1.

    With ``tolerance`` it ends before ``rounds`` where a round moves less hub weight than that in all. Weights are
    shuffled to the edges: as broadcasts they would pass through the driver in each of many rounds.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    h = nodes.withColumn("hub", F.lit(1.0))
    # A round's sums are written before their total is taken, so that they are made once.
    scaled = lambda df, c: df.join(F.broadcast(df.agg(F.sum(c).alias("_t"))), F.lit(True)).withColumn(c, F.col(c) / F.col("_t")).drop("_t")
    a = None
    for k in range(rounds):
        before = h
        a = scaled(cut(edges.join(h.select(F.col("node").alias("src"), "hub").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("hub") * F.col("weight")).alias("authority"))), "authority")
        h = scaled(cut(edges.join(a.select(F.col("node").alias("dst"), "authority").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("authority") * F.col("weight")).alias("hub"))), "hub")
        if tolerance is not None:
            moved = h.withColumnRenamed("hub", "now").join(before, "node", "full").agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("hub", F.lit(0.0)))))
            if (moved.first()[0] or 0.0) < tolerance:
                break
    return nodes.join(h, "node", "left").join(a, "node", "left").select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def node_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(value.cast("binary"), 256), 1, 16))


def graph_nodes(results: DataFrame) -> DataFrame:
    """(node, kind, name): documents by address, entities and topics that occur twice or more."""
    docs = results.select(node_id("doc", F.concat_ws(":", "source_type", "source_url")).alias("node"), F.lit("document").alias("kind"), F.col("source_title").alias("name"))

    def terms(column: str, kind: str) -> DataFrame:
        t = results.select(F.explode(_low(column)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
        return t.select(node_id(kind, F.col("name")).alias("node"), F.lit(kind).alias("kind"), "name")

    return docs.dropDuplicates(["node"]).unionByName(terms("entities", "entity")).unionByName(terms("topics", "topic"))


def graph_edges(results: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): mentions, discussions, and entities that occur together; only between nodes that are there."""
    doc = node_id("doc", F.concat_ws(":", "source_type", "source_url"))

    def to(column: str, kind: str, relation: str, weight: float) -> DataFrame:
        t = results.select(doc.alias("src"), F.explode(_low(column)).alias("name"))
        often = t.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("name")
        return t.join(often, "name", "left_semi").select("src", node_id(kind, F.col("name")).alias("dst"), F.lit(relation).alias("kind"), F.lit(weight).alias("weight"))

    together = cooccurrence(results, "entities").where("n >= 2")
    both = together.select(node_id("entity", F.col("x")).alias("src"), node_id("entity", F.col("y")).alias("dst"), F.lit("co_occurs").alias("kind"), F.least(F.lit(1.0), F.col("n") / 5).alias("weight"))
    return to("entities", "entity", "mentions", 0.7).unionByName(to("topics", "topic", "discusses", 0.6)).unionByName(both)


def cooccurrence(results: DataFrame, column: str) -> DataFrame:
    """(x, y, n): pairs of a row's own terms, x < y. A row has few terms, so no pair leaves its row before it is counted."""
    t = F.array_sort(_low(column))
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return results.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))


def related_topics(results: DataFrame, column: str = "topics") -> DataFrame:
    """(x, y, n, score): mutual information of topics that occur together twice or more, brought to 0..1."""
    f = results.select(F.explode(_low(column)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    total = F.broadcast(f.agg(F.sum("f").alias("total")))
    c = cooccurrence(results, column).where("n >= 2")
    c = c.join(f.select(F.col("t").alias("x"), F.col("f").alias("fx")), "x").join(f.select(F.col("t").alias("y"), F.col("f").alias("fy")), "y").join(total, F.lit(True))
    pmi = F.log2(F.col("n") * F.col("total") / (F.col("fx") * F.col("fy") + 1))
    return c.select("x", "y", "n", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (pmi + 5) / 10)), 6).alias("score"))


def topic_chain(related: DataFrame, start: str, length: int, decay: float = 0.9) -> DataFrame:
    """Depth first from a topic: each step takes the best related topic not seen yet. One small lookup a step."""
    both = related.unionByName(related.select(F.col("y").alias("x"), F.col("x").alias("y"), "n", "score"))
    seen, rows, at = [start], [(0, start, 1.0)], start
    for k in range(1, length):
        best = both.where((F.col("x") == at) & ~F.col("y").isin(*seen)).orderBy(F.desc("score"), "y").limit(1).collect()
        if not best:
            break
        at = best[0].y
        seen.append(at)
        rows.append((k, at, float(best[0].score) * decay**k))
    return related.sparkSession.createDataFrame(rows, "position long, topic string, relevance double")


def neighbours(edges: DataFrame, starts: DataFrame, hops: int, kinds: tuple[str, ...] = (), least: float = 0.0, cut=cut) -> DataFrame:
    """(node, hop): breadth first over edges in either direction; each node at its first hop."""
    e = edges.where(F.col("weight") >= least)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    e = e.select("src", "dst").union(e.select("dst", "src"))
    seen = starts.select(F.col("node"), F.lit(0).cast("long").alias("hop"))
    edge = seen
    for k in range(1, hops + 1):
        step = e.join(edge.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        edge = cut(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(k).cast("long")))
        seen = seen.unionByName(edge)
    return seen


def weak_components(edges: DataFrame, cut=cut, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each reaches."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        hooked = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = cut(hooked.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("further", "c")).alias("component")))
        moved = new.where("old <> component").limit(1).count()
        label = new.select("node", "component")
        if not moved:
            return label
    raise RuntimeError("components did not settle")


def node_similarity(a: str, b: str) -> Column:
    """0.4 entities + 0.3 topics + 0.3 keywords of two structs."""
    return 0.4 * jaccard(_low(f"{a}.entities"), _low(f"{b}.entities")) + 0.3 * jaccard(_low(f"{a}.topics"), _low(f"{b}.topics")) + 0.3 * jaccard(keywords(F.col(f"{a}.source_title"), F.col(f"{a}.text")), keywords(F.col(f"{b}.source_title"), F.col(f"{b}.text")))


def keywords(title: Column, text: Column) -> Column:
    """Alphabetic words over 3 letters of the title and of the first ten words of the text."""
    first = F.array_join(F.slice(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), 1, 10), " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.concat_ws(" ", title, first)), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3))
