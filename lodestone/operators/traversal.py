"""Walks over the knowledge graph: sections, centrality by shortest paths, and traversal from a query's start nodes.

Edges are followed from source to target. Every loop here runs over rounds, each written to the shared folder: the
rows of a round are (start, node) pairs, so no node's neighbourhood meets in one task and a lost executor costs a round.

A traversal keeps each reached node with its best path, where a queue would keep the first path it pops: breadth first
the shortest (heavier first among equals), weighted the heaviest, by centrality or meaning the shortest, ranked by the
node's own value. Equal paths go by their nodes. Up to three steps, the two best paths to a node at each step hold
the best path without a repeated node: one step back lies a single node that a further step may have to avoid.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard
from lodestone.operators.graph import cooccurrence, keywords, node_id
from lodestone.operators.similarity import _low, sharing_pairs
from lodestone.storage import cut, folder

#: Shares of entities, topics and keywords in the similarity of nodes and of a node with a query.
ENTITY, TOPIC, KEYWORD = 0.4, 0.3, 0.3
#: A similarity edge lies above the first; weights of the other relations; shares of centrality.
SIMILAR, CONTAINS, MENTIONS, DISCUSSES, DEGREE, BETWEEN = 0.3, 1.0, 0.7, 0.6, 0.4, 0.6
#: Most steps, most results, least weight of an edge, start nodes where nothing matches.
HOPS, RESULTS, LEAST_WEIGHT, FALLBACK = 3, 20, 0.1, 3
#: Rows that may meet for each known pair in a round of shortest paths; where fewer than one source in FEW goes on, only their pairs are read.
SPREAD, FEW = 4, 8
#: Paths to a node that a step keeps.
KEPT = 2

STRATEGIES = ("breadth_first", "weighted", "centrality", "semantic")


def doc_node() -> Column:
    return node_id("doc", F.concat_ws(":", "source_type", "source_url"))


def section_node() -> Column:
    return node_id("section", F.concat_ws(":", "source_type", "source_url"))


def features(results: DataFrame) -> DataFrame:
    """(node, kind, name, entities, topics, keywords) of documents and their sections, of one address that with the smallest id."""
    parts = [_low("entities").alias("entities"), _low("topics").alias("topics"), keywords(F.col("source_title"), F.col("text")).alias("keywords")]
    r = results.select("doc_id", doc_node().alias("doc"), section_node().alias("section"), "source_title", F.coalesce("breadcrumb_text", F.lit("Section")).alias("crumb"), *parts)
    one = r.groupBy("doc", "section").agg(F.min_by(F.struct(*[c for c in r.columns if c not in ("doc", "section", "doc_id")]), "doc_id").alias("r")).select("doc", "section", "r.*")
    each = F.array(F.struct(F.col("doc").alias("node"), F.lit("document").alias("kind"), F.col("source_title").alias("name")), F.struct(F.col("section").alias("node"), F.lit("section").alias("kind"), F.substring("crumb", -50, 50).alias("name")))
    return one.select(F.explode(each).alias("n"), "entities", "topics", "keywords").select("n.*", "entities", "topics", "keywords")


def score(a: str, b: str) -> Column:
    """Similarity of two structs of entities, topics and keywords; an empty side of any counts 0."""
    part = lambda c: jaccard(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    return F.round(ENTITY * part("entities") + TOPIC * part("topics") + KEYWORD * part("keywords"), 6)


def section_edges(results: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): documents contain sections, sections mention entities, discuss topics and resemble sections.

    Resemblance above the limit needs a common entity or topic (keywords alone reach the limit at most), so
    pairs come from those.
    """
    own = results.select("doc_id", doc_node().alias("doc"), section_node().alias("section"))
    contains = own.select(F.col("doc").alias("src"), F.col("section").alias("dst"), F.lit("contains").alias("kind"), F.lit(CONTAINS).alias("weight")).distinct()

    def to(column: str, kind: str, relation: str, weight: float) -> DataFrame:
        t = results.select(section_node().alias("src"), F.explode(_low(column)).alias("name"))
        often = t.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("name")
        return t.join(often, "name", "left_semi").select("src", node_id(kind, F.col("name")).alias("dst"), F.lit(relation).alias("kind"), F.lit(weight).alias("weight")).distinct()

    sides = results.select("doc_id", section_node().alias("s"), F.struct(_low("entities").alias("entities"), _low("topics").alias("topics"), keywords(F.col("source_title"), F.col("text")).alias("keywords")).alias("f"))
    pairs = sharing_pairs(results, "entities", "topics").select("a", "b")
    pairs = pairs.join(sides.select(F.col("doc_id").alias("a"), F.col("s").alias("src"), F.col("f").alias("x")), "a").join(sides.select(F.col("doc_id").alias("b"), F.col("s").alias("dst"), F.col("f").alias("y")), "b")
    similar = pairs.where("src <> dst").select("src", "dst", F.lit("similar_to").alias("kind"), score("x", "y").alias("weight")).where(F.col("weight") > SIMILAR)
    similar = similar.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
    return functools.reduce(DataFrame.unionByName, [contains, to("entities", "entity", "mentions", MENTIONS), to("topics", "topic", "discusses", DISCUSSES), similar])


def knowledge_edges(results: DataFrame) -> DataFrame:
    """All edges of the knowledge graph, an edge for each relation of two nodes."""
    together = cooccurrence(results, "entities").where("n >= 2")
    both = together.select(node_id("entity", F.col("x")).alias("src"), node_id("entity", F.col("y")).alias("dst"), F.lit("co_occurs").alias("kind"), F.least(F.lit(1.0), F.col("n") / 5).alias("weight"))
    return section_edges(results).unionByName(both)


class Levels:
    """Tables of one schema by round, below one path of the shared folder: all of them are read as one table."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.path = spark, schema, folder(spark, "levels")

    def put(self, k: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/level={k}")
        return self.at(k)

    def at(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={k}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("level")


def betweenness(edges: DataFrame, spread: int = SPREAD, cut=cut) -> DataFrame:
    """(node, paths): the sum over pairs (s, t) of the share of shortest paths from s to t that pass through the node.

    Forward, once all pairs up to a distance are known, those at just that distance meet the pairs that begin where
    they end: a round finds all pairs up to twice the distance, so rounds are few however long the paths are. It goes
    less far, one edge at least, where more than ``spread`` rows would meet for each known pair. Every shortest path
    of a new pair has one node at which its halves meet. Backward, the paths of a pair pass through that node and are
    handed to the two halves, each a pair of an earlier round, down to single edges. A node that nothing leads to and
    that leads to one node alone is no source of its own: its paths are those of that node, which count once more, and
    all of them pass through it. Nodes go by numbers meanwhile. Nodes that no path passes through are left out.
    """
    named = edges.select("src", "dst").where("src <> dst").distinct()
    ids = cut(named.select(F.col("src").alias("name")).union(named.select("dst")).distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")
    number = lambda c: ids.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    e = cut(named.join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "edges")
    out = e.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("only"))
    leaves = out.where("n = 1").join(e.select(F.col("dst").alias("source")), "source", "left_anti")
    led = leaves.groupBy(F.col("only").alias("source")).agg(F.count(F.lit(1)).alias("leaves"))
    from_ = cut(out.join(leaves.select("source"), "source", "left_anti").join(led, "source", "left").select("source", F.coalesce("leaves", F.lit(0)).alias("leaves")), "sources")
    spark, whole = e.sparkSession, from_.count()
    pairs, sizes = Levels(spark, "source long, node long, hops long, paths double, weight double"), Levels(spark, "source long, hops long, n long")
    halves, flows = Levels(spark, "source long, mid long, node long, hops long, paths double, share double, weight double"), Levels(spark, "source long, mid long, node long, hops long, flow double")
    size = lambda df: df.groupBy("source", "hops").agg(F.count(F.lit(1)).alias("n"))
    last = pairs.put(0, e.withColumnRenamed("src", "source").join(from_, "source").select("source", F.col("dst").alias("node"), F.lit(1).cast("long").alias("hops"), F.lit(1.0).alias("paths"), (1.0 + F.col("leaves")).alias("weight")))
    sizes.put(0, size(last))
    # A round's distance before it, and how far it goes beyond.
    known, rounds = 1, []
    while True:
        first = last.where(F.col("hops") == known)
        ends = first.groupBy(F.col("node").alias("source")).agg(F.count(F.lit(1)).alias("m"))
        meet = sizes.all().where(F.col("hops") <= known).join(ends, "source").groupBy("hops").agg(F.sum(F.col("n") * F.col("m")).alias("n")).orderBy("hops").collect()
        if not meet:
            break
        further, rows, most = known, 0, spread * pairs.all().count()
        for r in meet:
            rows += r.n
            if r.hops > 1 and rows > most:
                further = r.hops - 1
                break
        k = len(rounds) + 1
        second = pairs.all().where(F.col("hops") <= further).select(F.col("source").alias("mid"), F.col("node").alias("to"), F.col("hops").alias("h"), F.col("paths").alias("p"))
        met = first.withColumnRenamed("node", "mid").join(second, "mid").where("source <> to").select("source", "mid", F.col("to").alias("node"), (F.col("hops") + F.col("h")).alias("hops"), (F.col("paths") * F.col("p")).alias("ways"), "weight")
        live = cut(first.select("source").distinct(), "live")
        seen = pairs.all() if live.count() > whole / FEW else pairs.all().join(live, "source", "left_semi")
        seen = seen.select("source", F.lit(None).cast("long").alias("mid"), "node", "hops", F.lit(0.0).alias("ways"), F.lit(0.0).alias("weight"))
        pair = Window.partitionBy("source", "node")
        nearest = met.union(seen).withColumn("least", F.min("hops").over(pair)).where("mid IS NOT NULL AND hops = least").withColumn("paths", F.sum("ways").over(pair))
        new = halves.put(k, nearest.select("source", "mid", "node", "hops", "paths", (F.col("ways") / F.col("paths")).alias("share"), "weight"))
        last = pairs.put(k, new.groupBy("source", "node").agg(*[F.first(c).alias(c) for c in ("hops", "paths", "weight")]))
        sizes.put(k, size(last))
        rounds.append((known, further))
        known += further
    for k in range(len(rounds), 0, -1):
        known, further = rounds[k - 1]
        back = halves.at(k).withColumn("given", F.lit(0.0))
        # Only the next round's first halves are as long as this round's pairs; the second halves of any later one may be.
        given = [flows.at(k + 1).select("source", F.col("mid").alias("node"), "flow")] if k < len(rounds) else []
        for i in range(k + 1, len(rounds) + 1):
            if rounds[i - 1][1] > known:
                given.append(flows.at(i).where((F.col("hops") - rounds[i - 1][0]).between(known + 1, known + further)).select(F.col("mid").alias("source"), "node", "flow"))
        if given:
            back = back.drop("given").join(functools.reduce(DataFrame.union, given).groupBy("source", "node").agg(F.sum("flow").alias("given")), ["source", "node"], "left")
        flows.put(k, back.select("source", "mid", "node", "hops", (F.col("share") * (F.col("weight") + F.coalesce("given", F.lit(0.0)))).alias("flow")))
    found = [pairs.all().where("weight > 1").select(F.col("source").alias("node"), (F.col("weight") - 1).alias("flow"))]
    found += [flows.all().select(F.col("mid").alias("node"), "flow")] if rounds else []
    total = functools.reduce(DataFrame.union, found).groupBy("node").agg(F.sum("flow").alias("paths"))
    return total.join(ids.withColumnRenamed("id", "node"), "node").select(F.col("name").alias("node"), "paths")


def centrality(nodes: DataFrame, edges: DataFrame, spread: int = SPREAD, cut=cut) -> DataFrame:
    """(node, degree, betweenness, centrality) of all ``nodes``: edges at a node by n - 1, paths through it by (n - 1) (n - 2)."""
    n = nodes.count()
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    all_ = nodes.select("node").join(ends, "node", "left").join(betweenness(edges, spread, cut), "node", "left")
    degree = F.coalesce("d", F.lit(0)) / max(1, n - 1)
    between = F.coalesce("paths", F.lit(0.0)) / max(1, (n - 1) * (n - 2))
    return all_.select("node", degree.alias("degree"), between.alias("betweenness"), (DEGREE * degree + BETWEEN * between).alias("centrality"))


def start_nodes(queries: DataFrame, nodes: DataFrame, central: DataFrame | None = None) -> DataFrame:
    """(query, start): nodes that hold an entity or a topic of the query; where none does, the most central documents, if given."""
    asked = lambda c: queries.select("query", F.explode(c).alias("item"))
    held = lambda c: nodes.select(F.col("node").alias("start"), F.explode(c).alias("item"))
    found = functools.reduce(DataFrame.union, [asked(c).join(held(c), "item").select("query", "start") for c in ("entities", "topics")]).distinct()
    if central is None:
        return found
    top = nodes.where("kind = 'document'").join(central, "node").orderBy(F.desc("centrality"), "node").limit(FALLBACK).select(F.col("node").alias("start"))
    # FALLBACK rows for each query that has none.
    return found.unionByName(queries.join(found, "query", "left_anti").select("query").join(F.broadcast(top), F.lit(True)))


def numbers(nodes: DataFrame, edges: DataFrame, cut=cut) -> DataFrame:
    """(name, id): a number for each node of either table, in the names' order: paths of numbers are a fraction of those of names."""
    names = nodes.select(F.col("node").alias("name")).union(edges.select("src")).union(edges.select("dst")).distinct()
    return cut(cut(names, "names").orderBy("name").withColumn("id", F.monotonically_increasing_id()), "numbers")


def numbered(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(ids.select(F.col("name").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return df


def named(found: DataFrame, ids: DataFrame) -> DataFrame:
    """What ``traverse`` found over numbers, with the nodes' names."""
    steps = found.select("query", "rank", F.posexplode("path").alias("at", "id")).join(ids, "id")
    listed = steps.groupBy("query", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("path"))
    whole = found.drop("start", "node", "path").join(listed, ["query", "rank"])
    return whole.withColumn("start", F.element_at("path", 1)).withColumn("node", F.element_at("path", -1)).select(*found.columns)


def _sequence(paths: DataFrame) -> Column:
    """The order of equal paths of one length: that of their nodes' names, or of numbers in the names' order."""
    return F.array_join("path", ">") if paths.schema["path"].dataType.elementType.typeName() == "string" else F.col("path")


def heaviest(edges: DataFrame, least: float = LEAST_WEIGHT, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, weight, kind): of several relations of two nodes the heaviest, which is walked."""
    e = edges.where(F.col("weight") >= least)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    return e.groupBy("src", "dst").agg(F.max(F.struct("weight", "kind")).alias("e")).select("src", "dst", "e.weight", "e.kind")


def reach(edges: DataFrame, starts: DataFrame, hops: int = HOPS, least: float = LEAST_WEIGHT, kinds: tuple[str, ...] = (), cut=cut, relations: bool = True) -> DataFrame:
    """(start, node, hops, weight, path, kinds): the best paths of each length from every start to the nodes that they reach.

    Nodes are names, or ``numbers`` of them; without ``relations`` paths have no kinds.
    """
    e = heaviest(edges, least, kinds).withColumnsRenamed({"weight": "w", "kind": "k"})
    e = cut(e if relations else e.drop("k"), "edges")
    at = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0.0).alias("weight"), F.array("start").alias("path"), F.array().cast("array<string>").alias("kinds")).distinct()
    at = at if relations else at.drop("kinds")
    found = []
    best = Window.partitionBy("start", "node").orderBy(F.desc("weight"), _sequence(at))
    for k in range(1, hops + 1):
        step = at.join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        walked = [F.concat("kinds", F.array("k")).alias("kinds")] if relations else []
        step = step.select("start", F.col("dst").alias("node"), F.round(F.col("weight") + F.col("w"), 6).alias("weight"), F.concat("path", F.array("dst")).alias("path"), *walked)
        at = cut(step.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= KEPT).drop("_r"), "paths")
        found.append(at.withColumn("hops", F.lit(k).cast("long")))
    return functools.reduce(DataFrame.unionByName, found)


def traverse(
    paths: DataFrame, starts: DataFrame, queries: DataFrame, nodes: DataFrame, strategy: str = "weighted", results: int = RESULTS, central: DataFrame | None = None, per_start: int | None = None, cut=cut
) -> DataFrame:
    """(query, start, node, hops, weight, score, path, kinds, rank): a query's best reached nodes under a strategy.

    Each start gives its ``per_start`` best by the strategy's own order (default: as many as ``results``); over all
    starts, the score with the query comes first and the weight of the path second. Only an order by meaning needs all that a
    start reaches to meet the queries; a query and a node are scored once, however many starts lead there.
    """
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    heavy = (F.desc("weight"), F.asc("hops")) if strategy == "weighted" else (F.asc("hops"), F.desc("weight"))
    own = Window.partitionBy("start", "node").orderBy(*heavy, _sequence(paths))
    one = paths.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")
    order = {"breadth_first": (F.asc("hops"), F.desc("weight")), "weighted": (F.desc("weight"),), "semantic": (F.desc("score"), F.asc("hops"), F.desc("weight"))}
    if strategy == "centrality":
        one = one.join(central.select("node", "centrality"), "node", "left")
        order["centrality"] = (F.desc(F.coalesce("centrality", F.lit(0.0))), F.asc("hops"))
    best = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order[strategy], "node"))).where(F.col("_r") <= (per_start or results)).drop("_r")
    if strategy != "semantic":
        one = best(one, "start")
    asked = queries.select("query", F.struct("entities", "topics", "keywords").alias("q"))
    met = cut(starts.join(asked, "query", "left_semi").join(one, "start"), "met")
    f = nodes.select("node", F.struct("entities", "topics", "keywords").alias("f"))
    scores = met.select("query", "node").distinct().join(f, "node").join(asked, "query").select("query", "node", score("q", "f").alias("score"))
    kept = met.join(scores, ["query", "node"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if strategy == "semantic":
        kept = best(kept, "query", "start")
    of_query = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("weight"), "start", "node")
    kept = kept.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= results)
    return kept.select("query", "start", "node", "hops", "weight", "score", "path", *[c for c in ("kinds",) if c in kept.columns], "rank")


def reasoning(paths: DataFrame, names: DataFrame) -> DataFrame:
    """``paths`` with ``reasoning``, one line for each step: name --relation--> name. ``names`` is (node, name)."""
    key = [c for c in ("query", "start", "node") if c in paths.columns]
    steps = paths.select(*key, F.posexplode("path").alias("_at", "_n")).join(names.select(F.col("node").alias("_n"), "name"), "_n", "left")
    listed = steps.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("name", "_n").alias("name")))), lambda s: s["name"]).alias("_names"))
    line = F.transform("kinds", lambda k, i: F.concat(F.element_at("_names", i + 1), F.lit(" --"), k, F.lit("--> "), F.element_at("_names", i + 2)))
    return paths.join(listed, key).withColumn("reasoning", line).drop("_names")
