"""Citation, knowledge-graph and topic queries (X18-X20, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import jaccard
from lodestone.operators import graph
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.storage import cut

_REFS = "rf AS (SELECT doc_id, 'https://host' || CAST((doc_id // 3) % 10 AS VARCHAR) || '.example.com/docs/' || CAST(doc_id // 3 AS VARCHAR) || CASE (doc_id // 3) % 3 WHEN 1 THEN '/' WHEN 2 THEN '?q=1#frag' ELSE '' END AS url, source_title AS title FROM results WHERE doc_id % 2 = 0)"
_CITE = f"""{_REFS}, ce AS (SELECT DISTINCT src, dst, 'cross_reference' AS kind, 1.0::DOUBLE AS weight FROM (SELECT rf.doc_id AS src, coalesce((SELECT min(doc_id) FROM results r WHERE r.source_url = rf.url), (SELECT min(doc_id) FROM results r WHERE r.source_title = rf.title)) AS dst FROM rf) WHERE dst IS NOT NULL AND dst <> src
 UNION ALL SELECT p.doc_id, c.doc_id, 'hierarchical_child', 2.0 FROM results c JOIN results p ON p.document_id = c.parent_id)"""


def references(r):
    i = F.floor(F.col("doc_id") / 3)
    url = F.concat(F.lit("https://host"), (i % 10).cast("string"), F.lit(".example.com/docs/"), i.cast("string"), F.when(i % 3 == 1, "/").when(i % 3 == 2, "?q=1#frag").otherwise(""))
    return r.where("doc_id % 2 = 0").select("doc_id", url.alias("url"), F.col("source_title").alias("title"))


def citations(spark, sf):
    r = results(spark, sf)
    return graph.citation_edges(r, references(r))


@query("citation_edges", f"WITH {R}, {_CITE} SELECT * FROM ce")
def citation_edges(spark, sf):
    return citations(spark, sf)


@query("citation_siblings", f"WITH {R}, s AS (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY parent_id ORDER BY doc_id) AS dst FROM results WHERE parent_id IS NOT NULL) SELECT src, dst, 'sibling' AS kind, 0.5::DOUBLE AS weight FROM s WHERE dst IS NOT NULL")
def citation_siblings(spark, sf):
    return graph.sibling_edges(results(spark, sf))


@query("citation_degrees", f"WITH {R}, {_CITE}, e AS (SELECT src AS node, 0 AS i, 1 AS o FROM ce UNION ALL SELECT dst, 1, 0 FROM ce) SELECT node, CAST(sum(i) AS BIGINT) AS cited, CAST(sum(o) AS BIGINT) AS citing, CAST(sum(i) + sum(o) AS BIGINT) AS degree FROM e GROUP BY 1")
def citation_degrees(spark, sf):
    return graph.degrees(citations(spark, sf))


@query("citation_most_cited", f"WITH {R}, {_CITE} SELECT dst AS node, CAST(count(*) AS BIGINT) AS cited FROM ce GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_cited(spark, sf):
    return graph.degrees(citations(spark, sf)).where("cited > 0").orderBy(F.desc("cited"), "node").limit(10).select("node", "cited")


@query("citation_page_rank", None)
@query("citation_page_rank_whole", None)
def page_rank(spark, sf):
    nodes = results(spark, sf).select(F.col("doc_id").alias("node"))
    rank = graph.page_rank(nodes, cut(citations(spark, sf)), graph.MOST_ROUNDS, cut=cut, tolerance=graph.RANK_TOLERANCE)
    return rank.select("node", F.round("rank", 9).alias("rank"))


@query("citation_hits", None)
def hits(spark, sf):
    return graph.hits(cut(citations(spark, sf)), graph.MOST_ROUNDS, cut=cut, tolerance=graph.HUB_TOLERANCE).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


_NID = lambda kind, v: f"'{kind}_' || substr(sha256({v}), 1, 16)"
_TERMS = lambda c: f"(SELECT doc_id, unnest(list_distinct(list_transform({c}, x -> lower(trim(x))))) AS name FROM results)"
_DOC = _NID("doc", "source_type || ':' || source_url")


@query("graph_nodes", f"""WITH {R} SELECT DISTINCT ON (node) node, kind, name FROM (SELECT {_DOC} AS node, 'document' AS kind, source_title AS name FROM results) UNION ALL SELECT {_NID('entity', 'name')}, 'entity', name FROM {_TERMS('entities')} GROUP BY name HAVING count(*) >= 2 UNION ALL SELECT {_NID('topic', 'name')}, 'topic', name FROM {_TERMS('topics')} GROUP BY name HAVING count(*) >= 2""")
def graph_nodes(spark, sf):
    return graph.graph_nodes(results(spark, sf))


def _often(c, kind, rel, w):
    return f"SELECT {_DOC.replace('source_type', 'r.source_type').replace('source_url', 'r.source_url')} AS src, {_NID(kind, 'name')} AS dst, '{rel}' AS kind, {w}::DOUBLE AS weight FROM {_TERMS(c)} t JOIN results r USING (doc_id) WHERE name IN (SELECT name FROM {_TERMS(c)} GROUP BY name HAVING count(*) >= 2)"


_CO = lambda c: f"(SELECT a.name AS x, b.name AS y, count(*) AS n FROM {_TERMS(c)} a JOIN {_TERMS(c)} b USING (doc_id) WHERE a.name < b.name GROUP BY ALL)"


@query("graph_edges", f"""WITH {R} {_often('entities', 'entity', 'mentions', 0.7)} UNION ALL {_often('topics', 'topic', 'discusses', 0.6)} UNION ALL SELECT {_NID('entity', 'x')}, {_NID('entity', 'y')}, 'co_occurs', least(1.0, n / 5) FROM {_CO('entities')} WHERE n >= 2""")
def graph_edges(spark, sf):
    return graph.graph_edges(results(spark, sf))


@query("graph_statistics", f"WITH {R}, {_CITE} SELECT kind, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT src) AS BIGINT) AS sources, round(avg(weight), 6) AS mean_weight FROM ce GROUP BY 1")
def graph_statistics(spark, sf):
    return citations(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("graph_components", None)
def graph_components(spark, sf):
    return graph.weak_components(cut(citations(spark, sf)), cut)


@query("graph_neighbours", f"WITH RECURSIVE {R}, {_CITE}, e AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce), t(node, hop) AS (SELECT doc_id, 0 FROM results WHERE doc_id = 12 UNION SELECT dst, hop + 1 FROM t JOIN e ON src = node WHERE hop < 3) SELECT node, CAST(min(hop) AS BIGINT) AS hop FROM t GROUP BY node")
def graph_neighbours(spark, sf):
    starts = results(spark, sf).where("doc_id = 12").select(F.col("doc_id").alias("node"))
    return graph.neighbours(cut(citations(spark, sf)), starts, 3, cut=cut)


@query("topic_cooccurrence", f"WITH {R} SELECT x, y, CAST(n AS BIGINT) AS n FROM {_CO('topics')}")
def topic_cooccurrence(spark, sf):
    return graph.cooccurrence(results(spark, sf), "topics")


@query("topic_related", f"WITH {R}, f AS (SELECT name, count(*) AS f FROM {_TERMS('topics')} GROUP BY 1) SELECT x, y, CAST(n AS BIGINT) AS n, round(greatest(0.0, least(1.0, (log2(n * (SELECT sum(f) FROM f) / (a.f * b.f + 1)) + 5) / 10)), 6) AS score FROM {_CO('topics')} c JOIN f a ON a.name = x JOIN f b ON b.name = y WHERE n >= 2")
def topic_related(spark, sf):
    return graph.related_topics(results(spark, sf))


@query("topic_best_related", f"WITH {R}, f AS (SELECT name, count(*) AS f FROM {_TERMS('topics')} GROUP BY 1), s AS (SELECT x, y, round(greatest(0.0, least(1.0, (log2(n * (SELECT sum(f) FROM f) / (a.f * b.f + 1)) + 5) / 10)), 6) AS score FROM {_CO('topics')} c JOIN f a ON a.name = x JOIN f b ON b.name = y WHERE n >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS k FROM s) SELECT x, y, score FROM r WHERE k = 1")
def topic_best_related(spark, sf):
    from pyspark.sql import Window

    r = graph.related_topics(results(spark, sf))
    return r.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))).where("k = 1").select("x", "y", "score")


@query("topic_chain", None)
def topic_chain(spark, sf):
    related = cut(graph.related_topics(results(spark, sf)))
    return graph.topic_chain(related, "topic 3", 5)


@query("topic_chain_coherence", f"WITH {R}, c AS (SELECT doc_id, list_distinct(list_transform(topics, x -> lower(x))) AS t, lag(list_distinct(list_transform(topics, x -> lower(x)))) OVER (PARTITION BY group_id ORDER BY doc_id) AS p, group_id FROM results) SELECT group_id, round(avg(CASE WHEN p IS NOT NULL THEN len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p))) END), 6) AS coherence FROM c GROUP BY 1")
def chain_coherence(spark, sf):
    from pyspark.sql import Window

    t = F.array_distinct(F.transform("topics", F.lower))
    c = results(spark, sf).select("group_id", t.alias("t"), F.lag(t).over(Window.partitionBy("group_id").orderBy("doc_id")).alias("p"))
    return c.groupBy("group_id").agg(F.round(F.avg(F.when(F.col("p").isNotNull(), jaccard(F.col("t"), F.col("p")))), 6).alias("coherence"))


@query("graph_keywords", rf"""WITH {R} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(source_title || ' ' || array_to_string((list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), w -> w <> ''))[1:10], ' ')), '[a-z]+'), w -> length(w) > 3))), ',') AS keywords FROM results""")
def graph_keywords(spark, sf):
    return results(spark, sf).select("doc_id", F.array_join(F.array_sort(graph.keywords(F.col("source_title"), F.col("text"))), ",").alias("keywords"))
