"""Sections, centrality and traversal of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, traversal
from lodestone.plans.graph_queries import _CO, _NID
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.storage import cut

_SET = lambda c: f"list_distinct(list_transform({c}, x -> lower(trim(x))))"
_WORDS = r"list_distinct(list_filter(regexp_extract_all(lower(source_title || ' ' || array_to_string((list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), w -> w <> ''))[1:10], ' ')), '[a-z]+'), w -> length(w) > 3))"
_JAC = lambda c: f"CASE WHEN len(x.{c}) > 0 AND len(y.{c}) > 0 THEN len(list_intersect(x.{c}, y.{c})) / len(list_distinct(list_concat(x.{c}, y.{c}))) ELSE 0.0 END"
_SCORE = f"round(0.4::DOUBLE * {_JAC('entities')} + 0.3::DOUBLE * {_JAC('topics')} + 0.3::DOUBLE * {_JAC('keywords')}, 6)"
_FEATURES = f"""f AS (SELECT doc_id, {_NID('doc', "source_type || ':' || source_url")} AS doc, {_NID('section', "source_type || ':' || source_url")} AS section, source_title, breadcrumb_text, {_SET('entities')} AS entities, {_SET('topics')} AS topics, {_WORDS} AS keywords FROM results)"""
_OFTEN = lambda c, kind, rel, w: f"SELECT DISTINCT section, {_NID(kind, 'name')}, '{rel}', {w}::DOUBLE FROM (SELECT section, unnest({c}) AS name FROM f) WHERE name IN (SELECT name FROM (SELECT unnest({c}) AS name FROM f) GROUP BY name HAVING count(*) >= 2)"
_SECTIONS = f"""se AS (SELECT doc AS src, section AS dst, 'contains' AS kind, 1.0::DOUBLE AS weight FROM f UNION ALL {_OFTEN('entities', 'entity', 'mentions', 0.7)} UNION ALL {_OFTEN('topics', 'topic', 'discusses', 0.6)}
 UNION ALL SELECT * FROM (SELECT x.section, y.section, 'similar_to', {_SCORE} AS weight FROM f x JOIN f y ON x.doc_id < y.doc_id AND (list_has_any(x.entities, y.entities) OR list_has_any(x.topics, y.topics))) WHERE weight > 0.3)"""
_NODES = "nd AS (SELECT doc AS node, 'document' AS kind, source_title AS name, entities, topics, keywords FROM f UNION ALL SELECT section, 'section', right(coalesce(breadcrumb_text, 'Section'), 50), entities, topics, keywords FROM f)"


@query("graph_sections", f"WITH {R}, {_FEATURES}, {_NODES} SELECT node, kind, name, CAST(len(entities) AS BIGINT) AS entities, CAST(len(topics) AS BIGINT) AS topics, array_to_string(list_sort(keywords), ',') AS keywords FROM nd")
def graph_sections(spark, sf):
    size = lambda c: F.size(c).cast("long").alias(c)
    return traversal.features(results(spark, sf)).select("node", "kind", "name", size("entities"), size("topics"), F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@query("graph_section_edges", f"WITH {R}, {_FEATURES}, {_SECTIONS} SELECT src, dst, kind, weight FROM se")
def graph_section_edges(spark, sf):
    return traversal.section_edges(results(spark, sf))


_ALL = f"{_FEATURES}, {_SECTIONS}, e0 AS (SELECT * FROM se UNION ALL SELECT {_NID('entity', 'x')}, {_NID('entity', 'y')}, 'co_occurs', least(1.0, n / 5) FROM {_CO('entities')} WHERE n >= 2), e AS (SELECT src, dst, weight AS w, kind AS k FROM e0 WHERE weight >= 0.1 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, kind DESC) = 1), {_NODES}"
_QUERY = "doc_id % 20 = 0"
_STARTS = f"q AS (SELECT doc_id AS query, entities, topics, keywords FROM f WHERE {_QUERY}), st AS (SELECT DISTINCT q.query, nd.node AS start FROM q JOIN nd ON list_has_any(q.entities, nd.entities) OR list_has_any(q.topics, nd.topics))"
_PATHS = """p(start, node, weight, path, hops) AS (SELECT DISTINCT start, start, 0.0::DOUBLE, [start], 0 FROM st UNION ALL SELECT start, dst, round(weight + w, 6), list_append(path, dst), hops + 1 FROM p JOIN e ON src = node WHERE hops < 3 AND NOT list_contains(path, dst))"""


def _traversal_sql(own: str, of_start: str) -> str:
    score = _SCORE.replace("x.", "q.").replace("y.", "n.")
    return f"""WITH RECURSIVE {R}, {_ALL}, {_STARTS}, {_PATHS}, o AS (SELECT * FROM p WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY {own}, array_to_string(path, '>')) = 1),
 s AS (SELECT st.query, o.*, CASE WHEN n.node IS NULL THEN 0.0 ELSE {score} END AS score FROM st JOIN o USING (start) JOIN q ON q.query = st.query LEFT JOIN nd n ON n.node = o.node),
 k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, start ORDER BY {of_start}, node) <= 20)
 SELECT query, start, node, CAST(hops AS BIGINT) AS hops, weight, score, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY query ORDER BY score DESC, weight DESC, start, node) AS rank FROM k QUALIFY rank <= 20"""


def _traversal(spark, sf, strategy, central=None, knowledge=None):
    r = results(spark, sf)
    nodes = cut(traversal.features(r), "features")
    asked = r.where(_QUERY).select(F.col("doc_id").alias("query"), traversal.doc_node().alias("node")).join(nodes, "node").drop("node", "kind", "name")
    starts = cut(traversal.start_nodes(asked, nodes, central), "starts")
    edges = cut(traversal.heaviest(traversal.knowledge_edges(r) if knowledge is None else knowledge), "knowledge")
    ids = traversal.numbers(nodes, edges)
    number = lambda df, *columns: cut(traversal.numbered(df, ids, *columns), "numbered")
    starts, nodes, central = number(starts, "start"), number(nodes, "node"), central and number(central, "node")
    paths = traversal.reach(number(edges, "src", "dst"), starts, relations=False)
    found = traversal.traverse(paths, starts, asked, nodes, strategy, central=central)
    found = traversal.named(cut(found, "found"), ids)
    return found.withColumn("path", F.array_join("path", ">")).withColumn("rank", F.col("rank").cast("long"))


@query("graph_traverse_breadth_first", _traversal_sql("hops, weight DESC", "hops, weight DESC"))
def traverse_breadth_first(spark, sf):
    return _traversal(spark, sf, "breadth_first")


@query("graph_traverse_weighted", _traversal_sql("weight DESC, hops", "weight DESC"))
def traverse_weighted(spark, sf):
    return _traversal(spark, sf, "weighted")


@query("graph_related_content", _traversal_sql("hops, weight DESC", "score DESC, hops, weight DESC"))
def related_content(spark, sf):
    return _traversal(spark, sf, "semantic")


def _nodes(r):
    rest = graph.graph_nodes(r).where("kind <> 'document'").select("node")
    own = r.select(F.explode(F.array(traversal.doc_node(), traversal.section_node())).alias("node")).distinct()
    return cut(own.union(rest), "nodes")


@query("graph_centrality", None)
def graph_centrality(spark, sf):
    r = results(spark, sf)
    edges = cut(traversal.knowledge_edges(r), "knowledge")
    c = traversal.centrality(_nodes(r), edges)
    return c.select("node", *[F.round(x, 12).alias(x) for x in ("degree", "betweenness", "centrality")])


@query("graph_traverse_centrality", None)
def traverse_centrality(spark, sf):
    r = results(spark, sf)
    knowledge = cut(traversal.knowledge_edges(r), "knowledge")
    central = cut(traversal.centrality(_nodes(r), knowledge), "central")
    return _traversal(spark, sf, "centrality", central, knowledge)
