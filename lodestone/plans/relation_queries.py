"""Text similarity, relationships of targets, shown pairs and discovery potential."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import relations, similarity
from lodestone.plans.analysis_queries import _IT
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.plans.text_queries import LETTERS

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_WORDS = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \t\n\x0B\f\r]+'), w -> w <> ''))"
_JAC = lambda a, b: f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"
_MEANT = lambda c: f"list_filter({c}, w -> w NOT IN ({_LIST(relations.STOP_WORDS)}))"
_TERMS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in relations.KEY_TERMS) + "], t -> t IS NOT NULL)"


@query("similarity_text", f"""WITH {R}, {_IT('entities')}, p AS (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM it i JOIN it j USING (item) WHERE i.doc_id < j.doc_id),
 f AS (SELECT doc_id, {_WORDS('text')} AS w, {_WORDS('source_title')} AS t, list_filter(list_distinct({LETTERS}), w -> w NOT IN ({_LIST(T.KEYWORD_STOP_WORDS)})) AS s, {_TERMS} AS k, list_distinct(list_transform(entities, x -> lower(trim(x)))) AS e FROM results)
SELECT a, b, round({_JAC(_MEANT('x.w'), _MEANT('y.w'))} * (1 + 1e-9), 6) AS text, round((CASE WHEN len(x.s) = 0 AND len(y.s) = 0 THEN 1.0 WHEN len(x.s) = 0 OR len(y.s) = 0 THEN 0.0 ELSE 0.7::DOUBLE * {_JAC('x.s', 'y.s')} + 0.3::DOUBLE * {_JAC('x.e', 'y.e')} END) * (1 + 1e-9), 6) AS lexical,
 CASE WHEN least(len(x.w), len(y.w)) > 0 THEN len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) > 0.2 ELSE false END AS overlap, len(list_intersect(x.t, y.t)) > 0 OR len(list_intersect(x.k, y.k)) >= 2 AS alike FROM p JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b""")
def similarity_text(spark, sf):
    return relations.similar_texts(results(spark, sf))


@query("similarity_target_relations", None)
def target_relations(spark, sf):
    return relations.of_targets(results(spark, sf), F.col("doc_id") % 20 == 0)


@query("cluster_shown_pairs", f"""WITH {R}, c AS (SELECT CASE WHEN trim(project_id) <> '' THEN project_id END AS cluster, doc_id FROM results), m AS (SELECT * FROM c WHERE cluster IS NOT NULL), p AS (SELECT x.cluster, x.doc_id AS a, y.doc_id AS b FROM m x JOIN m y ON x.cluster = y.cluster AND x.doc_id < y.doc_id)
SELECT cluster, a, b, row_number() OVER (PARTITION BY cluster ORDER BY a, b) AS place FROM (SELECT * FROM p WHERE (SELECT count(*) FROM m z WHERE z.cluster = p.cluster AND z.doc_id <= p.b) <= 11) QUALIFY place <= 50""")
def shown_pairs(spark, sf):
    r = results(spark, sf)
    return relations.shown_pairs(r.select("doc_id", similarity.cluster_key(r, "projects").alias("cluster")).where("cluster IS NOT NULL"))


_EXPLORE = "CASE doc_id % 3 WHEN 0 THEN 'broader' WHEN 1 THEN 'deeper' ELSE 'related' END"


@query("topic_discovery_potential", f"WITH {R}, l AS (SELECT doc_id // 8 AS chain, lower(topics[1]) AS topic, round(1 - 0.1::DOUBLE * (doc_id % 8), 6) AS relevance, {_EXPLORE} AS exploration FROM results) SELECT chain, count(*) AS links, round(least(1.0, 0.3::DOUBLE * count(DISTINCT topic) / count(*) + 0.4::DOUBLE * avg(relevance) + 0.2::DOUBLE * count(DISTINCT exploration) / 4 + 0.1::DOUBLE * least(1.0, count(*) / 5)), 6) AS potential FROM l GROUP BY 1")
def discovery_potential(spark, sf):
    link = results(spark, sf).selectExpr("doc_id div 8 AS chain", "lower(topics[0]) AS topic", "round(1 - 0.1D * (doc_id % 8), 6) AS relevance", f"{_EXPLORE} AS exploration")
    return relations.discovery_potential(link)
