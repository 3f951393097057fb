"""Quality of clusters and relationships between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import cluster_relations, similarity
from lodestone.plans.model import R, results
from lodestone.plans.registry import query

_RUNS = "flatten(list_transform(range(1, len(l) + 1), i -> list_transform(range(i, len(l) + 1), j -> array_to_string(l[i:j], ' > '))))"


@query("cluster_relationships", f"""WITH {R}, c0 AS (SELECT CASE WHEN trim(project_id) <> '' THEN project_id END AS cluster, source_type, has_code_blocks, coalesce(word_count, 0) AS words, breadcrumb_text AS bc, string_split(breadcrumb_text, ' > ') AS l FROM results),
 top AS (SELECT cluster, count(*) AS n FROM c0 WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, cluster LIMIT 10), c AS (SELECT c0.*, list_distinct({_RUNS}) AS runs FROM c0 JOIN top USING (cluster)),
 p AS (SELECT cluster, count(*) AS n, list_distinct(list(source_type)) AS s, bool_or(has_code_blocks) AS code, sum(words) / count(*) AS size FROM c GROUP BY 1),
 h AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS inside FROM c x JOIN c y ON x.cluster < y.cluster AND (list_contains(y.runs, x.bc) OR list_contains(x.runs, y.bc)) GROUP BY ALL),
 z AS (SELECT x.cluster AS a, y.cluster AS b, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) + CASE WHEN len(x.s) = 1 AND x.s = y.s THEN 0.3 ELSE 0 END AS source, coalesce(inside, 0) / (x.n * y.n) AS placed, list_sort(list_intersect(x.s, y.s)) AS shared,
  CASE WHEN x.code AND y.code THEN 0.4 WHEN NOT x.code AND NOT y.code THEN 0.2 ELSE 0 END + CASE WHEN least(x.size, y.size) > 0 AND least(x.size, y.size) / greatest(x.size, y.size) > 0.5 THEN 0.3 * least(x.size, y.size) / greatest(x.size, y.size) ELSE 0 END AS content FROM p x JOIN p y ON x.cluster < y.cluster LEFT JOIN h ON h.a = x.cluster AND h.b = y.cluster),
 r AS (SELECT a, b, round(least(1.0, source)::DOUBLE, 6) AS s1, round(placed::DOUBLE, 6) AS s2, round(content::DOUBLE, 6) AS s3, shared FROM z),
 k AS (SELECT a, b, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'source_similarity' WHEN s2 >= s3 THEN 'hierarchical' ELSE 'content_similarity' END AS kind, greatest(s1, s2, s3) AS strength, CASE WHEN s1 >= s2 AND s1 >= s3 THEN array_to_string(shared, ',') ELSE '' END AS shared FROM r)
SELECT * FROM k WHERE strength > 0.1 ORDER BY strength DESC, a, b LIMIT 10""")
def cluster_relationships(spark, sf):
    return cluster_relations.relationships(results(spark, sf), "projects").withColumn("shared", F.array_join("shared", ","))


@query("cluster_quality", None)
def cluster_quality(spark, sf):
    r = results(spark, sf)
    # Only the clusters that are shown are scored.
    shown = cluster_relations.members(r, "hierarchy", 10).drop("cluster")
    return cluster_relations.quality(r, "hierarchy", similarity.coherence(shown, "hierarchy"))
