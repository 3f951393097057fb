"""Similarity, clustering, complement and conflict queries (D, G, X01-X16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import conflicts, similarity
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.plans.retrieval_queries import points

_IT = lambda *cs: "it AS (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{c}:' || lower(trim(x)) AS item FROM (SELECT doc_id, unnest({c}) AS x FROM results)" for c in cs) + ")"
_J = lambda c: f"CASE WHEN len(x.{c}) > 0 AND len(y.{c}) > 0 THEN len(list_intersect(list_distinct(list_transform(x.{c}, v -> lower(trim(v)))), list_distinct(list_transform(y.{c}, v -> lower(trim(v)))))) / len(list_distinct(list_concat(list_transform(x.{c}, v -> lower(trim(v))), list_transform(y.{c}, v -> lower(trim(v)))))) ELSE 0.0 END"


@query("similarity_entity_overlap", f"""WITH {R}, {_IT('entities')}, n AS (SELECT doc_id, count(*) AS n FROM it GROUP BY 1), p AS (SELECT i.doc_id AS a, j.doc_id AS b, count(*) AS shared FROM it i JOIN it j USING (item) WHERE i.doc_id < j.doc_id GROUP BY ALL)
SELECT a, b, CAST(shared AS BIGINT) AS shared, round(shared / (x.n + y.n - shared), 6) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b""")
def entity_overlap(spark, sf):
    return similarity.overlap(results(spark, sf), "entities")


_META = """list_avg(list_filter([CASE WHEN x.project_id IS NOT NULL AND y.project_id IS NOT NULL THEN CASE WHEN x.project_id = y.project_id THEN 1.0 ELSE 0.0 END::DOUBLE END, CASE WHEN x.source_type = y.source_type THEN 0.5::DOUBLE END,
 ((x.has_code_blocks = y.has_code_blocks)::INT + (x.has_tables = y.has_tables)::INT + (x.has_images = y.has_images)::INT + (x.has_links = y.has_links)::INT)::DOUBLE / 4, CASE WHEN x.word_count IS NOT NULL AND y.word_count IS NOT NULL THEN least(x.word_count, y.word_count) / greatest(x.word_count, y.word_count, 1) END], v -> v IS NOT NULL))"""
_FEAT = "list_avg(list_filter([least(x.read_time, y.read_time) / greatest(x.read_time, y.read_time, 1), CASE WHEN x.depth IS NOT NULL AND y.depth IS NOT NULL THEN greatest(0.0, 1 - abs(x.depth - y.depth) / 5) END], v -> v IS NOT NULL))"
_UP = lambda s: f"regexp_extract({s}, '^(.*) > [^>]*$', 1)"
_HIER = f"""CASE WHEN x.parent_id = y.document_id OR y.parent_id = x.document_id THEN 1.0 WHEN x.parent_id = y.parent_id THEN 0.8 WHEN {_UP('x.breadcrumb_text')} = {_UP('y.breadcrumb_text')} AND {_UP('x.breadcrumb_text')} <> '' THEN 0.7
 WHEN x.breadcrumb_text IS NOT NULL AND y.breadcrumb_text IS NOT NULL THEN len(list_intersect(string_split(x.breadcrumb_text, ' > '), string_split(y.breadcrumb_text, ' > '))) / len(list_distinct(list_concat(string_split(x.breadcrumb_text, ' > '), string_split(y.breadcrumb_text, ' > ')))) ELSE 0.0 END::DOUBLE"""
_SCORED = f"""m AS (SELECT a, b, round({_J('entities')}, 6) AS entity, round({_J('topics')}, 6) AS topic, round({_META}, 6) AS metadata, round({_HIER}, 6) AS hierarchical, round({_FEAT}, 6) AS features, coalesce(x.project_id = y.project_id, false) AS same FROM p JOIN results x ON x.doc_id = a JOIN results y ON y.doc_id = b),
 s AS (SELECT *, round((0.25::DOUBLE * entity + 0.25::DOUBLE * topic + 0.15::DOUBLE * metadata + 0.10::DOUBLE * hierarchical + 0.05::DOUBLE * features) / 0.8::DOUBLE, 6) AS score, CASE WHEN hierarchical > 0.7 THEN 'hierarchical' WHEN same THEN 'project_grouping' ELSE 'semantic' END AS relation FROM m)"""
_PAIRS = f"{_IT('entities', 'topics')}, p AS (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM it i JOIN it j USING (item) WHERE i.doc_id < j.doc_id)"


@query("similarity_pair_records", f"WITH {R}, {_PAIRS}, {_SCORED} SELECT a, b, entity, topic, metadata, hierarchical, features, relation FROM s")
def pair_records(spark, sf):
    r = results(spark, sf)
    return similarity.scored(similarity.sharing_pairs(r, "entities", "topics"), r).select("a", "b", "entity", "topic", "metadata", "hierarchical", "features", "relation")


@query("similarity_find_similar", f"""WITH {R}, {_IT('entities', 'topics')}, p AS (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM it i JOIN it j USING (item) WHERE i.doc_id % 20 = 0 AND i.doc_id <> j.doc_id), {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY floor(score * 100000 + 0.25) DESC, b) AS rank FROM s WHERE score >= 0.5)
SELECT a, b, floor(score * 100000 + 0.25) / 100000 AS score, relation, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 5""")
def find_similar(spark, sf):
    from pyspark.sql import Window

    r = results(spark, sf)
    s = similarity.similar_to(r, F.col("doc_id") % 20 == 0, 0.5, 1000).withColumn("score", F.floor(F.col("score") * 100000 + 0.25) / 100000)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return s.withColumn("rank", rank.cast("long")).where("rank <= 5")


@query("similarity_matrix_insights", f"WITH {R}, {_PAIRS}, {_SCORED}, n AS (SELECT count(*) AS n FROM results) SELECT round(sum(score) / (any_value(n) * (any_value(n) - 1) / 2), 7) AS mean, round(max(score), 5) AS largest, CAST(count(*) AS BIGINT) AS met FROM s, n")
def matrix_insights(spark, sf):
    r = results(spark, sf)
    out = similarity.insights(similarity.scored(similarity.sharing_pairs(r, "entities", "topics"), r), r.agg(F.count(F.lit(1)).alias("n")))
    return out.select(F.round("mean", 7).alias("mean"), F.round("largest", 5).alias("largest"), "met")


_TOP = lambda c: f"""(WITH i AS (SELECT lower(trim(x)) AS x, row_number() OVER () AS pos FROM (SELECT unnest({c}) AS x)), f AS (SELECT x, count(*) AS n, min(pos) AS first FROM i WHERE x <> '' GROUP BY x ORDER BY n DESC, first LIMIT 3) SELECT string_agg(x, '|' ORDER BY x) FROM f)"""
_TWO = lambda c: f"CASE WHEN len({c}) > 0 THEN '{c}:' || array_to_string({c}[1:2], ',') || '|' ELSE '' END"
_KEYS = {
    "entities": _TOP("entities"),
    "topics": _TOP("topics"),
    "projects": "project_id",
    "hierarchy": "coalesce(array_to_string(string_split(breadcrumb_text, ' > ')[1:2], ' > '), 'root')",
    "mixed": f"{_TWO('entities')} || {_TWO('topics')} || 'project:' || coalesce(project_id, 'no_project')",
}


def _cluster_query(strategy):
    sql = f"""WITH {R}, c AS (SELECT doc_id, {_KEYS[strategy]} AS cluster FROM results) SELECT cluster, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS representative, CASE WHEN count(*) <= 3 THEN 'small' WHEN count(*) <= 8 THEN 'medium' ELSE 'large' END AS size_class
 FROM c WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) >= 2 ORDER BY n DESC, cluster LIMIT 10"""

    @query(f"cluster_by_{strategy}", sql)
    def run(spark, sf):
        return similarity.clusters(results(spark, sf), strategy)


for _s in _KEYS:
    _cluster_query(_s)


_COH = f"""c AS (SELECT doc_id, {_KEYS['topics']} AS cluster FROM results), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), p AS (SELECT i.cluster, i.doc_id AS a, j.doc_id AS b FROM c i JOIN c j USING (cluster) JOIN n USING (cluster) WHERE i.doc_id < j.doc_id),
 {_SCORED}, h AS (SELECT p.cluster, round(avg(score), 6) AS coherence FROM s JOIN p USING (a, b) GROUP BY 1), q AS (SELECT n.cluster, n.n, coalesce(coherence, 0.0) AS coherence FROM n LEFT JOIN h USING (cluster))"""


@query("cluster_coherence", f"WITH {R}, {_COH} SELECT cluster, CAST(n AS BIGINT) AS n, round(coherence, 4) AS coherence FROM q")
def cluster_coherence(spark, sf):
    return similarity.coherence(results(spark, sf), "topics").withColumn("coherence", F.round("coherence", 4))


@query("cluster_overall_quality", f"""WITH {R}, {_COH}, t AS (SELECT count(*) AS total FROM results) SELECT round(sum(n) / any_value(total), 4) AS held, round(avg(coherence), 4) AS c, round(stddev_pop(coherence), 4) AS dev, round(avg(CASE WHEN n BETWEEN 3 AND 15 THEN 1.0 ELSE 0.5 END), 4) AS size FROM q, t""")
def cluster_overall_quality(spark, sf):
    r = results(spark, sf)
    out = similarity.overall_quality(r, similarity.coherence(r, "topics"))
    return out.select(*[F.round(c, 4).alias(c) for c in ("held", "c", "dev", "size")])


@query("cluster_strategy_choice", f"""WITH {R}, f AS (SELECT round(least(1.0, avg(len(entities)) / 5), 6) AS entity_richness, round(least(1.0, avg(len(topics)) / 3), 6) AS topic_clarity, round(least(1.0, count(DISTINCT project_id) / count(*)), 6) AS project_spread,
 round(avg(coalesce(len(string_split(breadcrumb_text, ' > ')), 0)) / 5, 6) AS hierarchy, round(least(1.0, count(DISTINCT source_type) / 4), 6) AS source_diversity FROM results)
SELECT *, CASE WHEN topic_clarity * 2.5 > entity_richness * 3 AND topic_clarity * 2.5 >= 1 + source_diversity AND topic_clarity * 2.5 >= greatest(project_spread, hierarchy) * 2 THEN 'topics' WHEN entity_richness * 3 >= 1 + source_diversity AND entity_richness * 3 >= greatest(project_spread, hierarchy) * 2 THEN 'entities' ELSE 'mixed' END AS strategy FROM f""")
def strategy_choice(spark, sf):
    return similarity.best_strategy(similarity.characteristics(results(spark, sf)))


@query("cluster_common_title_words", f"""WITH {R}, w AS (SELECT unnest(regexp_extract_all(lower(source_title), '[a-z]+')) AS word FROM results), t AS (SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 12)
SELECT word, CAST(n AS BIGINT) AS n FROM t WHERE length(word) > 3 AND word NOT IN ({', '.join(repr(x) for x in similarity.TITLE_STOP_WORDS)})""")
def common_title_words(spark, sf):
    return similarity.common_title_words(results(spark, sf), 12)


_ANY = lambda c, ws: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"
_LEVEL = lambda c: "CASE " + " ".join(f"WHEN {_ANY(c, w)} THEN {k}" for k, w in enumerate(conflicts.LEVELS)) + " ELSE 2 END"
_TYPE = lambda c: "CASE " + " ".join(f"WHEN {_ANY(c, w)} THEN '{k}'" for k, w in conflicts.TYPES) + " ELSE 'general' END"
_CHAL = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {_ANY(c, w)} THEN {k} END" for k, w in enumerate(conflicts.CHALLENGES)) + "], v -> v IS NOT NULL)"


@query("complement_title_classes", f"WITH {R} SELECT doc_id, {_LEVEL('source_title')} AS level, {_TYPE('source_title')} AS kind, array_to_string({_CHAL('source_title')}, ',') AS challenges FROM results")
def title_classes(spark, sf):
    t = F.col("source_title")
    return results(spark, sf).select("doc_id", conflicts.abstraction_level(t).alias("level"), conflicts.document_type(t).alias("kind"), F.array_join(conflicts.challenges(t), ",").alias("challenges"))


#: The rule's own list of counted technologies, not the operator's constants.
_COUNTED = ("react", "angular", "vue", "node", "node.js", "python", "java", "docker", "kubernetes", "aws", "azure", "postgres", "mysql", "mongodb", "jwt", "oauth")
_NAMED = lambda words: "(" + " + ".join(f"(contains(lower(t), '{k}') AND contains(lower(c), '{k}'))::INT" for k in words) + ")"
_BOTH = lambda groups: "(" + " OR ".join(f"({_ANY('t', g)} AND {_ANY('c', g)})" for g in groups) + ")"
_EITHER = lambda a, b: f"(({_ANY('t', a)} AND {_ANY('c', b)}) OR ({_ANY('t', b)} AND {_ANY('c', a)}))"
_WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), v -> v <> ''))"
_BLEND = lambda f: f"CASE WHEN len({f}) = 0 THEN least(0.5::DOUBLE, fallback) WHEN len({f}) = 1 THEN {f}[1] ELSE least(0.95::DOUBLE, {f}[1] + 0.1::DOUBLE * list_sum({f}[2:])) END"


_COMPLEMENT_SQL = f"""WITH {R}, {_IT('topics')}, p AS (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM it i JOIN it j USING (item) WHERE i.doc_id <> j.doc_id), z AS (SELECT a, b, x.source_title AS t, y.source_title AS c, x.project_id IS NOT DISTINCT FROM y.project_id AS same,
 len(list_intersect(list_transform(x.topics, v -> lower(trim(v))), list_transform(y.topics, v -> lower(trim(v))))) AS shared, len(list_intersect(list_transform(x.entities, v -> lower(trim(v))), list_transform(y.entities, v -> lower(trim(v))))) AS ents FROM p JOIN results x ON x.doc_id = a JOIN results y ON y.doc_id = b),
 f AS (SELECT *, {_EITHER(conflicts.REQUIREMENTS, conflicts.IMPLEMENTATION)} AS req, {_EITHER(conflicts.BUSINESS, conflicts.TECHNICAL)} OR {_EITHER(conflicts.FEATURE, conflicts.SECURITY)} AS cross_f, abs({_LEVEL('t')} - {_LEVEL('c')}) AS gap, {_TYPE('t')} AS tt, {_TYPE('c')} AS ct,
  CASE WHEN ents > 0 THEN ents ELSE {_NAMED(_COUNTED)} END AS tech, ents > 0 OR {_NAMED(_COUNTED + ('golang', 'gcp', 'rest', 'graphql', 'grpc'))} > 0 AS has_tech, len(list_intersect({_WORDS('t')}, {_WORDS('c')})) AS common FROM z),
 g AS (SELECT *, greatest(CASE WHEN shared > 0 THEN 0.2::DOUBLE + 0.05::DOUBLE * shared ELSE 0.0::DOUBLE END, CASE WHEN ents > 0 THEN 0.15::DOUBLE + 0.05::DOUBLE * ents ELSE 0.0::DOUBLE END, CASE WHEN common > 1 THEN 0.1::DOUBLE + 0.02::DOUBLE * common ELSE 0.0::DOUBLE END) AS fallback,
  list_concat(CASE WHEN req THEN [0.85::DOUBLE] ELSE [] END, list_reverse_sort(list_filter([CASE WHEN gap > 0 THEN 0.7::DOUBLE + 0.1::DOUBLE * gap END, CASE WHEN cross_f THEN 0.75::DOUBLE END, CASE WHEN shared > 0 AND tt <> ct THEN least(0.65::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * shared) END], v -> v IS NOT NULL))) AS intra,
  list_reverse_sort(list_filter([CASE WHEN {_BOTH(conflicts.CHALLENGES)} THEN 0.8::DOUBLE END, CASE WHEN {_BOTH(conflicts.DOMAINS)} THEN 0.75::DOUBLE END, CASE WHEN {_BOTH(conflicts.PATTERNS)} THEN 0.7::DOUBLE END, CASE WHEN has_tech THEN least(0.6::DOUBLE, 0.3::DOUBLE + 0.1::DOUBLE * tech) END], v -> v IS NOT NULL)) AS inter FROM f),
 h AS (SELECT a, b, round(CASE WHEN same AND shared >= 3 THEN least(0.95::DOUBLE, ({_BLEND('intra')}) * 1.2::DOUBLE) WHEN same THEN {_BLEND('intra')} ELSE ({_BLEND('inter')}) * 0.8::DOUBLE END, 6) AS score, CASE WHEN same AND req THEN 'requirements' WHEN same AND gap > 0 THEN 'abstraction' WHEN same THEN 'topics' ELSE 'across projects' END AS reason FROM g),
 k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM h WHERE score > 0.15) SELECT a, b, score, reason, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 5"""


@query("complement_find", _COMPLEMENT_SQL)
def complement(spark, sf):
    return conflicts.complementary(results(spark, sf), 5)


_CTEXT = "CASE doc_id % 5 WHEN 0 THEN 'You must not enable this; it is deprecated. ' WHEN 1 THEN 'You must always use the recommended way. ' WHEN 2 THEN 'Never do that, disable it instead. ' ELSE '' END"
_COUNT = lambda c: " + ".join(f"contains(lower({c}), '{w}')::INT" for w in conflicts.INDICATORS)


def _hit(c, p):
    bare = rf"regexp_replace(lower({c}), '\b{p}\s+not\b', ' ', 'g')" if p in ("must", "should") else f"lower({c})"
    return rf"regexp_matches({bare}, '\b{p}\b')"


_OPP = "list_filter([" + ", ".join(f"CASE WHEN ({_hit('tx', p)} AND {_hit('ty', q)}) OR ({_hit('tx', q)} AND {_hit('ty', p)}) THEN {k} END" for k, (p, q) in enumerate(conflicts.OPPOSITES)) + "], v -> v IS NOT NULL)"


def conflict_texts(spark, sf):
    return results(spark, sf).withColumn("text", F.concat(F.expr(_CTEXT), "text"))


_DETECT_SQL = f"""WITH {R}, d AS (SELECT * REPLACE (concat({_CTEXT}, text) AS text) FROM results), {_IT('entities')}, p AS (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM it i JOIN it j USING (item) WHERE i.doc_id < j.doc_id),
 z AS (SELECT a, b, x.text AS tx, y.text AS ty, {_J('entities')} AS shared, least(x.source_type, y.source_type) || '/' || greatest(x.source_type, y.source_type) AS types, abs(x.created_day - y.created_day) AS days, x.project_id IS NOT DISTINCT FROM y.project_id AS same FROM p JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE length(x.text) >= 10 AND length(y.text) >= 10 AND x.text <> y.text),
 c AS (SELECT a, b, shared, {_COUNT('tx')} + {_COUNT('ty')} AS said, CASE WHEN days > 365 THEN 3 ELSE 0 END + CASE types WHEN 'confluence/git' THEN 2 WHEN 'confluence/jira' THEN 1 ELSE 0 END + CASE WHEN same THEN 0 ELSE 1 END AS w, array_to_string({_OPP}, ',') AS opposites FROM z),
 o AS (SELECT a, b, round(CASE WHEN shared > 0.3 AND said > 0 THEN least(1.0, shared * said / 10) ELSE 0.0 END, 6) AS text_confidence, round(CASE WHEN w > 2 THEN w / 10 ELSE 0.0 END, 6) AS metadata_weight, opposites FROM c)
SELECT *, CASE WHEN opposites <> '' THEN 'procedural' WHEN text_confidence > 0 THEN 'general' ELSE 'metadata' END AS category FROM o WHERE text_confidence > 0 OR metadata_weight > 0 OR opposites <> ''"""


@query("conflict_detect", _DETECT_SQL)
@query("conflict_detect_whole", _DETECT_SQL)
def conflict_detect(spark, sf):
    return conflicts.detect(conflict_texts(spark, sf))


_BAND = "v AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS (SELECT x.doc_id AS a, y.doc_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM v x JOIN v y USING (label) WHERE x.doc_id < y.doc_id), t AS (SELECT *, CASE WHEN score >= 0.8 THEN 'primary' WHEN score >= 0.5 THEN 'secondary' ELSE 'tertiary' END AS tier FROM b WHERE score BETWEEN 0.3 AND 0.95)"


@query("conflict_vector_band", f"WITH {_BAND} SELECT a, b, score, tier FROM t")
def vector_band(spark, sf):
    return conflicts.vector_band(points(spark, sf), 0.3)


@query("conflict_tier_caps", f"WITH {_BAND}, r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, a, b) AS rank FROM t) SELECT a, b, score, tier, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= CASE tier WHEN 'primary' THEN 12 WHEN 'secondary' THEN 8 ELSE 4 END")
def tier_caps(spark, sf):
    return conflicts.capped_by_tier(conflicts.vector_band(points(spark, sf), 0.3), {"primary": 12, "secondary": 8, "tertiary": 4})


_SNIPPETS_SQL = f"WITH {R}, d AS (SELECT doc_id, concat({_CTEXT}, text) AS text FROM results) SELECT doc_id, CASE WHEN contains(lower(text), 'enable') THEN substr(text, greatest(1, instr(lower(text), 'enable') - 40), 86) END AS snippet FROM d"


@query("conflict_snippets", _SNIPPETS_SQL)
@query("conflict_snippets_whole", _SNIPPETS_SQL)
def snippets(spark, sf):
    return conflict_texts(spark, sf).select("doc_id", conflicts.snippet(F.col("text"), "enable").alias("snippet"))


_VTEXT = "CASE doc_id % 5 WHEN 0 THEN concat('For version 1.', CAST(doc_id % 3 AS STRING), '.0 and Python 3.11. ') WHEN 1 THEN concat('Java 17.0; Version  2.0.', CAST(doc_id % 2 AS STRING), ' ') WHEN 2 THEN 'node18.2 ' ELSE '' END"
_V = lambda p: f"regexp_extract_all(lower(concat({_VTEXT}, coalesce(text, ''))), '{p}', 1)"


@query("conflict_versions", rf"""WITH {R}, {_IT('entities')}, p AS (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM it i JOIN it j USING (item) WHERE i.doc_id < j.doc_id), v AS (SELECT doc_id, {_V(conflicts.VERSION)} AS own, {_V(conflicts.RUNTIME)} AS on_ FROM results),
 z AS (SELECT a, b, array_to_string(x.on_, ',') AS versions_a, array_to_string(y.on_, ',') AS versions_b, CASE WHEN len(x.own) > 0 AND len(y.own) > 0 AND x.own <> y.own THEN 'version' WHEN len(x.on_) > 0 AND len(y.on_) > 0 AND len(list_distinct(list_concat(x.on_, y.on_))) > 1 THEN 'runtime' END AS kind FROM p JOIN v x ON x.doc_id = a JOIN v y ON y.doc_id = b)
SELECT * FROM z WHERE kind IS NOT NULL""")
def conflict_versions(spark, sf):
    return conflicts.version_conflicts(results(spark, sf).withColumn("text", F.concat(F.expr(_VTEXT), F.coalesce("text", F.lit("")))))
