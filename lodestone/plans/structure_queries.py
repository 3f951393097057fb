"""Heading and JSON structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import headings, json_schema
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.plans.text_queries import _MD
from lodestone.session import table
from lodestone.storage import cut


def marked(spark, sf):
    return results(spark, sf).select("doc_id", "is_excel_sheet", F.expr(_MD.replace("chr(10)", "'\\n'")).alias("md"))


@query("chunk_sections_by_levels", None)
def sections_by_levels(spark, sf):
    return headings.sections(marked(spark, sf), "doc_id", "md", F.col("is_excel_sheet"))


_HEAD = r"regexp_matches(line, '^#{1,6}[ \t]+[^ \t\r\n\f\x0B]')"


@query("chunk_heading_paths", rf"""WITH {R}, m AS (SELECT doc_id, string_split({_MD}, chr(10)) AS l FROM results), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM m),
 f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM x),
 h AS (SELECT doc_id, i, length(regexp_extract(line, '^#+')) AS level, regexp_replace(regexp_replace(line, '^#+[ \t]+', ''), '[ \t\r]+$', '') AS title FROM f WHERE NOT fenced AND {_HEAD}),
 p AS (SELECT a.doc_id, a.i, b.i AS j, b.title FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.i < a.i AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.i > b.i AND c.i < a.i AND c.level <= b.level)),
 g AS (SELECT doc_id, i, string_agg(title, ' > ' ORDER BY j) AS path FROM p GROUP BY ALL)
SELECT h.doc_id, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i) - 1 AS INTEGER) AS position, CAST(level AS INTEGER) AS level, h.title, coalesce(path, '') AS path FROM h LEFT JOIN g USING (doc_id, i)""")
def heading_paths(spark, sf):
    return headings.heading_paths(marked(spark, sf), "doc_id", "md").withColumn("path", F.array_join("path", " > "))


@query("text_heading_tree", None)
def heading_tree(spark, sf):
    return headings.heading_tree(marked(spark, sf), "doc_id", "md").withColumn("path", F.array_join("path", " > "))


_LINKED = "concat('See [', source_title, '](', source_url, ') now', chr(10), '[a](b) and [c](d)', chr(10), text)"


@query("text_markdown_links", rf"""WITH {R}, l AS (SELECT doc_id, unnest(string_split({_LINKED}, chr(10))) AS s FROM results), p AS (SELECT doc_id, string_split(s, '](') AS p FROM l WHERE len(string_split(s, '](')) = 2 AND contains(string_split(s, '](')[1], '['))
SELECT doc_id, string_split(p[1], '[')[2] AS text, string_split(p[2], ')')[1] AS url, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def markdown_links(spark, sf):
    shown = F.expr(_LINKED.replace("chr(10)", "'\\n'"))
    found = results(spark, sf).select("doc_id", F.explode(headings.links(shown)).alias("l"))
    return found.groupBy("doc_id", "l.text", "l.url").agg(F.count(F.lit(1)).alias("n"))


@query("text_phrases", r"""WITH p AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '(^|[ \t\n\x0B\f\r])(\p{Lu}[^ \t\n\x0B\f\r]*([ \t\n\x0B\f\r]+\p{Lu}[^ \t\n\x0B\f\r]*)*)', 2), p -> regexp_replace(p, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS phrase FROM documents)
SELECT doc_id, phrase, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def phrases(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.explode(headings.phrases(F.coalesce("text", F.lit("")))).alias("phrase"))
    return found.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


_NUMBER = "CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN 'int' WHEN json_type(props, '$.k') = 'DOUBLE' THEN 'float' WHEN json_type(props, '$.k') = 'VARCHAR' THEN 'str' ELSE 'NoneType' END"


@query("json_schema_events", f"""WITH p AS (SELECT props, {_NUMBER} AS t, json_type(props, '$.k') IS NOT NULL AND json_type(props, '$.k') <> 'NULL' AND coalesce(json_extract_string(props, '$.k'), '') <> '' AS filled FROM events WHERE props IS NOT NULL)
SELECT '' AS path, 'object' AS type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS filled, CAST(NULL AS BIGINT) AS parents, CAST(NULL AS BOOLEAN) AS required, round(avg(CASE WHEN filled THEN 1.0 ELSE 0.0 END), 6) AS completeness FROM p
 UNION ALL SELECT '/k', t, count(*), sum(CASE WHEN filled THEN 1 ELSE 0 END)::BIGINT, (SELECT count(*) FROM p), (SELECT bool_and(filled) FROM p), NULL FROM p WHERE json_exists(props, '$.k') GROUP BY t""")
def json_schema_events(spark, sf):
    s = json_schema.schema(cut(json_schema.states(table(spark, sf, "events"), "props"), "schema"))
    return s.select("path", "type", "n", "filled", "parents", "required", "completeness")


_SIDE = lambda c: f"CASE WHEN {c} IS NULL THEN 'NoneType' ELSE 'TYPE' END"
_NEST = lambda path, c, kind: f"SELECT '{path}' AS path, {_SIDE(c).replace('TYPE', kind)} AS type, count(*) AS n, count({c}) FILTER (CAST({c} AS VARCHAR) <> '') AS filled, (SELECT count(*) FROM results) AS parents, (SELECT count({c}) FILTER (CAST({c} AS VARCHAR) <> '') = count(*) FROM results) AS required, CAST(NULL AS DOUBLE) AS completeness, CAST(NULL AS BOOLEAN) AS homogeneous, CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length FROM results GROUP BY {c} IS NULL, {_SIDE(c)}"


@query("json_schema_results", f"""WITH {R} SELECT '' AS path, 'object' AS type, count(*) AS n, count(*) AS filled, CAST(NULL AS BIGINT) AS parents, CAST(NULL AS BOOLEAN) AS required, 1.0::DOUBLE AS completeness, CAST(NULL AS BOOLEAN) AS homogeneous, CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length FROM results
 UNION ALL {_NEST('/title', 'source_title', 'str')} UNION ALL {_NEST('/meta/project', 'project_id', 'str')} UNION ALL {_NEST('/meta/depth', 'depth', 'int')}
 UNION ALL SELECT '/meta', 'object', count(*), count(*), count(*), true, round(avg(((CASE WHEN project_id IS NULL OR project_id = '' THEN 0 ELSE 1 END) + (CASE WHEN depth IS NULL THEN 0 ELSE 1 END)) / 2), 6), NULL, NULL, NULL FROM results
 UNION ALL SELECT '/entities', 'array', count(*), count(*), count(*), true, NULL, true, min(len(entities)), max(len(entities)) FROM results
 UNION ALL SELECT '/entities/*', 'str', count(*), count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(entities) FROM results)""")
def json_schema_results(spark, sf):
    value = F.to_json(F.struct(F.col("source_title").alias("title"), "entities", F.struct(F.col("project_id").alias("project"), "depth").alias("meta")), {"ignoreNullFields": "false"})
    s = json_schema.schema(cut(json_schema.states(results(spark, sf).select(value.alias("v")), "v"), "schema"))
    return s.drop("key")
