"""Source queries (S) and the composed ingestion plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.sources import files, issues, web
from lodestone.storage import cut

_HREF = r"""<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)"""
_LINKS = f"""l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i){_HREF}', 1))) AS href FROM pages), lk AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href ELSE regexp_extract(url, '^(.*/)', 1) || href END AS link FROM l)"""


@query("source_web_links", f"WITH {_LINKS} SELECT page_id, link FROM lk")
def web_links(spark, sf):
    return web.links(table(spark, sf, "pages"), "page_id", "url", "html")


@query("source_web_titles", r"""SELECT page_id, CASE WHEN t <> '' THEN t WHEN h <> '' THEN h ELSE 'Untitled Document' END AS title FROM (SELECT page_id,
 trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS h FROM pages)""")
def web_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("source_web_wanted", r"WITH l AS (SELECT page_id, url FROM pages) SELECT page_id, url FROM l WHERE starts_with(url, 'http') AND NOT regexp_matches(url, '^.*/[0-9]*7$') AND regexp_matches(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/.*$')")
def web_wanted(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.where(web.wanted(F.col("url"), "http", pattern="/**") & ~F.col("url").rlike("^.*/[0-9]*7$"))


@query("source_web_content")
def web_content(spark, sf):
    return web.contents(table(spark, sf, "pages"), "page_id", "html")


@query("source_web_attachments", f"WITH {_LINKS}, e AS (SELECT page_id, link || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.CSV' ELSE '' END AS link FROM lk) SELECT page_id, link, lower(regexp_extract(link, '\\.([A-Za-z0-9]+)$', 1)) AS extension, CASE page_id % 3 WHEN 0 THEN 'application/pdf' ELSE 'text/csv' END AS mime FROM e WHERE page_id % 3 < 2")
def web_attachments(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".CSV").otherwise("")
    return web.attachment_links(web_links(spark, sf).withColumn("link", F.concat("link", tail)).where(F.col("page_id") % 3 < 2))


@query("source_web_crawl", "WITH RECURSIVE c(n, d) AS (SELECT nation.n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION SELECT (2 * c.n + k) % 25, d + 1 FROM c, (VALUES (1), (3)) t(k) WHERE d < 4) SELECT CAST(n AS VARCHAR) AS url, CAST(min(d) AS BIGINT) AS depth FROM c GROUP BY n")
def web_crawl(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("url"))
    edges = n.select("url", F.explode(F.array(F.lit(1), F.lit(3))).alias("k")).select("url", ((2 * F.col("url").cast("long") + F.col("k")) % 25).cast("string").alias("link"))
    return web.crawl(cut(edges), n.where("url = '0'"), 4, cut)


_PATH = "concat(CASE doc_id % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN 'src/app/' WHEN 2 THEN 'build/out/' ELSE '' END, CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END, file_name)"


@query("source_file_predicate", rf"WITH {R}, f AS (SELECT doc_id, {_PATH} AS path, coalesce(file_size, 0) AS size FROM results) SELECT doc_id, path FROM f WHERE NOT starts_with(string_split(path, '/')[-1], '.') AND NOT starts_with(path, 'build/') AND lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) IN ('md', 'py', 'pdf', 'docx', 'xlsx', 'png') AND size <= 200000 AND (starts_with(path, 'docs/') OR starts_with(path, 'src/'))")
def file_predicate(spark, sf):
    f = results(spark, sf).select("doc_id", F.expr(_PATH).alias("path"), F.coalesce("file_size", F.lit(0)).alias("size"))
    return f.where(files.accepted(F.col("path"), F.col("size"), ("docs/**", "src/**"), ("build/",), ("md", "py"), 200000, True)).select("doc_id", "path")


@query("source_file_types", rf"WITH {R} SELECT doc_id, CASE file_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in files.MIME.items())} ELSE 'application/octet-stream' END AS mime, file_type IN {files.CONVERTIBLE!r} AS convertible FROM results")
def file_types(spark, sf):
    return results(spark, sf).select("doc_id", files.media_type(F.col("file_name")).alias("mime"), files.extension(F.col("file_name")).isin(*files.CONVERTIBLE).alias("convertible"))


@query("source_file_metadata", rf"WITH {R}, f AS (SELECT doc_id, {_PATH} AS path, text FROM results) SELECT doc_id, string_split(path, '/')[-1] AS file_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS extension, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count, CAST(len(regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+[^ \t\n]')) AS BIGINT) AS heading_count, CAST(len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]*\)')) AS BIGINT) AS image_count, contains(text, '```') AS has_code_blocks FROM f")
def file_metadata(spark, sf):
    f = results(spark, sf).select("doc_id", F.expr(_PATH).alias("path"), "text")
    return f.select("doc_id", *[c.alias(k) for k, c in files.metadata(F.col("path"), F.col("text")).items()])


@query("source_issue_filter", "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'F') AND o_orderdate >= DATE '1996-01-01'")
def issue_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("updated"))
    return o.where(issues.issue_filter("1-URGENT", statuses=("O", "F"), since=F.expr("DATE '1996-01-01'"))).select("o_orderkey", "status")


@query("source_page_hierarchy", "SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, r_name || ' > ' || n_name AS breadcrumb, CAST(2 AS BIGINT) AS depth FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, 1 FROM region")
def page_hierarchy(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("title"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("title"))
    return issues.breadcrumbs(n.unionByName(r), "id", "parent", "title")


@query("source_union_in_order", """SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS id, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), length(html) FROM pages UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), length(text) FROM conversations""")
def union_in_order(spark, sf):
    size = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long").alias("size")
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), size("text"))
    p = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").cast("string").alias("id"), size("html"))
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), size("text"))
    return d.unionByName(p).unionByName(c)


@query("source_project_metadata", f"WITH {R} SELECT doc_id, coalesce(project_id, 'none') AS project_id, 'Project ' || coalesce(project_id, 'none') AS project_name FROM results")
def project_metadata(spark, sf):
    r = results(spark, sf).withColumn("project_id", F.coalesce("project_id", F.lit("none")))
    projects = r.select("project_id").distinct().withColumn("project_name", F.concat(F.lit("Project "), "project_id"))
    return r.join(projects, "project_id", "left").select("doc_id", "project_id", "project_name")


@query("ingest_chunks_by_strategy", None)
def ingest(spark, sf):
    """Pages and documents through routing, chunking and identity, as one plan."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 3 == 0, "md").otherwise("txt").alias("content_type"), "text")
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("html").alias("content_type"), F.col("html").alias("text"))
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit("json").alias("content_type"), F.col("props").alias("text"))
    return chunking.chunk(d.unionByName(p).unionByName(e), "id", "text", most=None)
