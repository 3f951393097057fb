"""Identity and text-profile queries (F, I04, I07, I08, C02, C09, C11, C12, C17, C27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import identity, text
from lodestone.operators import chunking
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.session import table

WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), w -> w <> '')"
LETTERS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), w -> regexp_full_match(w, '[a-z]+'))"
SENT = r"list_filter(string_split(text, '.'), s -> trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g')) <> '')"
UUID = "substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12)"
_URL = r"regexp_replace(regexp_replace(lower(trim(source_url)), '[?#;].*$', ''), '/+$', '')"


@query("identity_document_ids", f"""WITH {R}, k AS (SELECT doc_id, sha256(lower(trim(source_type))||':'||lower(trim(source))||':'||{_URL}) AS h FROM results)
SELECT doc_id, {UUID.format('h')} AS id, {UUID.format("sha256(" + UUID.format('h') + "||'_'||CAST(doc_id % 4 AS VARCHAR))")} AS chunk FROM k""")
def document_ids(spark, sf):
    r = results(spark, sf).withColumn("id", identity.document_id(F.col("source_type"), F.col("source"), F.col("source_url")))
    return r.select("doc_id", "id", identity.chunk_id(F.col("id"), F.col("chunk_index")).alias("chunk"))


@query("identity_state_uri", rf"""WITH {R} SELECT doc_id, source_type||':'||source||':'||replace(replace(replace(replace(regexp_replace(source_url, '/+$', ''), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D').replace('#', '%23') AS uri FROM results""")
def state_uri(spark, sf):
    return results(spark, sf).select("doc_id", identity.state_uri(F.col("source_type"), F.col("source"), F.col("source_url")).alias("uri"))


@query("identity_content_hash", f"""WITH {R} SELECT doc_id, sha256(CAST(to_json({{'content': replace(text, chr(13)||chr(10), chr(10)), 'metadata': {{'author': author, 'file_size': coalesce(CAST(file_size AS VARCHAR), 'null')}}, 'title': source_title}}) AS VARCHAR)) AS content_hash FROM results""")
def content_hash(spark, sf):
    return results(spark, sf).select("doc_id", identity.content_hash(F.col("text"), F.col("source_title"), author=F.col("author"), file_size=F.col("file_size")).alias("content_hash"))


@query("text_content_flags", rf"""WITH {R} SELECT doc_id, contains(text, '```') AS has_code, regexp_matches(text, '\|.*\|') AS has_table, regexp_matches(text, 'https?://') AS has_link,
 CAST(len({WORDS}) AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS char_count, CAST(greatest(1, len({WORDS}) // 200) AS BIGINT) AS read_time FROM results""")
def content_flags(spark, sf):
    return results(spark, sf).select("doc_id", *[c.alias(k) for k, c in text.content_flags(F.col("text")).items()])


@query("text_chunk_statistics", rf"""WITH {R} SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS word_count, CAST(len({SENT}) AS BIGINT) AS sentence_count,
 CAST(len(list_filter(string_split(text, chr(10)||chr(10)), p -> NOT regexp_matches(p, '^\s*$'))) AS BIGINT) AS paragraph_count,
 round(len({WORDS}) / greatest(1, len({SENT})), 4) AS avg_words_per_sentence,
 CASE WHEN length(text) > 0 THEN round(length(replace(text, ' ', '')) / length(text), 4) ELSE 0.0 END AS density FROM results""")
def chunk_statistics(spark, sf):
    return results(spark, sf).select("doc_id", *[c.alias(k) for k, c in text.chunk_statistics(F.col("text")).items()])


@query("text_quality", rf"""WITH {R}, s AS (SELECT doc_id, text, {WORDS} AS w, {SENT} AS s FROM results), q AS (
 SELECT doc_id, text, CASE WHEN len(w) > 0 THEN round(len(list_distinct(list_transform(w, x -> lower(x)))) / len(w), 3) ELSE 0.0 END AS diversity,
 CASE WHEN len(s) > 0 THEN round(list_sum(list_transform(s, x -> len(list_filter(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+'), w -> w <> '')))) / len(s), 1) ELSE 0.0 END AS avg_sentence,
 regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM s)
SELECT doc_id, diversity, CAST(avg_sentence AS DOUBLE) AS avg_sentence,
 CASE WHEN avg_sentence < 10 AND diversity > 0.7 THEN 'easy' WHEN avg_sentence < 20 AND diversity > 0.5 THEN 'moderate' WHEN avg_sentence < 30 THEN 'difficult' ELSE 'very_difficult' END AS readability,
 round(CASE WHEN regexp_matches(t, '[.!?]$') THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN regexp_matches(t, '^[A-Z]') THEN CAST(0.2 AS DOUBLE) ELSE 0 END
 + CASE WHEN length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', '')) THEN CAST(0.2 AS DOUBLE) ELSE 0 END
 + CASE WHEN (2 * length(text) - length(replace(text, '"', '')) - length(replace(text, '''', ''))) % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END
 + CASE WHEN contains(text, chr(10)||chr(10)) OR contains(text, '.') THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 2) AS completeness FROM q""")
def quality(spark, sf):
    r = results(spark, sf).select("doc_id", text.diversity(F.col("text")).alias("diversity"), text.average_sentence(F.col("text")).alias("avg_sentence"), text.completeness(F.col("text")).alias("completeness"))
    return r.withColumn("readability", text.readability(F.col("avg_sentence"), F.col("diversity")))


_CH = ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in text.CHARACTERISTICS.items())


@query("text_characteristics", f"""WITH {R} SELECT doc_id, {_CH}, contains(text, '"') OR contains(text, '''') AS has_quotes, contains(text, '(') AND contains(text, ')') AS has_parentheses FROM results""")
def characteristics(spark, sf):
    return results(spark, sf).select("doc_id", *[c.alias(k) for k, c in text.characteristics(F.col("text")).items()])


@query("text_paragraph_features", rf"""WITH {R}, p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM results)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(len(regexp_extract_all(text, '\?')) AS BIGINT) AS questions, CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS exclamations,
 round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1), 4) AS capital_ratio, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers FROM p""")
def paragraph_features(spark, sf):
    r = results(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return r.select("doc_id", F.col("pos").cast("long").alias("pos"), *[c.alias(k) for k, c in text.paragraph_features(F.col("text")).items()])


_LW = ", ".join(f"'{w}'" for w in text.LANGUAGE_WORDS)


@query("text_language_and_category", rf"""WITH {R}, w AS (SELECT *, {LETTERS} AS w FROM results)
SELECT doc_id, CASE WHEN len(w) > 0 AND len(list_filter(w, x -> x IN ({_LW}))) / greatest(len(w), 1) >= 0.1 THEN 'en' ELSE 'unknown' END AS lang_found,
 CASE WHEN has_code_blocks THEN 'technical' WHEN contains(text, '$$') THEN 'academic' WHEN has_tables AND has_images THEN 'structured' WHEN has_links THEN 'informational' ELSE 'narrative' END AS category FROM w""")
def language_and_category(spark, sf):
    r = results(spark, sf)
    cat = text.category(F.col("has_code_blocks"), F.col("text").contains("$$"), F.col("has_tables"), F.col("has_images"), F.col("has_links"))
    return r.select("doc_id", text.language(F.col("text")).alias("lang_found"), cat.alias("category"))


_SW = ", ".join(f"'{w}'" for w in text.KEYWORD_STOP_WORDS)


@query("text_keyword_density", rf"""WITH {R}, w AS (SELECT doc_id, unnest({LETTERS}) AS word FROM results), f AS (SELECT * FROM w WHERE length(word) > 2 AND word NOT IN ({_SW})),
 c AS (SELECT doc_id, word, count(*) AS n FROM f GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c)
SELECT doc_id, word, CAST(n AS BIGINT) AS n, round(n / total, 6) AS density FROM k WHERE rank <= 10""")
def keyword_density(spark, sf):
    return chunking.keyword_density(results(spark, sf), "doc_id", "text", 10)


@query("text_cross_references", rf"""WITH {R}, m AS (SELECT doc_id, unnest(regexp_extract_all(concat(source_title, ' see section 3.2 and Figure ', CAST(doc_id % 9 AS VARCHAR), ', chapter B. ', text), '(?i)\b(section|chapter|figure|table|appendix)\s+([0-9]+(?:\.[0-9]+)*|[A-Z]\b)')) AS ref FROM results)
SELECT doc_id, lower(regexp_extract(ref, '^[A-Za-z]+')) AS kind, regexp_extract(ref, '\S+$') AS target, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL""")
def cross_references(spark, sf):
    shown = F.concat("source_title", F.lit(" see section 3.2 and Figure "), (F.col("doc_id") % 9).cast("string"), F.lit(", chapter B. "), "text")
    m = results(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(shown, F.lit(text.REFERENCE), F.lit(0))).alias("ref"))
    return m.groupBy("doc_id", F.lower(F.regexp_extract("ref", "^[A-Za-z]+", 0)).alias("kind"), F.regexp_extract("ref", r"\S+$", 0).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("text_breadcrumb_and_slug", rf"""WITH {R} SELECT doc_id, CASE WHEN breadcrumb_text IS NULL THEN source_title ELSE breadcrumb_text END AS breadcrumb,
 CAST(CASE WHEN breadcrumb_text IS NULL THEN 1 ELSE len(string_split(breadcrumb_text, ' > ')) END AS BIGINT) AS depth, CASE WHEN breadcrumb_text IS NULL THEN NULL ELSE string_split(breadcrumb_text, ' > ')[2] END AS parent,
 CASE WHEN breadcrumb_text IS NULL THEN source_title ELSE string_split(breadcrumb_text, ' > ')[1] END AS root,
 regexp_replace(regexp_replace(regexp_replace(lower(source_title), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM results""")
def breadcrumb_and_slug(spark, sf):
    parents = F.coalesce(F.slice(F.split("breadcrumb_text", " > "), 1, 2), F.array().cast("array<string>"))
    made = text.breadcrumb(F.col("source_title"), parents)
    return results(spark, sf).select("doc_id", *[c.alias(k) for k, c in made.items()], text.slug(F.col("source_title")).alias("slug"))


@query("text_semantic_gate", rf"""WITH {R} SELECT doc_id, length(text) < 100 OR len({WORDS}) < 20 OR length(text) - length(replace(text, chr(10), '')) < 3 OR is_excel_sheet AS skip_semantics FROM results""")
def semantic_gate(spark, sf):
    return results(spark, sf).select("doc_id", text.skip_semantics(F.col("text"), F.col("is_excel_sheet")).alias("skip_semantics"))


@query("text_redaction", r"""SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '(?i)\b(password|secret|token|api_?key)("?\s*[:=]\s*"?)([^\s"'',;]+)', '\1\2***', 'g')) AS digest FROM documents""")
def redaction(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(text.redact(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("digest"))


@query("text_code_complexity", rf"""SELECT page_id, CAST(1 + len(regexp_extract_all(html, '\b(if|elif|else|for|while|case|catch|except|and|or)\b')) AS BIGINT) AS complexity,
 round(len(list_filter(string_split(html, chr(10)), s -> trim(s) <> '')) / len(string_split(html, chr(10))), 4) AS line_density,
 round(greatest(0.0, least(100.0, (171 - 5.2 * ln(greatest(len(list_filter(regexp_split_to_array(html, '[ \t\n\x0B\f\r]+'), w -> w <> '')), 1)) - 0.23 * (1 + len(regexp_extract_all(html, '\b(if|elif|else|for|while|case|catch|except|and|or)\b')))
 - 16.2 * ln(greatest(len(list_filter(string_split(html, chr(10)), s -> trim(s) <> '')), 1))) * 100 / 171)), 3) AS maintainability FROM pages""")
def code_complexity(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", *[c.alias(k) for k, c in text.complexity(F.col("html")).items()])


@query("chunk_contextual_prefix", f"""WITH {R} SELECT doc_id, '[' || concat_ws(' | ', 'Source: '||source_type, 'Title: '||source_title, CASE WHEN project_id IS NOT NULL THEN 'Project: '||project_id END) || ']' AS prefix FROM results""")
def contextual_prefix(spark, sf):
    return results(spark, sf).select("doc_id", chunking.contextual_prefix(F.col("source_type"), F.col("source_title"), F.col("project_id")).alias("prefix"))


@query("chunk_paragraphs", rf"""WITH {R}, p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM results),
 k AS (SELECT doc_id, trim(p, ' ') AS p, i FROM p WHERE trim(p, ' ') <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS position, p AS paragraph FROM k""")
def paragraphs(spark, sf):
    return chunking.paragraphs(results(spark, sf), "doc_id", "text", "\n")


@query("chunk_count_estimate", f"""WITH {R} SELECT doc_id, CAST(least(500, greatest(1, ceil(length(text) / 1300.0))) AS BIGINT) AS chunks FROM results""")
def chunk_count_estimate(spark, sf):
    return results(spark, sf).select("doc_id", chunking.estimated_chunks(F.col("text")).alias("chunks"))


_MD = "concat('# ', source_title, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('## A', chr(10), text, chr(10), '## B', chr(10), '## C', chr(10), 'x') WHEN doc_id % 3 = 1 THEN concat('# Two', chr(10), text, chr(10), '# Three') ELSE concat('### deep', chr(10), text) END)"


@query("chunk_markdown_headers", rf"""WITH {R}, m AS (SELECT doc_id, is_excel_sheet, {_MD} AS md FROM results), h AS (SELECT doc_id, is_excel_sheet,
 {', '.join(f"CAST(len(regexp_extract_all(md, '(?m)^#{{{k}}}[ \t]+[^ \t\n].*$')) AS BIGINT) AS h{k}" for k in range(1, 7))} FROM m)
SELECT doc_id, h1, h2, h3, h4, h5, h6, CASE WHEN is_excel_sheet THEN CASE WHEN h3 > 0 THEN '1,2,3' ELSE '1,2' END WHEN h1 = 1 AND h2 >= 3 THEN '1,2' WHEN h1 >= 3 THEN '1' WHEN h1 = 0 AND h2 = 0 AND h3 > 0 THEN CASE WHEN h4 > 0 THEN '3,4' ELSE '3' END ELSE '1,2' END AS levels FROM h""")
def markdown_headers(spark, sf):
    md = F.expr(_MD.replace("chr(10)", "'\\n'"))
    return chunking.header_histogram(results(spark, sf).select("doc_id", "is_excel_sheet", md.alias("md")), "md", F.col("is_excel_sheet")).drop("md", "is_excel_sheet")


@query("chunk_markdown_sections", rf"""WITH {R}, m AS (SELECT doc_id, string_split({_MD}, chr(10)) AS l FROM results), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM m),
 g AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}[ \t]+[^ \t]') THEN length(regexp_extract(line, '^#+')) END AS lvl, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \t]+[^ \t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM x),
 s AS (SELECT doc_id, section, max(lvl) AS level, max(CASE WHEN lvl IS NOT NULL THEN trim(regexp_replace(line, '^#+', ''), ' ') END) AS title, CAST(count(*) - count(lvl) AS BIGINT) AS body_lines FROM g GROUP BY doc_id, section)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(level AS BIGINT) AS level, title, body_lines, lag(title) OVER w AS previous, lead(title) OVER w AS next,
 CAST((SELECT count(*) FROM s t WHERE t.doc_id = s.doc_id AND t.level = s.level AND t.section <> s.section) AS BIGINT) AS same_level FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY section)""")
def markdown_sections(spark, sf):
    md = F.expr(_MD.replace("chr(10)", "'\\n'"))
    return chunking.section_navigation(chunking.markdown_lines(results(spark, sf).select("doc_id", md.alias("md")), "doc_id", "md"), "doc_id")


@query("chunk_block_types", rf"""WITH {R}, p AS (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS line FROM results)
SELECT doc_id, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+') THEN 'header' WHEN regexp_matches(line, '^(```|    )') THEN 'code' WHEN regexp_matches(line, '^\s*([*+-]|[0-9]+\.)\s+') THEN 'list' WHEN regexp_matches(line, '\|') THEN 'table' WHEN regexp_matches(line, '^\s*>') THEN 'quote' ELSE 'paragraph' END AS block, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def block_types(spark, sf):
    md = F.expr(_MD.replace("chr(10)", "'\\n'"))
    lines = results(spark, sf).select("doc_id", F.explode(F.split(md, "\n")).alias("line"))
    return lines.groupBy("doc_id", chunking.block_type(F.col("line")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("chunk_cost_classes", f"""WITH {R} SELECT CASE WHEN length(text) < 1000 THEN 'tiny' WHEN length(text) < 10000 THEN 'small' WHEN length(text) < 50000 THEN 'medium' ELSE 'large' END AS size_class, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(CASE WHEN length(text) < 1000 THEN 30 WHEN length(text) < 10000 THEN 60 WHEN length(text) < 50000 THEN 120 ELSE 240 END * CASE WHEN file_type IN ('md', 'py') THEN 2 ELSE 1 END) AS BIGINT) AS seconds FROM results GROUP BY 1""")
def cost_classes(spark, sf):
    r = results(spark, sf).select(chunking.cost(F.col("text"), F.col("file_type")).alias("c"))
    return r.groupBy(F.col("c.size_class").alias("size_class")).agg(F.count(F.lit(1)).alias("n"), F.sum("c.seconds").alias("seconds"))


@query("chunk_documents_text")
def chunk_documents(spark, sf):
    return chunking.chunk(results(spark, sf).select("document_id", F.lit("text").alias("content_type"), "text"), "document_id", "text", most=None)


@query("chunk_json_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events""")
def json_props(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.parse_json("props"))
    return e.select("event_id", F.variant_get("v", "$.k", "long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("chunk_json_profile", """SELECT event_id, 1 AS depth, CAST(1 + len(json_keys(props)) AS BIGINT) AS elements, round(1 + 0.05::DOUBLE * len(json_keys(props)), 6) AS complexity, CAST(1 AS INTEGER) AS objects, CAST(len(json_keys(props)) AS INTEGER) AS numbers FROM events""")
def json_profile(spark, sf):
    from lodestone.functions.json_profile import profile

    p = profile(table(spark, sf, "events"), "event_id", F.col("props"))
    return p.select("event_id", "depth", "elements", F.round("complexity", 6).alias("complexity"), F.col("types")["object"].alias("objects"), F.col("types")["number"].alias("numbers"))
