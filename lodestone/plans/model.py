"""The driver tables seen through the engine's data model, in Spark and as SQL for the oracle.

``results`` turns each row of ``documents`` into one retrieval result: the text
is the table's, the metadata are closed forms of the id, so every operator can be
checked exactly and no group grows with the table unless the model says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import table

TITLES = (
    "Requirements Specification", "Architecture Design", "API Implementation", "Security Audit Policy", "Testing Plan", "How-to Tutorial", "Reference Manual", "Sample Demo",
    "User Story Epic", "System Overview", "Business Case Strategy", "Deployment Process", "Performance Optimization", "Login Authentication Guide", "Data Migration Notes", "General Notes",
)
SOURCE_TYPES = ("confluence", "git", "jira", "localfile", "publicdocs")
EXTENSIONS = ("pdf", "docx", "xlsx", "md", "py", "png")
SECTION_TYPES = ("h1", "h2", "guide", "paragraph")


def _pick(values: tuple[str, ...], n: str) -> tuple[str, str]:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST({n} % {len(values)} AS INT) + 1)", f"([{listed}])[{n} % {len(values)} + 1]"


def _div(a: str, b: int) -> tuple[str, str]:
    return f"({a} div {b})", f"({a} // {b})"


def _same(x: str) -> tuple[str, str]:
    return x, x


def _str(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _list(*pairs: tuple[str, str]) -> tuple[str, str]:
    return "array(" + ", ".join(p[0] for p in pairs) + ")", "[" + ", ".join(p[1] for p in pairs) + "]"


def _named(prefix: str, pair: tuple[str, str]) -> tuple[str, str]:
    return f"concat('{prefix}', {_str(pair[0])})", f"concat('{prefix}', {_str(pair[1])})"


_TITLE = tuple(f"concat({p}, ' ', {_str(d)})" for p, d in zip(_pick(TITLES, "doc_id"), _div("doc_id", 16), strict=True))
_CRUMB = tuple(f"CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('Area ', {_str('doc_id % 6')}, ' > Team ', {_str(d)}, ' > ', {t}) END" for d, t in zip(_div("doc_id", 8), _TITLE, strict=True))
_PARENT = "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id - doc_id % 4 END"

#: name -> (Spark SQL, DuckDB SQL)
COLUMNS: dict[str, tuple[str, str]] = {
    "doc_id": _same("doc_id"),
    "document_id": _named("doc-", _same("doc_id")),
    "text": _same("coalesce(text, '')"),
    "source_type": _pick(SOURCE_TYPES, "doc_id"),
    "source": _same("source"),
    "project_id": _same("CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END"),
    "source_title": _TITLE,
    "source_url": _same(f"concat('https://host', {_str('doc_id % 10')}, '.example.com/docs/', {_str('doc_id')}, CASE WHEN doc_id % 3 = 1 THEN '/' WHEN doc_id % 3 = 2 THEN '?q=1#frag' ELSE '' END)"),
    "entities": _list(_named("Entity ", _div("doc_id", 4)), _named("Entity ", _div("(doc_id + 2)", 6)), _named("Org ", _div("doc_id", 9))),
    "topics": _list(_named("topic ", _div("doc_id", 5)), _named("topic ", _div("(doc_id + 1)", 3)), _named("theme ", _div("doc_id", 7))),
    "has_code_blocks": _same("doc_id % 4 = 0"),
    "has_tables": _same("doc_id % 5 = 0"),
    "has_images": _same("doc_id % 6 = 0"),
    "has_links": _same("doc_id % 3 = 0"),
    "is_attachment": _same("doc_id % 8 = 0"),
    "is_converted": _same("doc_id % 7 < 2"),
    "is_excel_sheet": _same("doc_id % 6 = 2"),
    "depth": _same("CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id % 7 + 1 END"),
    "read_time": _same("doc_id % 15 + 1"),
    "word_count": _same("CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (doc_id % 10 + 1) * 100 END"),
    "section_level": _same("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 5 + 1 END"),
    "section_type": _pick(SECTION_TYPES, "doc_id"),
    "breadcrumb_text": (_CRUMB[0], _CRUMB[1]),
    "parent_id": _same(f"CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('doc-', {_str('doc_id - doc_id % 4')}) END"),
    "created_day": _same("doc_id * 37 % 900"),
    "file_name": tuple(f"concat('file_', {_str('doc_id')}, '.', {p})" for p in _pick(EXTENSIONS, "doc_id")),  # type: ignore[dict-item]
    "file_type": _pick(EXTENSIONS, "doc_id"),
    "file_size": _same("CASE WHEN doc_id % 23 = 0 THEN NULL ELSE n_chars * 10 END"),
    "author": _same(f"concat('author ', {_str('doc_id % 9')})"),
    "chunk_index": _same("doc_id % 4"),
    "group_id": _div("doc_id", 4),
}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{s} AS {name}" for name, (s, _) in COLUMNS.items()])


def results_sql(name: str = "results") -> str:
    """``name AS (...)``, for a WITH clause."""
    return f"{name} AS (SELECT {', '.join(f'{d} AS {n}' for n, (_, d) in COLUMNS.items())} FROM documents)"


R = results_sql()
