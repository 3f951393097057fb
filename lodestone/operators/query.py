"""Query understanding: field syntax, predicates, context, expansion and intent."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The searchable fields, those compared as numbers, and the shape of a field query.
FIELDS = (
    "document_id", "source_type", "source", "project_id", "title", "url", "file_path", "file_name", "file_type", "collection_name",
    "chunk_index", "total_chunks", "chunking_strategy", "original_file_type", "conversion_method",
)
NUMERIC = ("chunk_index", "total_chunks")
FIELD_QUERY = r'(\w+):(?:"([^"]+)"|([^\s]+))'


@dataclass(frozen=True)
class ParsedQuery:
    fields: tuple[tuple[str, str], ...]
    text: str

    @property
    def filter_only(self) -> bool:
        """Exact predicates suffice: there are some, and no text or a document is named."""
        return bool(self.fields) and (not self.text or any(k == "document_id" for k, _ in self.fields))


def parse(query: str) -> ParsedQuery:
    """Field queries of known fields; anything else stays in the text, white space collapsed."""
    fields, rest, at = [], [], 0
    for m in re.finditer(FIELD_QUERY, query):
        if m[1] in FIELDS:
            fields.append((m[1], m[2] or m[3]))
            rest.append(query[at : m.start()])
            at = m.end()
    return ParsedQuery(tuple(fields), " ".join("".join([*rest, query[at:]]).split()))


def predicate(parsed: ParsedQuery, projects: tuple[str, ...] = (), columns: dict[str, str] | None = None) -> Column:
    """AND of equalities; project ids match the project or the source unless a project is asked for."""
    name = lambda k: F.col((columns or {}).get(k, k))
    tests = [name(k) == (int(v) if k in NUMERIC and v.lstrip("-").isdigit() else v) for k, v in parsed.fields]
    if projects and not any(k == "project_id" for k, _ in parsed.fields):
        tests.append(name("project_id").isin(*projects) | name("source").isin(*projects))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def parse_table(queries: DataFrame, text: str) -> DataFrame:
    """The batch form of ``parse``: adds ``fields`` (array of field:value) and ``clean``."""
    known = rf'\b(?:{"|".join(FIELDS)}):(?:"[^"]+"|[^\s"]+)'
    found = F.regexp_extract_all(text, F.lit(known), F.lit(0))
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, known, " "), r"\s+", " "))
    return queries.withColumn("fields", F.transform(found, lambda f: F.replace(f, F.lit('"'), F.lit("")))).withColumn("clean", clean)


# Words that tell what kind of content a question prefers.
PREFERENCES = {
    "prefers_code": ("code", "function", "implementation", "script", "method"),
    "prefers_tables": ("table", "data", "list", "comparison"),
    "prefers_images": ("image", "diagram", "screenshot", "visual"),
    "prefers_docs": ("documentation", "docs", "guide", "manual"),
}
QUESTION_WORDS = ("what", "how", "why", "when", "who", "where", "which", "can", "does", "is", "are")


def context(query: Column) -> dict[str, Column]:
    low = F.lower(query)
    n = F.size(F.filter(F.split(F.trim(low), r"\s+"), lambda w: w != ""))
    out = {"is_question": query.contains("?") | low.rlike(rf"^\s*({'|'.join(QUESTION_WORDS)})\b"), "is_broad": n < 5, "is_specific": n > 7}
    out |= {k: low.rlike(rf"\b({'|'.join(w)})\b") for k, w in PREFERENCES.items()}
    return out


#: Synonyms for expansion where no analyser is at hand; the first key found counts.
SYNONYMS = (
    ("requirements", "specs requirements specification"),
    ("architecture", "architecture design structure"),
    ("ui", "ui ux interface"),
    ("api", "api endpoint service"),
    ("database", "database storage schema"),
    ("security", "security auth access"),
)


def expand(query: Column) -> Column:
    out = query
    for k, v in reversed(SYNONYMS):
        out = F.when(F.lower(query).contains(k), F.concat(query, F.lit(" " + v))).otherwise(out)
    return out


@dataclass(frozen=True)
class Intent:
    name: str
    keywords: tuple[str, ...]
    weight: float = 1.0


INTENTS = (
    Intent("technical_lookup", ("api", "function", "code", "implementation", "endpoint", "error"), 1.2),
    Intent("procedural", ("how", "guide", "steps", "tutorial", "setup", "install")),
    Intent("business_context", ("requirements", "strategy", "business", "goals", "stakeholder")),
    Intent("troubleshooting", ("error", "fix", "problem", "issue", "debug", "fail"), 1.1),
    Intent("informational", ("what", "overview", "explain", "definition", "introduction"), 0.9),
)


def intents(queries: DataFrame, key: str, text: str, least: float = 0.3) -> DataFrame:
    """(key, primary, confidence, secondary): scores are weighted shares of matched keywords, the highest wins."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    listed = F.array(*[F.struct(F.lit(i.name).alias("intent"), F.array(*[F.lit(k) for k in i.keywords]).alias("words"), F.lit(i.weight).alias("weight")) for i in INTENTS])
    scored = queries.select(key, w.alias("w"), F.explode(listed).alias("i"))
    score = F.round(F.size(F.array_intersect("w", "i.words")) / F.size("i.words") * F.col("i.weight"), 6)
    by = Window.partitionBy(key)
    ranked = scored.select(key, F.col("i.intent").alias("intent"), score.alias("score")).withColumn("top", F.max("score").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "intent")))
    first = F.max(F.when(F.col("rank") == 1, F.when(F.col("top") < least, "general").otherwise(F.col("intent"))))
    second = F.array_sort(F.collect_list(F.when((F.col("rank").between(2, 4)) & (F.col("score") > 0) & (F.col("score") >= 0.3 * F.col("top")), F.col("intent"))))
    return ranked.groupBy(key).agg(first.alias("primary"), F.max("top").alias("confidence"), F.concat_ws(",", second).alias("secondary"))


@dataclass(frozen=True)
class SearchConfig:
    """How a search runs; ``adapt`` gives a new one, so one query never changes another's."""

    vector_weight: float = 0.6
    keyword_weight: float = 0.3
    metadata_weight: float = 0.1
    min_score: float = 0.3
    max_results: int = 20
    expand: bool = True
    diversity: float = 0.0
    source_preferences: dict[str, float] = field(default_factory=dict)


BY_INTENT = {
    "technical_lookup": SearchConfig(0.7, 0.3, source_preferences={"git": 1.4, "confluence": 1.2}),
    "business_context": SearchConfig(0.5, 0.4, diversity=0.2, source_preferences={"confluence": 1.3, "jira": 1.2}),
    "procedural": SearchConfig(0.6, 0.3, source_preferences={"publicdocs": 1.2}),
    "troubleshooting": SearchConfig(0.6, 0.4, source_preferences={"jira": 1.3, "git": 1.1}),
}


def adapt(intent: str, confidence: float, n_words: int) -> SearchConfig:
    base = BY_INTENT.get(intent, SearchConfig())
    if confidence < 0.5:
        base = replace(base, max_results=base.max_results + 5, diversity=min(1.0, base.diversity + 0.1))
    if n_words <= 2:
        base = replace(base, keyword_weight=min(1.0, base.keyword_weight + 0.1))
    return base


def configs(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """``adapt`` for a batch: (key, intent, confidence, wv, wk, least, most, expand, diversity, preferences), a row a query."""
    known = [("", SearchConfig()), *BY_INTENT.items()]
    n = queries.select(key, F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")).alias("_n"))
    i = intents(queries.withColumn("_t", F.coalesce(text, F.lit(""))), key, "_t").join(n, key)

    def of(value) -> Column:
        out = value(known[0][1])
        for name, c in known[1:]:
            out = F.when(F.col("primary") == name, value(c)).otherwise(out)
        return out

    unsure, short = F.col("confidence") < 0.5, F.col("_n") <= 2
    preferred = lambda c: F.map_from_arrays(F.array(*[F.lit(s) for s in c.source_preferences]).cast("array<string>"), F.array(*[F.lit(w) for w in c.source_preferences.values()]).cast("array<double>"))
    wk, most, diversity = of(lambda c: F.lit(c.keyword_weight)), of(lambda c: F.lit(c.max_results)), of(lambda c: F.lit(c.diversity))
    return i.select(
        key, F.col("primary").alias("intent"), "confidence", of(lambda c: F.lit(c.vector_weight)).alias("wv"), F.when(short, F.least(F.lit(1.0), wk + 0.1)).otherwise(wk).alias("wk"), of(lambda c: F.lit(c.min_score)).alias("least"),
        F.when(unsure, most + 5).otherwise(most).alias("most"), of(lambda c: F.lit(c.expand)).alias("expand"), F.round(F.when(unsure, F.least(F.lit(1.0), diversity + 0.1)).otherwise(diversity), 6).alias("diversity"), of(preferred).alias("preferences"),
    )
