"""Fusion, boosting and ranking of retrieval lists (query_id, doc_id, score, rank)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, FEW, BOOST_CAP = 60, 10, 0.5


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """First rank of each key in each list, by score, then key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    r = hits.withColumn("rank", F.row_number().over(w))
    return r.groupBy("query_id", key).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))


def merge(vector: DataFrame, keyword: DataFrame, key: str = "doc_id") -> DataFrame:
    v = ranked(vector, key).select("query_id", key, F.col("rank").alias("vr"), F.col("score").alias("vs"))
    k = ranked(keyword, key).select("query_id", key, F.col("rank").alias("kr"), F.col("score").alias("ks"))
    return v.join(k, ["query_id", key], "full_outer")


def wrrf(vector: DataFrame, keyword: DataFrame, wv: float, wk: float, key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of w / (k + rank)."""
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    return merge(vector, keyword, key).select("query_id", key, F.coalesce("vs", F.lit(0.0)).alias("vs"), F.coalesce("ks", F.lit(0.0)).alias("ks"), (part(wv, "vr") + part(wk, "kr")).alias("score"))


def combined(vector: DataFrame, keyword: DataFrame, wv: float, wk: float, least: float, key: str = "doc_id") -> DataFrame:
    """WRRF where a query has ``FEW`` keys or more, else the weighted sum; below its mode's threshold a hit drops out."""
    both = wrrf(vector, keyword, wv, wk, key).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    linear = wv * F.col("vs") + wk * F.col("ks")
    fused = F.col("n") >= FEW
    score, floor = F.when(fused, F.col("score")).otherwise(linear), F.when(fused, F.lit(least * (wv + wk) / (RRF_K + 1))).otherwise(F.lit(least))
    out = both.withColumn("mode", F.when(fused, "wrrf").otherwise("linear")).withColumn("_floor", floor).withColumn("score", F.round(score, 9))
    return out.where(F.col("score") > F.col("_floor")).select("query_id", key, "mode", "score")


def combined_each(vector: DataFrame, keyword: DataFrame, weights: DataFrame, key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """``combined`` with weights and threshold of each query: ``weights`` is (query_id, wv, wk, least)."""
    part = lambda w, r: F.coalesce(F.col(w) / (k + F.col(r)), F.lit(0.0))
    both = merge(vector, keyword, key).join(weights, "query_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    fused = F.col("n") >= FEW
    linear = F.col("wv") * F.coalesce("vs", F.lit(0.0)) + F.col("wk") * F.coalesce("ks", F.lit(0.0))
    score = F.round(F.when(fused, part("wv", "vr") + part("wk", "kr")).otherwise(linear), 9)
    floor = F.when(fused, F.col("least") * (F.col("wv") + F.col("wk")) / (k + 1)).otherwise(F.col("least"))
    out = both.withColumn("mode", F.when(fused, "wrrf").otherwise("linear")).withColumn("score", score)
    return out.where(F.col("score") > floor).select("query_id", key, "mode", "score")


def boost(preferences: dict[str, float] | None = None, confidence: float = 0.0, context: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> Column:
    """The factor by which metadata raise a score, 0.5 at most."""
    yes = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    parts = [F.lit(confidence * 0.05)]
    for source, w in (preferences or {}).items():
        parts.append(yes(F.col("source_type") == source, (w - 1) * 0.2))
    prefers = {"code": yes(F.col("has_code_blocks"), 0.15), "tables": yes(F.col("has_tables"), 0.12), "images": yes(F.col("has_images"), 0.10), "docs": yes(~F.col("has_code_blocks"), 0.08)}
    parts += [prefers[c] for c in context]
    parts.append(yes(F.col("section_level") <= 2, 0.10) + yes(F.col("section_level") == 3, 0.05))
    parts.append(yes(F.col("word_count") > 100, 0.05) + yes(F.col("word_count") > 500, 0.05))
    parts.append(yes(F.col("is_converted") & F.col("file_type").isin("docx", "xlsx", "pdf"), 0.08))
    if any(k in " ".join(keywords) for k in ("data", "table", "sheet", "excel", "csv")):
        parts.append(yes(F.col("is_excel_sheet"), 0.12))
    if keywords:
        low = F.array(*[F.lit(k.lower()) for k in keywords])
        parts.append(yes(F.arrays_overlap(F.transform("entities", F.lower), low), 0.10) + yes(F.arrays_overlap(F.transform("topics", F.lower), low), 0.08))
    return F.least(F.lit(BOOST_CAP), reduce(lambda a, b: a + b, parts))


#: Words of a business text, and of a procedural section.
BUSINESS = ("requirement", "business", "strategy", "goal", "objective", "process")
PROCEDURES = ("step", "guide", "procedure", "tutorial")


def content_filter(kinds: tuple[str, ...]) -> Column:
    """Rows whose content is of one of the kinds code, documentation, business or guide."""
    title = F.lower("source_title")
    tests = {
        "code": F.col("has_code_blocks"),
        "documentation": ~F.col("has_code_blocks"),
        "business": reduce(lambda a, b: a | b, [title.contains(w) | F.lower("text").contains(w) for w in BUSINESS]),
        "guide": reduce(lambda a, b: a | b, [F.lower("section_type").contains(w) for w in PROCEDURES]),
    }
    return reduce(lambda a, b: a | b, [tests[k] for k in kinds], F.lit(False))


def chosen_title() -> Column:
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(full(F.col("source_title")), full(F.col("section_type")), F.when(F.col("file_name").isNotNull(), F.concat("file_name", F.lit(" - Chunk "), (F.col("chunk_index") + 1).cast("string"))), F.element_at(F.split("source", "/"), -1), F.lit("Untitled"))


# What a hit's merged metadata take from the payload's root and from its nested metadata (the first that is there,
# an empty text or a count of 0 giving way to the next), defaults, and parts of keys whose values are not shown.
ROOT_FIELDS = {"source_url": "url", "document_id": "document_id", "created_at": "created_at", "last_modified": "updated_at", "repo_name": "source", "project_id": "source"}
NESTED_FIELDS = {
    "original_filename": ("file_name",), "file_size": ("file_size",), "original_file_type": ("file_type", "original_file_type"), "word_count": ("word_count",),
    "char_count": ("character_count", "char_count", "line_count"), "chunk_index": ("sub_chunk_index",), "total_chunks": ("total_sub_chunks",),
    "chunking_strategy": ("chunking_strategy", "conversion_method"), "collection_name": ("collection_name",), "section_title": ("section_title",),
    "parent_section": ("parent_section",), "file_encoding": ("file_encoding",), "conversion_failed": ("conversion_failed",), "is_excel_sheet": ("is_excel_sheet",),
}
NESTED_DEFAULTS = {"conversion_failed": "false", "is_excel_sheet": "false"}
SENSITIVE, HIDDEN = ("password", "secret", "token", "api_key", "apikey"), "[REDACTED]"


def merged_metadata(info: Column, metadata: Column, components: Column, chunk_index: Column, total_chunks: Column) -> Column:
    """map<string,string>: a hit's metadata from its payload's root, its nested metadata (maps of text) and its components (an array of maps).

    Later ones win: root, nested fields that are there, components in order. A component's keys with a leading underscore
    stay out and values of sensitive keys are hidden. Null maps are empty; a field that the root lacks is the empty text.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    info, metadata = F.coalesce(info, none), F.coalesce(metadata, none)
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    told = lambda k: F.when(~at(metadata, k).isin("", *(["0"] if k.endswith("count") else [])), at(metadata, k))
    name, folder = told("file_name"), told("file_directory")
    root = {k: F.coalesce(at(info, v), F.lit("")) for k, v in ROOT_FIELDS.items()}
    root["file_path"] = F.coalesce(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), name), at(metadata, "file_name"), F.lit(""))
    # Of several fields the first that tells something, or else the last.
    nested = {k: F.coalesce(*[told(v) for v in of[:-1]], at(metadata, of[-1])) for k, of in NESTED_FIELDS.items()}
    for k, value in (("chunk_index", chunk_index.cast("string")), ("total_chunks", total_chunks.cast("string")), *((k, F.lit(v)) for k, v in NESTED_DEFAULTS.items())):
        nested[k] = F.coalesce(nested[k], value)
    built = lambda fields: F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*fields.values()))
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    secret = lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(w) for w in SENSITIVE])
    shown = lambda c: F.transform_values(F.map_filter(c, lambda k, _: ~k.startswith("_")), lambda k, v: F.when(secret(k), F.lit(HIDDEN)).otherwise(v))
    own = over(built(root), F.map_filter(built(nested), lambda _, v: v.isNotNull()))
    return F.aggregate(F.coalesce(components, F.array().cast("array<map<string,string>>")), own, lambda m, c: over(m, shown(F.coalesce(c, none))))


def linear_scores(df: DataFrame, wv: float, wk: float, wm: float) -> DataFrame:
    """Weighted sum of three scores, divided by the query's largest."""
    raw = df.withColumn("raw", wv * F.col("vs") + wk * F.col("ks") + wm * F.col("ms"))
    top = F.max("raw").over(Window.partitionBy("query_id"))
    return raw.withColumn("score", F.when(top > 0, F.round(F.col("raw") / top, 9)).otherwise(F.lit(0.0)))


def min_max(df: DataFrame, column: str, by: str) -> DataFrame:
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn("scaled", F.when(high > low, F.round((F.col(column) - low) / (high - low), 9)).otherwise(F.lit(0.0)))


def deduplicate(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = df.where(F.col(key).isNotNull()).withColumn("_first", first).where("_first = 1").drop("_first")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def diversify(hits: DataFrame, factor: float, limit: int) -> DataFrame:
    """Greedy: repeated source types, section types and sources cost; taken while under 70 % full or little is lost."""
    schema = hits.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable")
        seen: dict[tuple[str, object], int] = {}
        taken, left = [], []
        for at, r in zip(pdf.index, pdf.to_dict("records"), strict=True):
            marks = [("source_type", 0.3), ("section_type", 0.2), ("source", 0.4)]
            worth = 1 - factor * sum(w for k, w in marks if (k, r[k]) in seen)
            if len(taken) < limit and (len(taken) < 0.7 * limit or worth >= 0.6):
                taken.append(at)
                for k, _ in marks:
                    seen[(k, r[k])] = 1
            else:
                left.append(at)
        return pdf.loc[[*taken, *left[: limit - len(taken)]]]

    return hits.groupBy("query_id").applyInPandas(pick, schema)


def rerank(hits: DataFrame, query: Column, text: Column, top: int) -> DataFrame:
    """The default re-ranker: share of the query's words in the first 1,000 characters; blank texts drop out."""
    t = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0)))
    score = F.round(F.size(F.array_intersect(t(query), t(F.substring(text, 1, 1000)))) / F.greatest(F.size(t(query)), F.lit(1)), 6)
    out = hits.where(F.trim(text) != "").withColumn("rerank_score", score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)
