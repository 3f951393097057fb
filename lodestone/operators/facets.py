"""Facets, hierarchy and attachment views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The facets with their most values, in order of priority.
FACETS = {
    "content_type": 10, "project": 15, "has_features": 8, "entities": 20, "topics": 15, "read_time": 5, "hierarchy_depth": 5, "file_type": 10, "section_type": 15,
    "section_level": 10, "word_count": 5, "attachment_type": 10,
}


def depth_bucket(c: Column) -> Column:
    return F.when(c <= 2, "shallow").when(c <= 4, "medium").when(c.isNotNull(), "deep")


def read_time_bucket(c: Column) -> Column:
    return F.when(c <= 2, "quick").when(c <= 10, "medium").when(c.isNotNull(), "long")


def word_bucket(c: Column) -> Column:
    return F.when(c <= 100, "short").when(c <= 500, "medium").when(c.isNotNull(), "long")


def values() -> dict[str, Column]:
    """facet -> array of a row's values."""
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (x != ""))
    flags = [F.when(F.col(c), n) for c, n in (("has_code_blocks", "code"), ("has_tables", "tables"), ("has_images", "images"), ("has_links", "links"), ("is_attachment", "attachment"))]
    longer = lambda c, n: F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= n)
    return {
        "content_type": one(F.col("source_type")),
        "project": one(F.col("project_id")),
        "has_features": F.filter(F.array(*flags), lambda x: x.isNotNull()),
        "entities": longer("entities", 2),
        "topics": longer("topics", 3),
        "read_time": one(read_time_bucket(F.col("read_time"))),
        "hierarchy_depth": one(depth_bucket(F.col("depth"))),
        "file_type": one(F.col("file_type")),
        "section_type": one(F.col("section_type")),
        "section_level": one(F.when(F.col("section_level").isNotNull(), F.concat(F.lit("level_"), F.col("section_level").cast("string")))),
        "word_count": one(word_bucket(F.col("word_count"))),
        "attachment_type": one(F.when(F.col("is_attachment"), F.col("file_type"))),
    }


def facet_rows(results: DataFrame, *keep: str) -> DataFrame:
    """(facet, value) of every row: one scan, one explode for all facets."""
    each = F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("values")) for k, v in values().items()])
    return results.select(*keep, F.explode(each).alias("f")).select(*keep, F.col("f.facet").alias("facet"), F.explode("f.values").alias("value"))


def facet_counts(results: DataFrame) -> DataFrame:
    """(facet, value, n, rank): a facet's most frequent values."""
    n = facet_rows(results).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    most = F.create_map(*[F.lit(x) for kv in FACETS.items() for x in kv])
    return n.withColumn("rank", rank).where(F.col("rank") <= F.element_at(most, F.col("facet")))


def facet_order(counts: DataFrame) -> DataFrame:
    """Facets by priority, then number of values."""
    priority = F.create_map(*[F.lit(x) for k, f in enumerate(list(FACETS)[:9]) for x in (f, k)])
    f = counts.groupBy("facet").agg(F.count(F.lit(1)).alias("n_values")).withColumn("priority", F.coalesce(F.element_at(priority, F.col("facet")), F.lit(999)).cast("long"))
    return f.withColumn("position", F.row_number().over(Window.orderBy("priority", F.desc("n_values"), "facet")))


def facet_filter(filters: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """AND over facets; within a facet OR, or AND where asked. An unknown facet matches nothing."""
    known = values()

    def test(facet: str, wanted: tuple[str, ...], how: str) -> Column:
        if facet not in known:
            return F.lit(False)
        v, w = known[facet], F.array(*[F.lit(x) for x in wanted])
        return F.size(F.array_except(w, v)) == 0 if how == "AND" else F.arrays_overlap(v, w)

    return reduce(lambda a, b: a & b, [test(f, w, how) for f, (w, how) in filters.items()], F.lit(True))


def refinements(results: DataFrame, used: tuple[str, ...], top: int = 5) -> DataFrame:
    """Values of unused facets that keep some but under 80 % of the results, by how much they cut away."""
    total = F.broadcast(results.agg(F.count(F.lit(1)).alias("total")))
    best = facet_counts(results).where(~F.col("facet").isin(*used) & (F.col("rank") <= 3)).join(total, F.lit(True))
    cut = best.where((F.col("n") > 0) & (F.col("n") < 0.8 * F.col("total")))
    return cut.withColumn("reduction", F.round(100 * (1 - F.col("n") / F.col("total")), 1)).orderBy(F.desc("reduction"), "facet", "value").limit(top)


def coverage(results: DataFrame) -> DataFrame:
    """(facet, percent): share of rows with a value."""
    v = values()
    one = results.agg(*[F.round(100 * F.avg(F.when(F.size(c) > 0, 1.0).otherwise(0.0)), 1).alias(k) for k, c in v.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("percent")) for k in v])).alias("f")).select("f.facet", "f.percent")


def display_name(facet: Column, value: Column) -> Column:
    return F.when(facet.isin("read_time", "hierarchy_depth", "word_count"), F.initcap(value)).when(facet.isin("content_type", "has_features"), F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))).otherwise(value)


def hierarchy_filter(root_only: bool | None = None, depth: int | None = None, parent: str | None = None) -> Column:
    out = F.col("source_type").isin("confluence", "localfile")
    if root_only is not None:
        out &= F.col("parent_id").isNull() if root_only else F.col("parent_id").isNotNull()
    if depth is not None:
        out &= F.col("depth") == depth
    if parent is not None:
        out &= F.col("parent_id") == parent
    return out


def by_hierarchy(results: DataFrame) -> DataFrame:
    """(root, n, deepest, first): results under their first breadcrumb part, else their title."""
    root = F.coalesce(F.get(F.split("breadcrumb_text", " > "), F.lit(0)), F.col("source_title"))
    order = F.struct(F.coalesce("depth", F.lit(0)).alias("d"), F.col("source_title").alias("t"), F.col("doc_id").alias("i"))
    return results.groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.min(order).alias("f")).select("root", "n", "deepest", F.col("f.i").alias("first"))


def attachment_filter(types: tuple[str, ...] = (), least: int | None = None, most: int | None = None, author: str | None = None) -> Column:
    """A row without a size passes the size tests."""
    out = F.col("is_attachment")
    if types:
        out &= F.col("file_type").isin(*types)
    if least is not None:
        out &= F.col("file_size").isNull() | (F.col("file_size") >= least)
    if most is not None:
        out &= F.col("file_size").isNull() | (F.col("file_size") <= most)
    if author is not None:
        out &= F.col("author") == author
    return out


def attachment_like() -> Column:
    """Attachments by flag, file name or an address that ends in an extension."""
    return F.col("is_attachment") | (F.col("file_name").isNotNull() & F.col("file_type").isin("pdf", "docx", "xlsx")) | F.col("source_url").rlike(r"\.[A-Za-z0-9]{2,4}$")


#: Friendly names of attachment types.
FRIENDLY = {"pdf": "PDF Documents", "docx": "Word Documents", "xlsx": "Excel Spreadsheets", "md": "Markdown", "py": "Source Code", "png": "Images"}


def by_attachment_type(results: DataFrame) -> DataFrame:
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FRIENDLY.items() for x in kv]), F.col("file_type")), F.upper("file_type"))
    return results.where(F.col("is_attachment")).groupBy(name.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


def family(results: DataFrame) -> DataFrame:
    """Each row's siblings and children, by counts over the parent."""
    children = results.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    r = results.select("document_id", "parent_id")
    with_siblings = r.join(children.select(F.col("p").alias("parent_id"), F.col("n").alias("s")), "parent_id", "left")
    with_children = with_siblings.join(children.select(F.col("p").alias("document_id"), F.col("n").alias("c")), "document_id", "left")
    return with_children.select("document_id", F.coalesce(F.col("s") - 1, F.lit(0)).cast("long").alias("siblings"), F.coalesce("c", F.lit(0)).cast("long").alias("children"))
