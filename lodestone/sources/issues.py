"""Issue trackers and wikis: predicates to push down, rich text, and page hierarchies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.storage import cut


def issue_filter(project: str, types: tuple[str, ...] = (), statuses: tuple[str, ...] = (), since=None) -> Column:
    """project AND type IN AND status IN AND updated >= since: as a predicate, so a source can take it over."""
    out = F.col("project") == project
    if types:
        out &= F.col("issue_type").isin(*types)
    if statuses:
        out &= F.col("status").isin(*statuses)
    return out if since is None else out & (F.col("updated") >= F.lit(since))


def issue_query(project: str, types: tuple[str, ...] = (), statuses: tuple[str, ...] = (), since: str | None = None) -> str:
    """The same in a tracker's own words, quotes escaped."""
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    parts = [f"project = {q(project)}"]
    if types:
        parts.append(f"type IN ({', '.join(map(q, types))})")
    if statuses:
        parts.append(f"status IN ({', '.join(map(q, statuses))})")
    if since:
        parts.append(f"updated >= {q(since)}")
    return " AND ".join(parts)


def flat_text(node) -> str:
    """Rich text as one line: the texts of a tree in order."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return " ".join(t for n in node if (t := flat_text(n)))
    if isinstance(node, dict):
        own = [node["text"]] if isinstance(node.get("text"), str) else []
        return " ".join(t for t in [*own, flat_text(node.get("content", []))] if t)
    return ""


def rich_text(column: Column) -> Column:
    """The flat text of a JSON tree column; what does not parse stays as it is."""

    @F.pandas_udf("string")
    def of(raw: pd.Series) -> pd.Series:
        def one(s):
            try:
                return " ".join(flat_text(json.loads(s)).split())
            except (TypeError, ValueError):
                return s

        return raw.map(one)

    return of(column)


def breadcrumbs(pages: DataFrame, key: str, parent: str, title: str, cut=cut) -> DataFrame:
    """(key, breadcrumb, depth) by walking to the root: one join per level, each written, until no row has a parent left.

    A path ends where a parent is missing, and before a page that it already holds: so pages of a cycle, and those
    below one, begin their path at the page of the cycle that would come next but one time round.
    """
    up = cut(pages.select(F.col(key).alias("_k"), F.col(parent).alias("_next"), F.col(title).alias("_title")), "pages")
    at = pages.select(F.col(key).alias("_key"), F.col(parent).alias("_up"), F.array(title).alias("_path"), F.array(key).alias("_seen"))
    done = []
    while True:
        open_ = F.col("_up").isNotNull() & ~F.array_contains("_seen", F.col("_up"))
        at = cut(at.withColumn("_open", F.coalesce(open_, F.lit(False))), "breadcrumbs")
        done.append(at.where("NOT _open").select("_key", "_path"))
        rest = at.where("_open")
        if not rest.limit(1).count():
            break
        seen = F.when(F.col("_k").isNotNull(), F.concat("_seen", F.array("_k"))).otherwise(F.col("_seen"))
        path = F.when(F.col("_title").isNotNull(), F.concat(F.array("_title"), "_path")).otherwise(F.col("_path"))
        at = rest.join(up, F.col("_up") == F.col("_k"), "left").select("_key", F.col("_next").alias("_up"), path.alias("_path"), seen.alias("_seen"))
    all_ = reduce(DataFrame.unionByName, done)
    return all_.select(F.col("_key").alias(key), F.array_join("_path", " > ").alias("breadcrumb"), F.size("_path").cast("long").alias("depth"))


# --- Connector contract ----------------------------------------------------------------------------


class _Page(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    """One partition per page range of a paged service, so a lost executor repeats only its pages."""

    def __init__(self, schema, options):
        self.total, self.page = int(options.get("total", "100")), int(options.get("page", "25"))

    def partitions(self):
        return [_Page(k, min(k + self.page, self.total)) for k in range(0, self.total, self.page)]

    def read(self, partition) -> Iterator[tuple]:
        for k in range(partition.start, partition.end):
            yield (f"ISSUE-{k}", f"Issue {k}", ("open", "done")[k % 2])


class PagedIssues(DataSource):
    """``spark.read.format("paged_issues")``: the shape of a tracker's connector, over generated issues."""

    @classmethod
    def name(cls):
        return "paged_issues"

    def schema(self):
        return "key string, title string, status string"

    def reader(self, schema):
        return PagedReader(schema, self.options)


#: (source type, deployment) -> data source. An unknown pair is an error.
REGISTRY: dict[tuple[str, str], type[DataSource]] = {("jira", "cloud"): PagedIssues, ("jira", "datacenter"): PagedIssues}


def connector(source_type: str, deployment: str) -> type[DataSource]:
    try:
        return REGISTRY[(source_type, deployment)]
    except KeyError:
        raise ValueError(f"no connector for {source_type} ({deployment})") from None
