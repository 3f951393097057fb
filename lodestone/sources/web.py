"""Web pages: address rules, links, titles, main content, attachments, and a crawl over a page table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import slices
from lodestone.operators.chunking import html_blocks
from lodestone.sources.files import MIME, glob_pattern
from lodestone.storage import cut

HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""
ATTACHMENTS = ("pdf", "docx", "xlsx", "pptx", "zip", "csv")


def wanted(url: Column, base: str, exclude: tuple[str, ...] = (), pattern: str | None = None) -> Column:
    out = url.startswith(base)
    for g in exclude:
        out &= ~url.rlike(glob_pattern(g))
    return out if pattern is None else out & F.regexp_replace(url, "^[a-z]+://[^/]*", "").rlike(glob_pattern(pattern))


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, link): distinct absolute addresses without fragments, root-relative ones resolved in the plan."""
    found = pages.select(key, url, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)))).alias("href"))
    origin = F.regexp_extract(url, "^([a-z]+://[^/]*)", 1)
    folder = F.regexp_extract(url, "^(.*/)", 1)
    link = F.when(F.col("href").rlike("^[a-z]+:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.concat(folder, "href"))
    return found.select(key, link.alias("link")).distinct()


def resolved(base: str, href: str) -> str:
    """Any relative form, for pages whose links use dots."""
    return urljoin(base, href).split("#")[0]


def title(html: Column) -> Column:
    clean = lambda pattern: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", ""), r"\s+", " "))
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(clean(r"(?is)<title[^>]*>(.*?)</title>")), full(clean(r"(?is)<h1[^>]*>(.*?)</h1>")), F.lit("Untitled Document"))


def content(html: str, drop: tuple[str, ...] = ("nav", "header", "footer", "aside")) -> str:
    """Text of the main part: article or main where there is one, without navigation, code fenced."""
    for tag in drop:
        html = re.sub(rf"(?is)<{tag}\b.*?</{tag}>", " ", html)
    for tag in ("article", "main"):
        m = re.search(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", html)
        if m:
            html = m[1]
            break
    html = re.sub(r"(?is)<pre\b[^>]*>(.*?)</pre>", lambda m: f"<p>```</p><p>{m[1]}</p><p>```</p>", html)
    return "\n".join(body for _, body in html_blocks(html))


def contents(pages: DataFrame, key: str, html: str) -> DataFrame:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for (s,) in slices(batches):
            yield s.fillna("").map(content)

    return pages.select(key, title(F.col(html)).alias("title"), of(html).alias("content"))


def attachment_links(all_links: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("link", r"\.([A-Za-z0-9]+)$", 1))
    return all_links.withColumn("extension", ext).where(F.col("extension").isin(*ATTACHMENTS)).withColumn("mime", F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), F.col("extension")))


def crawl(edges: DataFrame, start: DataFrame, rounds: int, cut=cut) -> DataFrame:
    """(url, depth) breadth first over (url, link): each round only the links not seen yet go on."""
    seen = start.select("url", F.lit(0).cast("long").alias("depth"))
    edge = seen
    for k in range(1, rounds + 1):
        edge = cut(edges.join(edge.select("url"), "url").select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(k).cast("long")))
        seen = seen.unionByName(edge)
    return seen
