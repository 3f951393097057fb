"""File sources: scan, predicate, type detection, conversion, spreadsheets."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import html_blocks

# Media types by extension; what can be converted, and what never is.
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
    "txt": "text/plain", "md": "text/markdown", "py": "text/x-python", "png": "image/png", "jpg": "image/jpeg", "zip": "application/zip",
}
CONVERTIBLE = ("pdf", "docx", "xlsx", "pptx", "html", "htm", "csv", "json", "xml", "png", "jpg")
SKIPPED = ("doc", "ppt")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**`` any path, ``*`` and ``?`` within a part, a closing slash a whole folder."""
    if glob.endswith("/"):
        glob += "**"
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            if k < len(glob) and glob[k] == "/":
                out, k = out + "/?" if out == ".*" else out + "/", k + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c).replace("\\-", "-")
        k += 1
    return f"^{out}$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def accepted(path: Column, size: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), types: tuple[str, ...] = (), most: int | None = None, convert: bool = False) -> Column:
    """Which files to read: no dot-files, not excluded, of a wanted or convertible type, small enough, included."""
    name = F.element_at(F.split(path, "/"), -1)
    out = ~name.startswith(".")
    for g in exclude:
        out &= ~path.rlike(glob_pattern(g))
    if types:
        ext = extension(path)
        out &= ext.isin(*types) | (ext.isin(*CONVERTIBLE) if convert else F.lit(False))
    if most is not None:
        out &= size <= most
    if include:
        hit = F.lit(False)
        for g in include:
            hit |= path.rlike(glob_pattern(g))
        out &= hit
    return out


def media_type(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), extension(path)), F.lit("application/octet-stream"))


def scan(spark: SparkSession, base: str, **rules) -> DataFrame:
    """(path, name, extension, mime, size, updated_at, content) of the accepted files under ``base``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    below = F.substring_index(F.col("path"), base.rstrip("/") + "/", -1)
    ok = files.withColumn("relative", below).where(accepted(F.col("relative"), F.col("length"), **rules) & ~extension(F.col("relative")).isin(*SKIPPED))
    return ok.select("path", "relative", F.element_at(F.split("relative", "/"), -1).alias("name"), extension(F.col("relative")).alias("extension"), media_type(F.col("relative")).alias("mime"), F.col("length").alias("size"), F.col("modificationTime").alias("updated_at"), "content")


def metadata(path: Column, text: Column) -> dict[str, Column]:
    """What a repository scan tells about a file from its path and text."""
    return {
        "file_name": F.element_at(F.split(path, "/"), -1), "directory": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "extension": extension(path), "line_count": F.size(F.split(text, "\n")).cast("long"),
        "heading_count": F.regexp_count(text, F.lit(r"(?m)^#{1,6}[ \t]+[^ \t\n]")).cast("long"), "image_count": F.regexp_count(text, F.lit(r"!\[[^\]]*\]\([^)]*\)")).cast("long"),
        "has_code_blocks": text.contains("```"),
    }


# --- Conversion ------------------------------------------------------------------------------------


def table_markdown(rows: list[list[str]]) -> str:
    """A grid as a pipe table: empty rows and columns dropped, the first row its header, pipes escaped."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    keep = [k for k in range(width) if any(r[k].strip() for r in rows)]
    cells = [[r[k].strip().replace("|", "\\|").replace("\n", " ") for k in keep] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "|" + " --- |" * len(keep), *lines[1:]])


def convert_one(name: str, content: bytes) -> str:
    """Markdown of one file; raises where there is no converter."""
    ext = name.rsplit(".", 1)[-1].lower()
    text = content.decode("utf-8", "replace")
    if ext in ("md", "txt", "py"):
        return text
    if ext in ("html", "htm"):
        return "\n\n".join(f"## {body}" if head else body for head, body in html_blocks(text))
    if ext == "csv":
        return table_markdown(list(csv.reader(io.StringIO(text))))
    if ext == "json":
        return "```json\n" + json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n```"
    if ext == "xml":
        return re.sub(r"\s*\n\s*", "\n", re.sub(r"<[^>]*>", "\n", text)).strip()
    raise ValueError(f"no converter for .{ext}")


def convert(files: DataFrame, most: int = 50_000_000) -> DataFrame:
    """Adds markdown, conversion_failed and error; a file too large or of another format gets a stand-in text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    if len(content) > most:
                        raise ValueError(f"{len(content)} bytes are too many")
                    out.append((convert_one(name, bytes(content)), False, None))
                except Exception as e:  # one bad file must not end the scan
                    out.append((f"# {name}\n\nThis file could not be converted: {e}", True, str(e)))
            yield pd.DataFrame({"path": pdf["path"], "markdown": [o[0] for o in out], "conversion_failed": [o[1] for o in out], "error": [o[2] for o in out]})

    return files.select("path", "name", "content").mapInPandas(of, "path string, markdown string, conversion_failed boolean, error string")


def sub_tables(cells: dict[tuple[int, int], str]) -> list[tuple[int, int, int, int]]:
    """Bounding boxes of the connected non-empty cells of a sheet; a single column joins the box beside its rows."""
    left, boxes = set(cells), []
    while left:
        todo = [left.pop()]
        r0 = r1 = todo[0][0]
        c0 = c1 = todo[0][1]
        while todo:
            r, c = todo.pop()
            r0, r1, c0, c1 = min(r0, r), max(r1, r), min(c0, c), max(c1, c)
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        boxes.append((r0, c0, r1, c1))
    boxes.sort()
    merged = True
    while merged:
        merged = False
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if i < j and a[0] <= b[2] and b[0] <= a[2] and (a[1] == a[3] or b[1] == b[3]):
                    boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del boxes[j]
                    merged = True
                    break
            if merged:
                break
    return sorted(boxes)


def sheets_markdown(cells: DataFrame) -> DataFrame:
    """(sheet, table_index, markdown) from cells (sheet, row, col, value): one group per sheet."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = {(int(r), int(c)): str(v) for r, c, v in zip(pdf["row"], pdf["col"], pdf["value"], strict=True) if v is not None and str(v).strip()}
        out = []
        for k, (r0, c0, r1, c1) in enumerate(sub_tables(grid)):
            rows = [[grid.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]
            out.append((pdf["sheet"].iloc[0], k, table_markdown(rows)))
        return pd.DataFrame(out, columns=["sheet", "table_index", "markdown"])

    return cells.groupBy("sheet").applyInPandas(of, "sheet string, table_index long, markdown string")
