"""Chunking: routing, splitting and section navigation.

What is a count, a regular expression or a running sum is a DataFrame
expression. Splitters whose next cut depends on the last run in one Arrow-batched
pandas UDF per document (``chunk``): a document is one row, so nothing is
gathered.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.batches import slices
from lodestone.functions.identity import chunk_id

CHUNK_SIZE, OVERLAP, MOST_CHUNKS = 1500, 200, 500
MARKDOWN_MERGE, JSON_ITEMS, JSON_LEAST = 500, 50, 200
CODE_EXTENSIONS = ("py", "java", "js", "ts", "go", "rs", "c", "cpp", "cs", "php", "rb", "kt", "scala", "swift")


def contextual_prefix(source: Column, title: Column, project: Column) -> Column:
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c))
    return F.concat(F.lit("["), F.concat_ws(" | ", part("Source", source), part("Title", title), part("Project", project)), F.lit("]"))


def paragraphs(df: DataFrame, key: str, text: str, pattern: str = r"\n\s*\n") -> DataFrame:
    parts = F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(key, F.posexplode(parts).alias("position", "paragraph")).withColumn("position", F.col("position").cast("long"))


def estimated_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP, most: int = MOST_CHUNKS) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.length(text) / (size - overlap)))).cast("long")


def keyword_density(df: DataFrame, key: str, text: str, top: int) -> DataFrame:
    """The ``top`` most frequent words of each row with their share of all counted words."""
    found = df.select(key, F.explode(T.letters(F.col(text))).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*T.KEYWORD_STOP_WORDS))
    n = found.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(key)
    ranked = n.withColumn("total", F.sum("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("rank") <= top).select(key, "word", "n", F.round(F.col("n") / F.col("total"), 6).alias("density"))


def header_histogram(df: DataFrame, md: str, spreadsheet: Column) -> DataFrame:
    """Counts of headers by level and the levels to split at."""
    for k in range(1, 7):
        df = df.withColumn(f"h{k}", F.regexp_count(F.col(md), F.lit(rf"(?m)^#{{{k}}}[ \t]+[^ \t\n].*$")).cast("long"))
    h = {k: F.col(f"h{k}") for k in range(1, 7)}
    levels = (
        F.when(spreadsheet, F.when(h[3] > 0, "1,2,3").otherwise("1,2"))
        .when((h[1] == 1) & (h[2] >= 3), "1,2")
        .when(h[1] >= 3, "1")
        .when((h[1] == 0) & (h[2] == 0) & (h[3] > 0), F.when(h[4] > 0, "3,4").otherwise("3"))
        .otherwise("1,2")
    )
    return df.withColumn("levels", levels)


def markdown_lines(df: DataFrame, key: str, md: str) -> DataFrame:
    """(key, i, line, level, section): lines with a running count of headers."""
    lines = df.select(key, F.posexplode(F.split(md, "\n")).alias("i", "line"))
    is_header = F.col("line").rlike(r"^#{1,6}[ \t]+[^ \t]")
    level = F.when(is_header, F.length(F.regexp_extract("line", "^#+", 0)))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("level", level).withColumn("section", F.sum(is_header.cast("int")).over(before))


def section_navigation(lines: DataFrame, key: str) -> DataFrame:
    """One row per section with its neighbours and the number of others on its level."""
    title = F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", "^#+", "")))
    s = lines.groupBy(key, "section").agg(F.max("level").cast("long").alias("level"), F.max(title).alias("title"), (F.count(F.lit(1)) - F.count("level")).alias("body_lines"))
    w, peers = Window.partitionBy(key).orderBy("section"), Window.partitionBy(key, "level")
    return s.select(
        key, "section", "level", "title", "body_lines",
        F.lag("title").over(w).alias("previous"), F.lead("title").over(w).alias("next"),
        F.when(F.col("level").isNotNull(), F.count(F.lit(1)).over(peers) - 1).otherwise(F.lit(0)).cast("long").alias("same_level"),
    )


def block_type(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^#{1,6}\s+"), "header").when(line.rlike("^(```|    )"), "code").when(line.rlike(r"^\s*([*+-]|[0-9]+\.)\s+"), "list")
        .when(line.rlike(r"\|"), "table").when(line.rlike(r"^\s*>"), "quote").otherwise("paragraph")
    )


def cost(text: Column, kind: Column) -> Column:
    """Size class and expected seconds, for planning only: Spark has no timeouts by document."""
    n = F.length(text)
    size = F.when(n < 1000, "tiny").when(n < 10000, "small").when(n < 50000, "medium").otherwise("large")
    seconds = F.when(n < 1000, 30).when(n < 10000, 60).when(n < 50000, 120).otherwise(240)
    return F.struct(size.alias("size_class"), (seconds * F.when(kind.isin("md", "py"), 2).otherwise(1)).alias("seconds"))


def route(content_type: Column, converted: Column | None = None) -> Column:
    kind = F.lower(content_type)
    out = F.when(kind.isin("md", "markdown"), "markdown").when(kind.isin("html", "htm"), "html").when(kind == "json", "json").when(kind.isin(*CODE_EXTENSIONS), "code").otherwise("text")
    return out if converted is None else F.when(converted, "markdown").otherwise(out)


# --- Sequential splitters: plain functions from one text to its pieces ---------------------------

#: How good a place for a cut is, by what ends there.
BOUNDARIES = (
    (re.compile(r"[.!?][\"')\]]?\s+(?=[A-Z0-9\"'(])"), 1.0),
    (re.compile(r"\n\s*\n"), 0.9),
    (re.compile(r"\n(?=\s*(?:[*+-]|\d+\.)\s)"), 0.8),
    (re.compile(r"[.!?]\s"), 0.6),
    (re.compile(r"[,;:]\s"), 0.4),
    (re.compile(r"\s"), 0.2),
)


def best_cut(text: str, start: int, size: int, reach: int = OVERLAP) -> int:
    """The best-scored end of a piece from ``start``: among boundaries in the last ``reach`` characters, those
    that end something larger and leave a fuller piece score higher."""
    end = min(start + size, len(text))
    if end == len(text):
        return end
    low, best = max(start + 1, end - reach), (0.0, end)
    for pattern, worth in BOUNDARIES:
        for m in pattern.finditer(text, low, end):
            at = m.end()
            fill = (at - start) / size
            score = worth + 0.3 * fill - (0.5 if fill < 0.3 else 0.0)
            best = max(best, (score, at))
    return best[1]


def split_large(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = best_cut(text, start, size)
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        back = text.find(" ", max(start + 1, end - overlap), end)
        start = max(start + 1, back + 1 if back >= 0 else end)
        if start < end - overlap:
            start = end
    return out


def merge_small(parts: list[str], size: int, joint: str = "\n\n") -> list[str]:
    """Greedy: a part joins the piece before it while both fit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= size:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def repair_boundaries(parts: list[str]) -> list[str]:
    """A first sentence that starts in lower case belongs to the piece before."""
    out: list[str] = []
    for p in parts:
        m = re.match(r"[a-z][^.!?]*[.!?]\s*", p)
        if out and m and m.end() < len(p):
            out[-1] = f"{out[-1]} {m.group().strip()}"
            p = p[m.end() :]
        out.append(p)
    return out


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
    parts = [p for b in blocks for p in (split_large(b, size, overlap) if len(b) > size else [b])]
    return merge_small(parts, size)


def split_recursive(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Split at the coarsest separator that occurs, recursing into pieces still too long."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        step = max(1, size - min(size // 4, 50))
        return [text[k : k + size] for k in range(0, len(text), step)]
    rest = separators[separators.index(sep) + 1 :]
    parts = [p for x in text.split(sep) for p in split_recursive(x, size, rest)]
    return merge_small(parts, size, sep)


def split_markdown(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Cut before headers outside code fences; a short section joins the deeper one after it."""
    sections: list[tuple[int, list[str]]] = [(0, [])]
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.startswith("```")
        m = None if fenced else re.match(r"(#{1,6})\s+\S", line)
        if m:
            sections.append((len(m[1]), []))
        sections[-1][1].append(line)
    bodies = [(level, "\n".join(lines).strip()) for level, lines in sections]
    out: list[tuple[int, str]] = []
    for level, body in bodies:
        if not body:
            continue
        if out and len(out[-1][1]) < MARKDOWN_MERGE and level > out[-1][0] and len(out[-1][1]) + len(body) <= size:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{body}")
        else:
            out.append((level, body))
    return [p for _, body in out for p in (split_text(body, size, overlap) if len(body) > size else [body])]


def split_rows(text: str, size: int = CHUNK_SIZE) -> list[str]:
    """Pipe tables under sheet headings, as key-value blocks that repeat the heading in every piece."""
    heading, header, blocks = "", [], []
    for line in text.split("\n"):
        if line.startswith("#"):
            heading, header = line.lstrip("# ").strip(), []
            continue
        cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] if "|" in line else []
        if not cells or all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
            continue
        if not header:
            header = cells
        elif len(cells) == len(header):
            blocks.append((heading, "; ".join(f"{k}: {v}" for k, v in zip(header, cells, strict=True) if v)))
    out: list[tuple[str, str]] = []
    for head, row in blocks:
        if out and out[-1][0] == head and len(out[-1][1]) + len(row) + 1 <= size:
            out[-1] = (head, f"{out[-1][1]}\n{row}")
        else:
            out.append((head, f"{head}\n{row}" if head else row))
    return [body for _, body in out] or split_text(text, size)


class _Blocks(HTMLParser):
    BLOCK = {"p", "div", "section", "article", "li", "td", "pre", "blockquote", "main", "header", "footer", "nav", "aside", "table", "ul", "ol"}
    HEAD = {"h1", "h2", "h3", "h4", "h5", "h6"}
    DROP = {"script", "style", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[bool, str]] = []
        self.buffer: list[str] = []
        self.dropped = 0
        self.head = False

    def flush(self) -> None:
        if body := re.sub(r"\s+", " ", "".join(self.buffer)).strip():
            self.out.append((self.head, body))
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.dropped += 1
        if tag in self.BLOCK or tag in self.HEAD:
            self.flush()
            self.head = tag in self.HEAD

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.dropped = max(0, self.dropped - 1)
        if tag in self.BLOCK or tag in self.HEAD:
            self.flush()
            self.head = False

    def handle_data(self, data):
        if not self.dropped:
            self.buffer.append(data)


def html_blocks(text: str) -> list[tuple[bool, str]]:
    """(is heading, text) of each block in document order, scripts and styles left out."""
    p = _Blocks()
    p.feed(text)
    p.close()
    p.flush()
    return p.out


def split_html(text: str, size: int = CHUNK_SIZE, least: int = 100, overlap: int = OVERLAP) -> list[str]:
    """Blocks under 100 characters join their neighbours; a heading starts a new piece."""
    out: list[str] = []
    fresh = True
    for heading, body in html_blocks(text):
        if out and not heading and not fresh and (len(body) < least or len(out[-1]) < least) and len(out[-1]) + len(body) < size:
            out[-1] = f"{out[-1]}\n{body}"
        elif out and fresh and not heading and len(out[-1]) + len(body) < size:
            out[-1] = f"{out[-1]}\n{body}"
            fresh = False
        else:
            out.append(body)
            fresh = heading
    return [p for b in out for p in (split_large(b, size, overlap) if len(b) > size else [b])]


def json_elements(value, path: str = "$", level: int = 0, deepest: int = 10) -> Iterator[tuple[str, int, object]]:
    """(path, level, value) of the leaves, and of containers at the deepest level."""
    if isinstance(value, dict) and value and level < deepest:
        for k, v in value.items():
            yield from json_elements(v, f"{path}.{k}", level + 1, deepest)
    elif isinstance(value, list) and value and level < deepest:
        for k, v in enumerate(value):
            yield from json_elements(v, f"{path}[{k}]", level + 1, deepest)
    else:
        yield path, level, value


def split_json(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Elements as ``path: value`` lines, by fifty or up to the size; text rules where it does not parse."""
    try:
        value = json.loads(text)
    except ValueError:
        return split_text(text, size, overlap)
    out, lines = [], []
    for path, _, v in json_elements(value):
        line = f"{path}: {json.dumps(v, ensure_ascii=False)}"
        if lines and (len(lines) >= JSON_ITEMS or sum(map(len, lines)) + len(line) > size):
            out.append("\n".join(lines))
            lines = []
        lines.append(line)
    return [p for b in [*out, "\n".join(lines)] if b for p in (split_large(b, size, overlap) if len(b) > size else [b])]


def code_elements(text: str) -> list[str]:
    """Top-level definitions with what stands between them; Python by its syntax tree, else by indentation."""
    lines = text.split("\n")
    try:
        nodes = ast.parse(text).body
        starts = [min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]) - 1 for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        ends = [n.end_lineno for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        cuts = sorted({0, len(lines), *starts, *ends})
    except (SyntaxError, ValueError):
        head = re.compile(r"(?:pub |public |private |static |export |async )*(?:func|fn|class|struct|interface|enum|def|function|impl|trait|void|int)\b")
        cuts = sorted({0, len(lines), *[k for k, s in enumerate(lines) if head.match(s)]})
    return [p for a, b in zip(cuts, cuts[1:], strict=False) if (p := "\n".join(lines[a:b]).strip("\n")).strip()]


def split_code(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    merged = merge_small(code_elements(text), size // 2, "\n")
    return [p for e in merged for p in (split_large(e, size, overlap) if len(e) > size else [e])] or split_text(text, size, overlap)


SPLITTERS: dict[str, Callable[[str, int], list[str]]] = {"text": split_text, "markdown": split_markdown, "html": split_html, "json": split_json, "code": split_code}


def chunk(df: DataFrame, key: str, text: str, content_type: str = "content_type", size: int = CHUNK_SIZE, most: int | None = None) -> DataFrame:
    """(key, strategy, chunk_index, total_chunks, chunk_id, chunk): one row per chunk; an empty text is one empty chunk.

    Every chunk stays; ``most`` (MOST_CHUNKS is a usual number) keeps the first so many of a text.
    """

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some in slices(batches):
            yield pd.Series([(SPLITTERS[k](t or "", size) or [""])[:most] for k, t in zip(*some, strict=True)])

    routed = df.withColumn("strategy", route(F.col(content_type))).withColumn("_parts", pieces("strategy", text))
    out = routed.select(key, "strategy", F.size("_parts").cast("long").alias("total_chunks"), F.posexplode("_parts").alias("chunk_index", "chunk"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("chunk_id", chunk_id(F.col(key).cast("string"), F.col("chunk_index")))
