"""Markdown by its headings: sections at the chosen levels with paths, parts and neighbours; the heading tree; links and phrases.

A document's headings depend on those before them, so a document is folded in one pass, in Arrow batches; nothing is shuffled.
Links and phrases are Column expressions.

Defined results: headings inside fenced code are text; a heading's path holds, from the top, the nearest headings before it that
rank higher, each higher than the next; a document without headings is one section "Preamble" ("Sheet Data" in spreadsheets);
null and empty texts have no sections; sections have all their parts (no most number).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import slices
from lodestone.operators.chunking import CHUNK_SIZE, OVERLAP, header_histogram, split_rows

#: Part of a piece that the next may repeat at most; levels that count as top.
MOST_OVERLAP, TOP_LEVEL = 0.25, 2

HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*?)[ \t\r]*$")
SPACE = r"[ \t\n\x0B\f\r]"

SECTION = (
    "position int, level int, title string, path array<string>, breadcrumb string, parent string, content string, part int, parts int, "
    "siblings array<string>, subsections array<string>, previous string, next string, top boolean, words int, has_code boolean, has_links boolean, has_images boolean"
)


def blocks(text: str) -> Iterator[tuple[int, str, str]]:
    """(level, title, line) of each heading and (0, "", text) of what stands between, in order."""
    fenced, body = False, []
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced else HEADING.match(line)
        if m:
            if body:
                yield 0, "", "\n".join(body)
                body = []
            yield len(m[1]), m[2], line
        else:
            body.append(line)
    if body:
        yield 0, "", "\n".join(body)


def paths(headings: list[tuple[int, str]]) -> list[list[str]]:
    """Each heading's path: a stack that holds higher ranks below lower ones."""
    stack: list[tuple[int, str]] = []
    out = []
    for level, title in headings:
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append([t for _, t in stack])
        stack.append((level, title))
    return out


def pack(content: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs (sentences, where a paragraph is too long) packed up to ``size``; a piece repeats the last units of the one
    before, as far as they fit into the overlap."""
    units: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", content)):
        if len(p) > size:
            units += [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]
        elif p:
            units.append(p)
    out, first = [], 0
    while first < len(units):
        last, length = first, len(units[first])
        while last + 1 < len(units) and length + len(units[last + 1]) + 2 <= size:
            last += 1
            length += len(units[last]) + 2
        out.append("\n\n".join(units[first : last + 1]))
        if last + 1 == len(units):
            break
        room, back = min(overlap, int(length * MOST_OVERLAP)), last + 1
        while back - 1 > first and room >= len(units[back - 1]):
            back -= 1
            room -= len(units[back])
        first = back
    return out


def sections_of(text: str, levels: set[int], spreadsheet: bool = False, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple]:
    """Rows of SECTION: the text cut at headings of ``levels``, long sections in parts."""
    found = list(blocks(text))
    way = iter(paths([(level, title) for level, title, _ in found if level]))
    sections: list[tuple[int, str, list[str], list[str]]] = []
    for level, title, body in found:
        path = next(way) if level else []
        if level in levels and level:
            sections.append((level, title, path, [body]))
        elif sections:
            sections[-1][3].append(body)
        else:
            sections.append((0, "Sheet Data" if spreadsheet else "Preamble", [], [body]))
    titles = [t for _, t, _, _ in sections]
    same: dict[tuple, list[int]] = {}
    for k, (level, _, path, _) in enumerate(sections):
        same.setdefault((level, *path), []).append(k)
    # A section's subsections are those whose path is its own and its title, before a section of its rank or above.
    below: list[list[str]] = [[] for _ in sections]
    stack: list[int] = []
    for k, (level, title, _, _) in enumerate(sections):
        while stack and sections[stack[-1]][0] >= level:
            stack.pop()
        if stack and sections[stack[-1]][0]:
            below[stack[-1]].append(title)
        stack.append(k)
    out = []
    for k, (level, title, path, body) in enumerate(sections):
        content = "\n".join(body)
        if spreadsheet and level == 2:
            parts = split_rows(content, size) or [content]
        else:
            parts = pack(content, size, overlap) if len(content) > size else [content]
        siblings = [titles[j] for j in same[(level, *path)] if j != k]
        for n, piece in enumerate(parts, 1):
            name = f"{title} (Part {n})" if len(parts) > 1 or (spreadsheet and level == 2) else title
            out.append((
                len(out), level, name, path, " > ".join([*path, title]), path[-1] if path else None, piece, n, len(parts), siblings, below[k], titles[k - 1] if k else None,
                titles[k + 1] if k + 1 < len(titles) else None, level <= TOP_LEVEL, len(piece.split()), "```" in piece, bool(re.search(r"(?<!!)\[[^\]\n]*\]\([^)\n]*\)", piece)), bool(re.search(r"!\[[^\]\n]*\]\([^)\n]*\)", piece)),
            ))
    return out


def sections(df: DataFrame, key: str, text: str, spreadsheet: Column | None = None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``key`` and the columns of SECTION for every section, or part of one, at the levels that a document's headings choose."""
    sheet = F.coalesce(spreadsheet, F.lit(False)) if spreadsheet is not None else F.lit(False)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), sheet.alias("_sheet"))
    rows = header_histogram(rows, "_text", F.col("_sheet"))

    @F.pandas_udf(f"array<struct<{SECTION.replace(' array<', ': array<').replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = [c.split(" ")[0] for c in SECTION.split(", ")]
        for some in slices(batches):
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in sections_of(t, {int(x) for x in v.split(",")}, bool(b), size, overlap)] if t else [] for t, v, b in zip(*some, strict=True)])

    return rows.select(F.col("_key").alias(key), F.explode(cut("_text", "levels", "_sheet")).alias("s")).select(key, "s.*")


def heading_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, level, title, path) of every heading outside fenced code."""

    @F.pandas_udf("array<struct<level: int, title: string, path: array<string>>>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [(level, title) for level, title, _ in blocks(t or "") if level]
            out.append([{"level": level, "title": title, "path": p} for (level, title), p in zip(found, paths(found), strict=True)])
        return pd.Series(out)

    return df.select(key, F.posexplode(of(F.col(text))).alias("position", "h")).select(key, "position", "h.level", "h.title", "h.path")


def tree_of(text: str) -> list[list[str]]:
    """Paths of the heading tree. A heading goes below as many of those open as its signs allow; one that repeats a
    path starts it anew."""
    tree: dict = {}
    at: list[str] = []
    for line in text.split("\n"):
        if line.startswith("#"):
            level, title = len(line.split()[0]), line.lstrip("#").strip()
            del at[level - 1 :]
            at.append(title)
            here = tree
            for t in at[:-1]:
                here = here.setdefault(t, {})
            here[title] = {}
    out, todo = [], [([k], v) for k, v in reversed(tree.items())]
    while todo:
        path, below = todo.pop()
        out.append(path)
        todo += [([*path, k], v) for k, v in reversed(below.items())]
    return out


def heading_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, path) of every node of a document's heading tree, depth first."""

    @F.pandas_udf("array<array<string>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([tree_of(t or "") for t in texts])

    return df.select(key, F.posexplode(of(F.col(text))).alias("position", "path"))


def links(text: Column) -> Column:
    """Links (text, url) of lines with exactly one ``](``: what stands after the first ``[``, and up to the next ``)``."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^[^\[]*\[.*\]\(|^[^\[]*\[\]\(") & (F.size(F.split(s, r"\]\(")) == 2) & (F.locate("[", F.split(s, r"\]\(")[0]) > 0))
    part = lambda s, k: F.split(s, r"\]\(")[k]
    return F.transform(lines, lambda s: F.struct(F.split(part(s, 0), r"\[")[1].alias("text"), F.split(part(s, 1), r"\)")[0].alias("url")))


def phrases(text: Column) -> Column:
    """Runs of words that begin with a capital, single spaces between them, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(^|{SPACE})(\p{{Lu}}[^ \t\n\x0B\f\r]*({SPACE}+\p{{Lu}}[^ \t\n\x0B\f\r]*)*)"), F.lit(2))
    return F.transform(found, lambda p: F.regexp_replace(p, f"{SPACE}+", " "))
