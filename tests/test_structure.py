"""Headings and JSON schemas against plain versions."""

import json
import random
import re

from lodestone.operators import headings, json_schema
from lodestone.plans import catalog
from lodestone.plans.structure_queries import marked
from lodestone.session import table


def plain_sections(text, levels, sheet, size=1500, overlap=200):
    """(level, title, path, content) with parts, by looking back from each heading."""
    items, body, fenced = [], [], False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        if not fenced and re.match(r"#{1,6}[ \t]+\S", line):
            if body:
                items.append((0, "", "\n".join(body)))
            items.append((len(line) - len(line.lstrip("#")), line.lstrip("#").strip(), line))
            body = []
        else:
            body.append(line)
    if body:
        items.append((0, "", "\n".join(body)))
    out = []
    for k, (level, title, line) in enumerate(items):
        if level and level in levels:
            path, low = [], level
            for other, name, _ in reversed(items[:k]):
                if 0 < other < low:
                    path.insert(0, name)
                    low = other
            out.append([level, title, path, line])
        elif out:
            out[-1][3] += "\n" + line
        else:
            out.append([0, "Sheet Data" if sheet else "Preamble", [], line])
    done = []
    for level, title, path, content in out:
        if sheet and level == 2:
            parts = headings.split_rows(content, size) or [content]
        elif len(content) > size:
            units = [u for p in re.split(r"\n\s*\n", content) for u in ([p.strip()] if len(p.strip()) <= size else re.split(r"(?<=[.!?])\s+", p.strip())) if u.strip()]
            parts, i = [], 0
            while i < len(units):
                j, text_ = i, ""
                while j < len(units) and (not text_ or len(text_) + len(units[j]) + 2 <= size):
                    text_ = f"{text_}\n\n{units[j]}" if text_ else units[j]
                    j += 1
                parts.append(text_)
                if j == len(units):
                    break
                room, n = min(overlap, int(len(text_) * 0.25)), 0
                while n < j - i - 1 and sum(len(u) for u in units[j - n - 1 : j]) <= room:
                    n += 1
                i = j - n
        else:
            parts = [content]
        many = len(parts) > 1 or (sheet and level == 2)
        done += [(level, f"{title} (Part {n})" if many else title, path, p) for n, p in enumerate(parts, 1)]
    return done


def rows_of(df):
    out = {}
    for r in df.orderBy("position").collect():
        out.setdefault(r[0], []).append((r.level, r.title, list(r.path), r.content))
    return out


def chosen(spark, df, key, text, sheet):
    from lodestone.operators.chunking import header_histogram

    return {r[key]: {int(x) for x in r.levels.split(",")} for r in header_histogram(df, text, sheet).select(key, "levels").collect()}


def test_sections_of_whole_documents_and_pages(spark, sf):
    from pyspark.sql import functions as F

    docs = marked(spark, sf)
    levels = chosen(spark, docs, "doc_id", "md", F.col("is_excel_sheet"))
    got = rows_of(catalog.QUERIES["chunk_sections_by_levels"](spark, sf))
    assert got == {r.doc_id: plain_sections(r.md, levels[r.doc_id], r.is_excel_sheet) for r in docs.collect()}
    assert any("(Part 2)" in s[1] for v in got.values() for s in v)
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", r"<h([1-6])[^>]*>", "\n## ").alias("md"))
    levels = chosen(spark, pages, "page_id", "md", F.lit(False))
    got = rows_of(headings.sections(pages, "page_id", "md"))
    assert got == {r.page_id: plain_sections(r.md, levels[r.page_id], False) for r in pages.collect() if r.md}


def test_random_heading_orders():
    rnd = random.Random(2)
    for _ in range(200):
        lines = [rnd.choice(["#" * rnd.randint(1, 6) + f" T{rnd.randint(0, 5)}", "text. More text.", "```", "", "#no heading", "| a | b |"]) for _ in range(rnd.randint(0, 25))]
        text, levels = "\n".join(lines), set(rnd.sample(range(1, 7), 2))
        if text:
            got = headings.sections_of(text, levels, size=40, overlap=15)
            assert [(s[1], s[2], s[3], s[6]) for s in got] == plain_sections(text, levels, False, 40, 15)


def test_neighbours_of_a_section(spark):
    text = "# A\nx\n## B\ny\n## C\n```\n## code\n```\n# D\n[l](u)\n![i](v)"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no heading")], "id long, md string")
    got = {(r.id, r.title): r for r in headings.sections(df, "id", "md").collect()}
    assert set(got) == {(1, "A"), (1, "B"), (1, "C"), (1, "D"), (4, "Preamble")}
    a, b, d = got[1, "A"], got[1, "B"], got[1, "D"]
    assert a.siblings == ["D"] and a.subsections == ["B", "C"] and a.parent is None and a.next == "B" and a.previous is None
    assert b.siblings == ["C"] and b.subsections == [] and b.parent == "A" and b.breadcrumb == "A > B" and b.top
    assert got[1, "C"].has_code and not b.has_code and d.has_links and d.has_images and d.previous == "C"


def test_heading_tree():
    assert headings.tree_of("# A\n## B\n### C\n## D\n# A\n#### E\n## F") == [["A"], ["A", "E"], ["A", "F"]]
    assert headings.tree_of("x\n### deep\n# A\n## B") == [["deep"], ["A"], ["A", "B"]]
    assert headings.tree_of("") == []


def plain_schema(values):
    """{(path, type): (n, filled, required)} by a recursive walk."""
    n, filled, parents, total = {}, {}, {}, {}

    def walk(path, v):
        kind = {"dict": "object", "list": "array"}.get(type(v).__name__, type(v).__name__)
        n[path, kind] = n.get((path, kind), 0) + 1
        full = int(v is not None and v != "")
        filled[path, kind] = filled.get((path, kind), 0) + full
        total[path] = total.get(path, 0) + full
        if isinstance(v, dict):
            parents[path] = parents.get(path, 0) + 1
            for k, x in v.items():
                walk(f"{path}/{json_schema.escaped(k)}", x)
        elif isinstance(v, list):
            for x in v:
                walk(f"{path}/*", x)

    for v in values:
        walk("", v)
    required = lambda p: None if p == "" or p.endswith("/*") else total[p] == parents.get(p.rpartition("/")[0])
    return {k: (n[k], filled[k], required(k[0])) for k in n}


def made(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 4 else 5)
    if kind >= 6:
        return {rnd.choice(["a", "b", "c/d", "e~*", "*"]): made(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}
    if kind == 5:
        return [made(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return [None, "", "x", 1, 2.5][kind]


def test_schema_of_nested_values_in_any_order(spark, monkeypatch):
    rnd = random.Random(7)
    values = [made(rnd) for _ in range(400)]
    texts = [json.dumps(v) for v in values]
    want = plain_schema(values)
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "g long, t string")

    def read(states):
        return {(r.path, r.type): (r.n, r.filled, r.required) for r in json_schema.schema(states).collect()}

    assert read(json_schema.states(df, "t")) == want
    monkeypatch.setattr(json_schema, "HELD", 3)
    parts = [json_schema.states(df.where(f"g = {k}").repartition(k + 1), "t") for k in (2, 0, 1)]
    assert read(json_schema.merged(parts[0].union(parts[1]).union(parts[2]))) == want
    by_group = json_schema.schema(json_schema.states(df, "t", "g")).collect()
    for g in range(3):
        own = plain_schema([v for i, v in enumerate(values) if i % 3 == g])
        assert {(r.path, r.type): (r.n, r.filled, r.required) for r in by_group if r.key == g} == own


def test_odd_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    df = spark.createDataFrame([(None,), ("{",), (deep,), ("[]",), ("{}",), ("[1, 2.0]",), ('{"a": []}',)], "t string")
    got = {(r.path, r.type): r for r in json_schema.schema(json_schema.states(df, "t")).collect()}
    assert got["", "invalid"].n == 2 and got["", "array"].n == 2 and got["", "array"].homogeneous is False and (got["", "array"].min_length, got["", "array"].max_length) == (0, 2)
    assert got["", "object"].completeness == 0.5 and got["/a", "array"].homogeneous and got["/a", "array"].required is False
    assert json_schema.schema(json_schema.states(df.limit(0), "t")).count() == 0
