import json

import pytest
from lodestone.operators import query as Q
from lodestone.sources import files, issues, web
from pyspark.sql import functions as F


def test_scan_and_convert(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "build").mkdir()
    for name, body in {"docs/a.md": "# A", "docs/b.csv": "x,y\n1,a|b\n,\n", "docs/c.html": "<h1>T</h1><p>p</p>", "docs/d.json": "{bad", "build/e.md": "no", "docs/.hidden.md": "no", "docs/f.doc": "old", "docs/g.xml": "<a><b>t</b></a>", "docs/h.pdf": "%PDF"}.items():
        (tmp_path / name).write_text(body)
    found = files.scan(spark, f"file:{tmp_path}", exclude=("build/",), types=("md",), convert=True)
    assert {r.relative for r in found.collect()} == {f"docs/{n}" for n in ("a.md", "b.csv", "c.html", "d.json", "g.xml", "h.pdf")}
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.convert(found).collect()}
    assert got["b.csv"].markdown == "| x | y |\n| --- | --- |\n| 1 | a\\|b |" and got["c.html"].markdown == "## T\n\np" and got["g.xml"].markdown == "t"
    assert got["d.json"].conversion_failed and got["h.pdf"].conversion_failed and not got["a.md"].conversion_failed


@pytest.mark.parametrize(("glob", "path", "hit"), [("docs/**", "docs/x/y.md", True), ("build/", "build/a", True), ("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/t?.py", "a/b/t1.py", True), ("**/t?.py", "t1.py", True), ("a-b/*", "a-b/c", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(files.glob_pattern(glob), path)) == hit


def test_sheets(spark):
    cells = [("s", 0, 0, "h1"), ("s", 0, 1, "h2"), ("s", 1, 0, "1"), ("s", 1, 1, "2"), ("s", 5, 3, "lone"), ("s", 1, 4, "beside"), ("t", 0, 0, None)]
    assert files.sub_tables({(r, c): v for s, r, c, v in cells if s == "s"}) == [(0, 0, 1, 4), (5, 3, 5, 3)]
    out = files.sheets_markdown(spark.createDataFrame(cells, "sheet string, row int, col int, value string")).collect()
    assert {r.markdown for r in out} == {"| h1 | h2 |  |\n| --- | --- | --- |\n| 1 | 2 | beside |", "| lone |\n| --- |"}


def test_web(spark):
    html = '<title> A <b>t</b>\n x</title><nav><a href="/n">n</a></nav><article><p>main</p><a href="rel.html#f">r</a><a href="https://o.org/p">o</a><pre>code</pre></article>'
    pages = spark.createDataFrame([(1, "https://h.org/d/i.html", html), (2, "https://h.org/", "<h1>only</h1>"), (3, "https://h.org/e", "")], "id long, url string, html string")
    assert {r.link for r in web.links(pages, "id", "url", "html").collect()} == {"https://h.org/n", "https://h.org/d/rel.html", "https://o.org/p"}
    got = {r.id: (r.title, r.content) for r in web.contents(pages, "id", "html").collect()}
    assert got == {1: ("A t x", "main\nr o".replace("r o", "ro") + "\n```\ncode\n```"), 2: ("only", "only"), 3: ("Untitled Document", "")}
    assert web.resolved("https://h.org/a/b/c", "../d#x") == "https://h.org/a/d"


def test_issues(spark):
    assert issues.issue_query('P"x', ("Bug",), (), "2024-01-01") == 'project = "P\\"x" AND type IN ("Bug") AND updated >= "2024-01-01"'
    tree = json.dumps({"type": "doc", "content": [{"type": "p", "content": [{"text": "one"}, {"text": " two "}]}, {"text": "three"}]})
    df = spark.createDataFrame([(tree,), ("plain",), (None,)], "raw string")
    assert [r[0] for r in df.select(issues.rich_text(F.col("raw"))).collect()] == ["one two three", "plain", None]
    spark.dataSource.register(issues.connector("jira", "cloud"))
    out = spark.read.format("paged_issues").option("total", "60").option("page", "25").load()
    assert out.count() == 60 and out.where("status = 'open'").count() == 30
    with pytest.raises(ValueError, match="no connector"):
        issues.connector("jira", "moon")


def test_field_queries():
    p = Q.parse('source_type:git title:"API  Docs" colour:red  find   it')
    assert p.fields == (("source_type", "git"), ("title", "API  Docs")) and p.text == "colour:red find it" and not p.filter_only
    assert Q.parse("document_id:x more").filter_only and Q.parse("source:a").filter_only and not Q.parse("plain").filter_only


def test_adapting_leaves_the_base_alone():
    before = Q.BY_INTENT["technical_lookup"]
    a = Q.adapt("technical_lookup", 0.2, 1)
    assert Q.BY_INTENT["technical_lookup"] == before and a.max_results == before.max_results + 5 and Q.adapt("technical_lookup", 0.9, 5) == before


def test_breadcrumbs_reach_any_depth_and_end_in_cycles(spark):
    from lodestone.sources import issues

    rows = [(k, k - 1 if k else None, f"t{k}") for k in range(24)] + [(100, 101, "a"), (101, 102, "b"), (102, 100, "c"), (103, 100, "d"), (104, 104, "self"), (105, 999, "lost")]
    df = spark.createDataFrame(rows, "id long, up long, name string")
    got = {r.id: (r.breadcrumb, r.depth) for r in issues.breadcrumbs(df, "id", "up", "name").collect()}
    assert len(got) == len(rows)
    assert got[23] == (" > ".join(f"t{k}" for k in range(24)), 24)
    assert got[100] == ("c > b > a", 3) and got[103] == ("c > b > a > d", 4) and got[104] == ("self", 1) and got[105] == ("lost", 1)
