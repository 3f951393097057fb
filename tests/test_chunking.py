import json
import random

import pytest
from lodestone.operators import chunking as C
from pyspark.sql import functions as F


def prose(n, seed=1):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["Alpha", "beta,", "gamma.", "Delta", "eps!", "zeta"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(10))
def test_large_sections_keep_every_word_and_the_size(seed):
    text = prose(900, seed)
    parts = C.split_large(text, 500, 60)
    assert all(len(p) <= 500 for p in parts) and len(parts) > 5
    joined, at = " ".join(parts), 0
    for word in text.split():  # overlaps repeat words, none is lost
        at = joined.find(word, max(0, at - 400))
        assert at >= 0


def test_cut_prefers_sentence_ends():
    text = "a" * 60 + " one two. Three four five six seven"
    assert text[: C.best_cut(text, 0, 80)].endswith("two. ")
    assert C.best_cut("x" * 50, 0, 100) == 50
    assert C.split_large("x" * 3000, 1000, 100)[0] == "x" * 1000


def test_text_merges_and_repairs():
    assert C.split_text("one\n\ntwo\n \nthree", 100) == ["one\n\ntwo\n\nthree"]
    assert C.split_text("", 100) == []
    assert C.merge_small(["aa", "bb", "cccccccc"], 6) == ["aa\n\nbb", "cccccccc"]
    assert C.repair_boundaries(["First part", "continued here. Next one."]) == ["First part continued here.", "Next one."]
    assert all(len(p) <= 40 for p in C.split_recursive(prose(100), 40)) and C.split_recursive("z" * 100, 40)[0] == "z" * 40


def test_markdown():
    md = "intro\n# A\n" + "x " * 400 + "\n## B\nshort\n```\n# not a header\n```\n# C\ny"
    parts = C.split_markdown(md, 1500)
    assert parts[0].startswith("intro") and any("# not a header" in p and "## B" in p for p in parts)
    assert parts[-1].startswith("# C") or "# C" in parts[-1]


def test_spreadsheet_rows_repeat_their_heading():
    md = "## Sheet: One\n| name | note |\n| --- | --- |\n" + "\n".join(f"| n{k} | a\\|b {k} |" for k in range(60))
    parts = C.split_rows(md, 300)
    assert len(parts) > 3 and all(p.startswith("Sheet: One\n") for p in parts) and "note: a|b 7" in " ".join(parts)


def test_html():
    html = "<html><script>var x = '<p>no</p>'</script><nav>menu</nav><h1>Title</h1><p>" + prose(30) + "</p><div>tail <b>bold</b></div></html>"
    blocks = C.html_blocks(html)
    assert (True, "Title") in blocks and not any("var x" in b for _, b in blocks) and blocks[-1] == (False, "tail bold")
    assert C.split_html(html)[0].startswith("menu") and C.split_html("") == []


def test_json():
    parts = C.split_json(json.dumps({"a": list(range(120)), "b": {"c": "d"}}))
    assert len(parts) == 3 and parts[0].startswith("$.a[0]: 0") and parts[-1].endswith('$.b.c: "d"')
    assert C.split_json("{not json", 100) == ["{not json"]


def test_code():
    src = "import os\n\n@dec\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n"
    assert [e.split("\n")[0] for e in C.code_elements(src)] == ["import os", "@dec", "class A:"]
    assert any(p.startswith("func main") for p in C.code_elements("package x\n\nfunc main() {\n}\n"))


def test_chunk_table(spark):
    rows = [("a", "md", "# H\nbody"), ("b", "txt", ""), ("c", "txt", None), ("d", "json", "[1, 2]"), ("e", "html", "<p>hello</p>"), ("f", "py", "x = 1"), ("g", "txt", prose(2000))]
    out = C.chunk(spark.createDataFrame(rows, "id string, content_type string, text string"), "id", "text")
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == set("abcdefg") and by["b"][0].chunk == "" and by["c"][0].total_chunks == 1 and by["a"][0].strategy == "markdown"
    assert [r.chunk_index for r in sorted(by["g"], key=lambda r: r.chunk_index)] == list(range(by["g"][0].total_chunks))
    assert len({r.chunk_id for r in got}) == len(got)
    assert C.chunk(out.select("id", F.lit("txt").alias("content_type"), F.col("chunk").alias("text")).limit(0), "id", "text").count() == 0
