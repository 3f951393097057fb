"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

from lodestone.llm import registry, variants
from lodestone.session import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    n = counted(rows)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, out = {}, []
    for w in n:
        others = [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, ()) if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out.append((w, len(others)))
    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], k, n[form[w]] if form[w] else 0) for w, k in out)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(registry.QUERIES["op13_spelling_variants"](spark, sf)) == want
    assert sum(1 for w in want if w[1]) > 20 and any(w[2] != w[1] for w in want if w[1])


def test_dense_words(spark):
    """Few letters, doubled letters, chains of forms and ties."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abÀ") for _ in range(rnd.randint(4, 8))) for _ in range(250)]
    rows = [(i, " ".join(rnd.choice(words[: 1 + int(250 * rnd.random() ** 3)]) for _ in range(40))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(variants.spelling_variants(df)) == brute(rows)


def test_long_words_meet_too(spark):
    x = "abcdefghij" * 7
    rows = [(None, " ".join([w] * n)) for w, n in [(x, 20), (x[:64], 9), (x[:65], 3), (x[:63], 4), (x[:40] + "Z" + x[41:], 5), (x + "q", 40), (x + "é", 40), ("aaaaab" * 500, 3), ("aaaaab" * 500 + "b", 7)]]
    got = rows_of(variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert {w: f for w, f, *_ in got}[x] == x + "q"  # a tie of long words goes by code points


def test_odd_rows(spark, odd_documents):
    assert rows_of(variants.spelling_variants(odd_documents)) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert variants.spelling_variants(odd_documents.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "ABCDE abcde Abcde ×÷ABCD", "c")], "doc_id long, text string, word string")
    assert rows_of(variants.spelling_variants(only)) == brute([(r.doc_id, r.text) for r in only.collect()])


def test_sums_of_held_words_do_not_depend_on_batches(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(variants, "HELD", 100)
    import pyarrow as pa

    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in some]), pa.array([(t or "").encode() for _, t in some], pa.binary())], ["id", "b"])
    seen = Counter()
    for out in variants.runs(iter([batch(rows[:50]), batch(rows[50:])])):
        for w, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            seen[w] += n
    assert {w: n for w, n in seen.items() if n >= 3} == counted(rows)
