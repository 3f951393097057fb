"""Near duplicates under other widths and shares than operator 7's."""

import numpy as np
from lodestone.llm import ngram_join


def rows():
    words = [f"w{k}" for k in range(60)]
    near = [*words[:54], "x", *words[55:]]  # five-word shingles: 51 of 61 shared, 83.6 %
    return [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"v{k}" for k in range(60)))]


def test_keep_one_takes_width_and_percent(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    kept = lambda **how: {r.doc_id for r in ngram_join.keep_one(docs, **how).collect()}
    assert kept(width=5, percent=80) == {1, 3}
    assert kept(width=5, percent=85) == {1, 2, 3}


def test_the_sketch_counts_shingles_of_its_width(spark):
    text = " ".join(f"{k} a b c d" for k in range(400))  # "a b c d" recurs; no five words do
    docs = spark.createDataFrame([(bytearray(text.encode()),)], "b binary")
    counted = [int(ngram_join.sketch(docs, 16, w).max()) for w in (4, 5)]
    assert counted[0] > counted[1]
    assert np.array_equal(ngram_join.sketch(docs, 16), ngram_join.sketch(docs, 16, ngram_join.WIDTH))


def test_meetings_beyond_the_bits_of_a_part_do_not_wrap(spark):
    bits, most = ngram_join.COUNT_BITS, (1 << ngram_join.COUNT_BITS) - 1
    each = sum(most << (bits * k) for k in range(ngram_join.ORDERS))
    first = 1 << (bits - 1)  # twice this alone would carry into the next order's bits
    rows = [(2, 4, 16, each), (2, 4, 16, each), (6, 8, 16, first), (6, 8, 16, first), (10, 12, 0, 0), (14, 16, 1, 1 | 1 << bits | 1 << 2 * bits)]
    got = ngram_join.meetings(spark.createDataFrame(rows, "a long, b long, need long, times long"))
    assert {(r.a, r.b) for r in got.collect()} == {(2, 4), (14, 16)}
