from collections import Counter

import corpus_pipeline as pipeline
from lodestone.llm import mixing, toxicity
from lodestone.llm.common import cut, documents, table

from tests.llm.test_mixing import brute as mixed
from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_packing import brute as ids_of
from tests.llm.test_packing import check_packing, packing
from tests.llm.test_pii import brute as personal


def test_every_stage_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    by = dict(pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    clean = cut(by["toxicity"](spark, docs, sf), "t")
    assert clean.columns == columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, table(spark, sf, "labels")).collect()}
    got = {r.doc_id: r for r in clean.collect()}
    assert set(got) == {i for i, s in scores.items() if s < 0.5} and all(r == rows[i] for i, r in got.items())

    single = cut(by["near_duplicates"](spark, clean, sf), "t")
    assert single.columns == columns
    parts = linked([(i, r.text) for i, r in got.items()])
    got2 = {r.doc_id: r for r in single.collect()}
    assert set(got2) == {i for i, (_, c, _) in parts.items() if c == i} and all(r == rows[i] for i, r in got2.items())

    masked = cut(by["personal_data"](spark, single, sf), "t")
    assert masked.columns == columns
    got3 = {r.doc_id: r for r in masked.collect()}
    assert set(got3) == set(got2)
    for i, r in got3.items():
        assert r.n_chars == len(r.text)
        if not personal(got2[i].text)[-1]:
            assert r.text == got2[i].text or "[" in r.text
        for kind, a, b in personal(got2[i].text)[-1]:
            assert got2[i].text[a:b] not in r.text or kind == "ip", (i, kind)

    fed = cut(by["mixing"](spark, masked, sf), "t")
    assert fed.columns == columns
    want = mixed([(r.doc_id, r.text, r.lang, r.source) for r in got3.values()], pipeline.MIX_FRACTION, epochs=1)
    got4 = {r.doc_id: r for r in fed.collect()}
    assert Counter(list(got4)) == Counter(i for i, _ in want) and all(r == got3[i] for i, r in got4.items())

    packed = by["packing"](spark, fed, sf).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == {i: len(ids_of(r.text, tokenizer)) for i, r in got4.items()}
    check_packing(packed, 4096)
    assert mixing.MAX_EPOCHS > 0


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_odd_rows_through_all_stages(spark, sf, odd_documents):
    docs = odd_documents.drop("length")
    for _, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), "t")
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {None, 1, 2, 3, 4, 5, 6, 7}
    empty = odd_documents.drop("length").limit(0)
    for _, stage in pipeline.STAGES:
        empty = cut(stage(spark, empty, sf), "t")
    assert empty.count() == 0
