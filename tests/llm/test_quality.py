import numpy as np
from lodestone.llm import quality
from lodestone.llm.common import documents, table


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_statistics_match_brute_force(spark, sf, odd_documents, odd_labels):
    for docs, labels in ((documents(spark, sf), table(spark, sf, "labels")), (odd_documents, odd_labels)):
        got = {}
        for r in quality.quality(docs, labels).collect():
            got[r.doc_id] = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert not (r.base_failed and r.kept)
        assert got == {r.doc_id: brute(r.text or "") for r in docs.collect()}
        assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_classifier_learns(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    sample = [(r.text.encode(), labels[r.doc_id]) for r in documents(spark, sf).collect() if r.doc_id in labels]
    half = len(sample) // 2
    model, cache = quality.fit(sample[:half]), quality.WordHashes()
    p = np.array([model.probability(t, cache.of(t.split())) for t, _ in sample[half:]])
    y = np.array([y for _, y in sample[half:]])
    assert ((p >= 0.5) == y).mean() > 0.88
    assert (p[y == 1] >= quality.KEEP_AT).mean() > 0.97
    assert quality.fit(sample[:5]) is None
