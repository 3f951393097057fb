"""Topic model against a plain version of the same updates, and on planted topics."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodestone.operators import topics


def plain_infer(n, beta, alpha=0.1):
    """One document by the textbook's equations, in loops."""
    k = len(beta[0])
    psi = lambda x: float(topics.digamma(np.array([x]))[0])
    gamma = [1.0] * k
    for _ in range(50):
        theta = [math.exp(psi(g) - psi(sum(gamma))) for g in gamma]
        phi = [[theta[j] * b[j] / sum(theta[i] * b[i] for i in range(k)) for j in range(k)] for b in beta]
        new = [alpha + sum(c * p[j] for c, p in zip(n, phi, strict=True)) for j in range(k)]
        done = sum(abs(a - b) for a, b in zip(new, gamma, strict=True)) / k < 0.001
        gamma = new
        if done:
            break
    return gamma


def test_digamma():
    x = np.array([1e-3, 0.1, 1.0, 2.5, 10.0, 1234.5])
    step = 1e-5 * x
    slope = np.array([(math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h) for a, h in zip(x, step, strict=True)])
    assert np.allclose(topics.digamma(x), slope, rtol=1e-6) and abs(topics.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-9


def test_inference_of_one_document_equals_the_plain_equations():
    rnd = np.random.default_rng(3)
    for _ in range(5):
        n, beta = rnd.integers(1, 6, 12).astype(float), rnd.uniform(0.001, 0.3, (12, 4))
        gamma, stat, bound = topics.infer_one(n, beta)
        assert np.allclose(gamma, plain_infer(n.tolist(), beta.tolist()), rtol=1e-6)
        assert np.allclose(stat.sum(1), n) and gamma.sum() == pytest.approx(0.4 + n.sum())
        # The bound lies below the likelihood of the words under any mixture's best case.
        assert bound < float(n @ np.log(beta.max(1)))


def test_documents_together_equal_each_alone():
    rnd = np.random.default_rng(5)
    sizes = np.array([1, 7, 30, 2, 12])
    starts, n, beta = np.cumsum(sizes) - sizes, rnd.integers(1, 9, sizes.sum()).astype(float), rnd.uniform(1e-4, 0.3, (sizes.sum(), 3))
    gamma, stat, bound = topics.infer_many(n, beta, starts)
    for k, (a, m) in enumerate(zip(starts, sizes, strict=True)):
        g, s, b = topics.infer_one(n[a : a + m], beta[a : a + m])
        assert np.allclose(gamma[k], g) and np.allclose(stat[a : a + m], s) and bound[k] == pytest.approx(b)


def test_blocks_hold_every_long_document(spark, monkeypatch):
    monkeypatch.setattr(topics, "BUCKET", 10)
    rows = [(i, f"word{'abcdefg'[i % 7]} term{'vwxyz'[i % 5]} shared shared shared") for i in range(40)] + [(None, "nobody nobody wrote certain words"), (-7, "too short")]
    monkeypatch.setattr(topics, "CHARACTERS", 100)
    docs = spark.createDataFrame(rows + [(3, "more words"), (3, None), (99, "")], "doc_id long, text string")
    bags, want = topics.words(docs), defaultdict(dict)
    for r in bags.collect():
        want[None if r.doc is None else str(r.doc)][r.term] = r.n
    want = {d: t for d, t in want.items() if sum(t.values()) >= 5}
    assert len(want) == 41 and "words" in want["3"]
    for blocks in (topics.packed(bags, 2), topics.packed_texts(docs, 2)):
        got, rows = {}, blocks.collect()
        assert len({r.block for r in rows}) == len(rows) > 2 and {r.slice for r in rows} == {0, 1}
        for r in rows:
            for k, doc in enumerate(r.docs):
                assert doc not in got
                a, b = r.ends[k - 1] if k else 0, r.ends[k]
                got[doc] = {r.terms[t]: n for t, n in zip(r.at[a:b], r.n[a:b], strict=True)}
        assert got == want
    assert not topics.packed_texts(docs.limit(0)).collect() and not topics.packed_texts(docs.where("text = ''")).collect()


def planted(n, seed):
    """Documents of one of three vocabularies each, with a few common words."""
    rnd = random.Random(seed)
    vocab = [[f"{p}{c}{d}" for c in "abcdefgh" for d in "klmnp"] for p in ("xa", "yo", "zu")]
    return [(i, " ".join(rnd.choice(vocab[i % 3]) if rnd.random() < 0.9 else rnd.choice(["common", "usual"]) for _ in range(40))) for i in range(n)]


def test_planted_topics_are_found_and_updated(spark):
    rows = planted(150, 1) + [(900, "too short"), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = topics.fit(topics.words(docs), passes=4)
    assert (model.documents, model.updates) == (150, 8)
    got = defaultdict(dict)
    for r in topics.document_topics(model, docs, least=0.0).collect():
        got[r.doc_id][r.topic] = r.probability
    assert all(got[i] == {-1: 1.0} for i in (900, 901, 902))
    best = {i: max(p, key=p.get) for i, p in got.items() if i < 900}
    groups = [Counter(best[i] for i in range(150) if i % 3 == g).most_common(1)[0] for g in range(3)]
    assert len({t for t, _ in groups}) == 3 and min(n for _, n in groups) >= 48
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in got.values())
    terms = topics.topic_terms(model, 10).collect()
    assert len(terms) == 30
    for t in {r.topic for r in terms}:
        own = [r for r in terms if r.topic == t]
        assert len({r.term[:2] for r in own if r.term not in ("common", "usual")}) == 1
        assert own[0].coherence == pytest.approx(sum(r.weight for r in own) / 10)
    # New documents bring new terms and go to the topic of their old ones.
    more = [(1000 + i, f"{t} newterm newterm newterm") for i, t in planted(60, 2) if i % 3 == 0]
    new = spark.createDataFrame(more, "doc_id long, text string")
    after = topics.update(model, topics.words(new))
    assert (after.documents, after.updates) == (170, 9) and after.state.count() == model.state.count() + 1
    weights = after.state.where("term = 'newterm'").first().weights
    assert int(np.argmax(weights)) == groups[0][0]


def test_an_update_equals_the_plain_one(spark):
    rows = planted(30, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bags = topics.words(docs)
    start = topics.Model(topics.cut(topics.new_terms(bags, 3)), 3, 30, 2)
    before = {r.term: np.array(r.weights) for r in start.state.collect()}
    after = {r.term: np.array(r.weights) for r in topics.stepped(start, bags, 30).state.collect()}
    norm = topics.digamma(sum(before.values()))
    beta = {t: np.exp(topics.digamma(w) - norm) for t, w in before.items()}
    stat, rho = defaultdict(lambda: np.zeros(3)), 3.0**-0.5
    for _, text in rows:
        bag = Counter(text.split())
        names = sorted(bag)
        _, s, _ = topics.infer_one(np.array([bag[t] for t in names], float), np.array([beta[t] for t in names]))
        for t, x in zip(names, s, strict=True):
            stat[t] = stat[t] + x
    for t, w in before.items():
        assert np.allclose(after[t], (1 - rho) * w + rho * (0.01 + stat[t]), rtol=1e-9)


def test_passes_raise_the_bound(spark):
    docs = spark.createDataFrame(planted(60, 9), "doc_id long, text string")
    bags = topics.words(docs)
    bound = lambda m: topics.inferred(m, bags).where("term IS NULL").agg({"bound": "sum"}).first()[0]
    assert bound(topics.fit(bags, passes=1, updates=1)) < bound(topics.fit(bags, passes=4, updates=1))
    assert topics.fit(bags.limit(0)).documents == 0


def test_terms_go_in_few_rows_and_meet_by_number(spark, monkeypatch):
    monkeypatch.setattr(topics, "PART", 40)
    monkeypatch.setattr(topics, "CHARACTERS", 1500)
    docs = spark.createDataFrame(planted(60, 4), "doc_id long, text string")
    blocks = topics.cut(topics.packed_texts(docs, 2))
    dealt, held = topics.deal(blocks, 3), {r.block: r.terms for r in blocks.collect()}
    names = {r.part: r.terms for r in dealt.terms.collect()}
    assert len(names) > 2 and len(held) > 4 and sorted(t for part in names.values() for t in part) == sorted({t for some in held.values() for t in some})
    asks = dealt.asks.collect()
    # Arrays: a row for a block and a part at most, and every place of a block is asked for once.
    assert len({(r.block, r.part) for r in asks}) == len(asks) < sum(map(len, held.values())) / 2
    for block, some in held.items():
        got = {at: names[r.part][i] for r in asks if r.block == block for at, i in zip(r.places, r.ids, strict=True)}
        assert [got[at] for at in range(len(some))] == some
    first = {r.term: r.weights for r in topics._state(dealt, 3).collect()}
    assert first == {r.term: r.weights for r in topics.new_terms(topics.words(docs), 3).collect()}
    # A model of some documents knows no other terms; what it infers does not depend on how they were dealt.
    model = topics.fit(blocks)
    other = spark.createDataFrame(planted(30, 8) + [(500, "nobody nobody knows these other words")], "doc_id long, text string")
    gammas = lambda m: {r.doc: r.stat for r in topics.inferred(m, topics.words(other)).where("term IS NULL").collect()}
    many = gammas(model)
    assert set(many) == {str(i) for i in range(30)} and {r.term for r in topics.inferred(model, topics.words(other)).where("doc IS NULL").collect()} <= set(first)
    monkeypatch.setattr(topics, "PART", 500_000)
    one = gammas(model)
    assert all(np.allclose(many[d], one[d], rtol=1e-9) for d in many)


def test_counted_words(spark):
    texts = ["Alpha be2ta gamma_x The over abc, \u00e9cole cole\u00e9 ab abc\U0001d400 \U0001d400abc x-ray-tube 9abc", "", None, "\u0130stanbul KELVIN\u212a don't"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    plain = topics.F.filter(topics.T.letters(topics.F.col("text")), lambda w: (topics.F.length(w) > 2) & ~w.isin(*topics.T.KEYWORD_STOP_WORDS))
    rows = docs.select("k", topics.counted(topics.F.col("text")).alias("got"), plain.alias("want")).orderBy("k").collect()
    assert all(r.got == r.want for r in rows) and rows[0].got == ["alpha", "abc", "ray", "tube"]
