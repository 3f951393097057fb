import hashlib
import re

import pytest
from lodestone.llm import mixing
from lodestone.llm.common import documents


def fill(budget, children):
    """children: {name: (weight, cap)}; shares by repeated redistribution of what full children return."""
    share, open_, left = dict.fromkeys(children, 0.0), {k for k, (w, c) in children.items() if w > 0}, budget
    while open_ and left > 1e-9:
        total = sum(children[k][0] for k in open_)
        over = {k for k in open_ if share[k] + left * children[k][0] / total >= children[k][1]}
        if not over:
            for k in open_:
                share[k] += left * children[k][0] / total
            break
        total_share = {k: share[k] for k in open_}
        pool = left + sum(total_share.values())
        for k in over:
            share[k] = children[k][1]
        open_ -= over
        left = pool - sum(share[k] for k in over)
        for k in open_:
            share[k] = 0.0
    return share


def brute(rows, fraction, epochs=mixing.MAX_EPOCHS, weights=(mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS)):
    domains = {s: d for d, members in mixing.DOMAIN_OF_SOURCE.items() for s in members}
    docs = [(i, domains.get(s, "other"), la or "?", s or "?", len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))) for i, t, la, s in rows]
    tokens = {}
    for _, *leaf, n in docs:
        tokens[tuple(leaf)] = tokens.get(tuple(leaf), 0) + n
    weight = lambda level, name: weights[level].get(name, 1.0)
    usable = {k: epochs * n * all(weight(j, x) > 0 for j, x in enumerate(k)) for k, n in tokens.items()}
    cap = lambda *p: sum(n for k, n in usable.items() if k[: len(p)] == p)
    out = []
    shares = fill(int(sum(tokens.values()) * fraction), {d: (weight(0, d), cap(d)) for d, _, _ in tokens})
    for d, b in shares.items():
        langs = fill(b, {la: (weight(1, la), cap(d, la)) for dd, la, _ in tokens if dd == d})
        for la, b2 in langs.items():
            leaves = fill(b2, {s: (weight(2, s), cap(d, la, s)) for dd, ll, s in tokens if (dd, ll) == (d, la)})
            for s, b3 in leaves.items():
                budget, n = int(b3 + 1e-6), tokens[(d, la, s)]
                whole = budget // n if n else 0
                mine = [(i, t) for i, *leaf, t in docs if tuple(leaf) == (d, la, s)]
                out += [(i, e) for e in range(whole) for i, _ in mine]
                rest, groups = budget - whole * n, {}
                for i, t in mine:
                    key = hashlib.md5(f"{mixing.SEED}:{whole}:{'?' if i is None else i}".encode()).hexdigest()
                    groups.setdefault(key, []).append((i, t))
                for key in sorted(groups):
                    if rest <= 0:
                        break
                    out += [(i, whole) for i, _ in groups[key]]
                    rest -= sum(t for _, t in groups[key])
    return sorted(out, key=str)


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.9, 1.0, 1.7, 5.0])
def test_matches_brute_force(spark, sf, odd_documents, fraction):
    for docs in (documents(spark, sf), odd_documents):
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        got = mixing.mix(docs, fraction)
        assert got.columns == [*docs.columns, "epoch"]
        assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == brute(rows, fraction)


def test_empty(spark, odd_documents):
    assert mixing.mix(odd_documents.limit(0), 0.5).count() == 0


ZERO = ({"web": 0.0, "forum": 2.0}, {"en": 0.0, "fr": 2.0}, {"src9": 0.0, "src15": 0.0, "src2": 3.0})


@pytest.mark.parametrize("fraction", [0.2, 0.6, 1.5])
def test_weights_of_zero_return_their_budget(spark, sf, fraction):
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    got = mixing.mix(docs, fraction, domain_weights=ZERO[0], lang_weights=ZERO[1], source_weights=ZERO[2])
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == brute(rows, fraction, weights=ZERO)


def test_a_barred_source_leaves_its_budget_to_a_sibling_language(spark):
    rows = [(k, "w " * 10, "en", "b") for k in range(100)] + [(100 + k, "w " * 10, "en", "a") for k in range(5)] + [(200 + k, "w " * 10, "fr", "a") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(df, 1000 / 2050, max_epochs=1, domain_weights={}, lang_weights={}, source_weights={"b": 0})
    assert 990 <= 10 * mixed.count() <= 1010 and mixed.where("source = 'b'").count() == 0


def test_names_do_not_clash(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), "en", f"src{k % 3}", k, "x", k, None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Epoch int, _lang string, c0 int, _key string")
    for most in (mixing.BROADCAST_LEAVES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", most)
        got = mixing.mix(df, 0.7)
        assert got.columns == [*df.columns, "epoch_"]
        assert sorted(((r.doc_id, r.epoch_) for r in got.collect()), key=str) == brute([r[:4] for r in rows], 0.7)
        assert all(r.Epoch == r.doc_id == r.c0 and r._lang == "x" and r._key is None for r in got.collect())
