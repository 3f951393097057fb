import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from lodestone.llm import packing
from lodestone.llm.common import cut, documents
from pyspark.sql import functions as F


def check_packing(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def brute(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(30))
def test_histogram_packing_is_valid_and_as_good_as_best_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 50, 100, 4096])
    counts = {rnd.randint(1, capacity): rnd.choice([1, 2, 3, 50]) for _ in range(rnd.randint(1, 40))}
    placed, rank = [], defaultdict(int)
    for length, n, per, first, offset in packing.pack_histogram(counts, capacity):
        for k in range(n):
            placed.append({"sequence_id": first + k // per, "offset": offset + (k % per) * length, "length": length})
        rank[length] += n
    assert dict(rank) == counts
    used = check_packing(placed, capacity)
    bins = []  # plain best-fit decreasing
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        room = [b for b in bins if b >= x]
        if room:
            bins.remove(min(room))
        bins.append((min(room) if room else capacity) - x)
    assert used <= len(bins)


def exact_bins(items, capacity):
    """The least number of sequences, by search."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins.index(bins[i]) == i:
                bins[i] += items[k]
                go(k + 1, bins)
                bins[i] -= items[k]
        bins.append(items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_dominance_keeps_an_optimum(seed):
    rnd = random.Random(seed)
    items = sorted((rnd.randint(2, 20) for _ in range(9)), reverse=True)
    counts = defaultdict(int)
    for x in items:
        counts[x] += 1
    inst = packing.Instance(counts, 20)
    fixed = sum(times for _, times in packing.dominance(inst))
    rest = [x for x, n in inst.counts.items() for _ in range(n)]
    assert fixed + (exact_bins(sorted(rest, reverse=True), 20) if rest else 0) == exact_bins(items, 20)


def test_pieces_are_the_tokenizers(spark, sf, odd_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    for docs in (documents(spark, sf).select("doc_id", "text"), odd_documents):
        ids = defaultdict(list)
        for r in packing.tokenise(docs).collect():
            ids[(r.doc_id, r.start)].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
        want = defaultdict(list)
        for r in docs.collect():
            whole = brute(r.text, tokenizer)
            for k in range(0, len(whole), 4096):
                want[(r.doc_id, k)].append(whole[k : k + 4096])
        assert ids == want


def test_words_go_the_tokenizers_way():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rnd, words = random.Random(9), packing.word_ids(packing.vocabulary_path())
    pool = [*"abcXYZ.,;:!?'\"-<|>09 \n\t\x1c\x85\xa0\u3000", *"éÉßİıſKΣςάǅ×÷ñŸ\u0301\u00ad中\U0001f600\u0d41", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "the", "Straße", "été,", "..."]
    for _ in range(4000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        got = np.frombuffer(words.of(text.encode()), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents_are_packed_whole(spark, sf, odd_documents):
    for docs in (documents(spark, sf), odd_documents):
        rows = packing.packed_documents(docs).collect()
        used = check_packing(rows, 4096)
        assert used <= -(-sum(r.length for r in rows) // 4096) * 1.1 + 1
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
        assert packing.packed_documents(docs.limit(0)).count() == 0
    empty = [r for r in rows if r.doc_id == 1]
    assert [(r.length, r.ids_crc32) for r in empty] == [(1, zlib.crc32((1).to_bytes(4, "little")))]


def test_ranks_survive_one_common_length(spark):
    pieces = cut(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1000).cast("long").alias("length")), "t")
    assert check_packing(packing.pack(pieces).collect(), 4096) == 1250
