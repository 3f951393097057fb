"""N-gram Jaccard join: exact links between texts, by prefixes under several global token orders.

Two sets with Jaccard similarity t or more share an element among the first
n - ceil(t * n) + 1 of each under *any* global order, and l elements where both
prefixes are longer by l - 1. Orders here put rare shingles first, by class of a
corpus-wide count sketch, and then all but one residue of a hash, another one
for each order; so every shingle of a prefix serves two orders of three, and one
posting carries the orders in which it counts. The way of a text:

1. Texts with equal word sequences form one class; from here on classes are linked.
2. A pass over all texts fills a fixed-size count sketch of shingles.
3. Each class posts its prefixes. Where a shingle's postings meet, each pair is
   told with the orders they share; sums over all shingles intersect the orders'
   filters, and only pairs that met often enough under every order are candidates.
   A common shingle never makes pairs: it becomes a node that its classes are tied
   to. Pairs that such a node ties already are not told again, so the edges grow
   with the postings, not with the square of a group.
4. Candidates and ties form clusters, which are cut into parts of bounded bytes.
   Where two parts meet, each pair passes the prefixes of all orders once more
   and is then verified on the whole sets.
5. A block sends its links' spanning forest and each class's number of links;
   components of those forests are the result.

A text's set, links and component do not depend on partitioning. Shingles are
64-bit hashes, classes 64-bit digests; a wrong match needs a collision.

Defined results: a null or empty text, or one of white space, has no shingles and is its
own component; fewer words than a shingle are one shingle; repeated ids count as
one document with the union of their links; rows without an id take no part; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, short_batches, text_bytes
from lodestone.llm.components import connected_components

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 4, 85
#: Global token orders that are intersected.
ORDERS = 3
#: A shingle counted this often above the sketch's background is common, and so is one with more postings than GROUP.
COMMON, GROUP = 48, 64
#: Sketch cells: 8 a document, within these powers of 2 (the largest: 16 MB to the driver and to each worker). Where the
#: corpus outgrows the largest, orders tell fewer common shingles apart; groups stay bounded by GROUP all the same.
LEAST_BITS, MOST_BITS = 14, 24
#: Classes of a part (more in large clusters, by the square root) and bytes of its sets.
PART, PART_BYTES = 256, 16_000_000
#: Postings of a bucket that meets in one task, on average, and postings a task holds before it sends them.
BUCKET, HELD = 200_000, 250_000
#: Pairs that are held at a time where postings meet.
PAIRS = 500_000
#: Common shingles by which a class tells others that both are tied.
HINTS = 3
#: A posting: shingle, class, set size, common shingles of its prefix, and the orders whose prefix holds it.
POST = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("common", "u1"), ("mask", "u1")])
#: What a class with common shingles in its plain prefix says of itself.
HINT = np.dtype([("cls", "<i8"), ("hints", "<u8", (HINTS,))])
#: Bits of the filters that tell which classes need their sets again and which ids need a look: at least 1 MB, at most 16 MB.
#: Beyond that, filters let more through and exact joins do the rest.
LEAST_FILTER, MOST_FILTER = 23, 27

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9)]
CACHE_SIZE = 120_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = h
        return h


def mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[k % len(_M)]
    x = (x ^ (x >> np.uint64(29))) * _M[(k + 1) % len(_M)]
    return x ^ (x >> np.uint64(32))


def words_of(raw: bytes) -> list[bytes]:
    """ASCII letters in lower case, split at ASCII white space."""
    return raw.lower().split()


def shingles(words: list[bytes], cache: dict, width: int = WIDTH) -> np.ndarray:
    """Hashes of all shingles in order, repeats included; the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    key = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        key = mixed(key) + h[k : k + n]
    return mixed(key, 2)


def class_of(words: list[bytes]) -> int:
    """64-bit digest of the word sequence, as a signed number."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
    return h - (1 << 64) if h >= 1 << 63 else h


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Elements of which two linked sets of size ``n`` and any other size share one under any order."""
    return n - -(-percent * n // 100) + 1


def least_shared(n):
    """Elements that linked sets share, where prefixes are longer by one less: 1 in 12 of the smaller set, 16 at most."""
    return np.minimum(16, np.maximum(1, (n + 11) // 12))


def is_common(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    bits = int(ranks.size).bit_length() - 1
    return ranks[(s >> np.uint64(64 - bits)).astype(np.int64)] >= 128


def sketch(docs: DataFrame, bits: int, width: int = WIDTH) -> np.ndarray:
    """Rarity class of each cell of shingles of ``width`` words: 0 for the background, then doublings; over 127 for common shingles.

    A task counts each word sequence once and sends its counts in compressed blocks, which take no more
    than its own shingles do; blocks are summed on executors, in two rounds, so that no task adds up
    those of all others. The driver gets one byte a cell, the count's logarithm in steps of an eighth.
    """
    size, block = 1 << bits, 1 << min(bits, 17)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cache, seen, total = np.zeros(size, np.int64), WordHashes(), set(), 0
        for batch in batches:
            found = []
            for raw in batch.column(0).to_pylist():
                words = words_of(raw)
                c = class_of(words)
                if words and c not in seen:
                    if len(seen) >= CACHE_SIZE:
                        seen.clear()
                    seen.add(c)
                    found.append(shingles(words, cache, width))
            if found:
                at = np.concatenate(found) >> np.uint64(64 - bits)
                total += len(at)
                cells += np.bincount(at.astype(np.int64), minlength=size)
        if total:
            parts = np.minimum(cells, 0xFFFF).astype("<u4").reshape(-1, block)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "cells": pa.array([packed(p) for p in parts], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for c in pdf["cells"]:
            total += unpacked(c, block)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "cells": [packed(np.minimum(total, 1 << 31).astype("<u4"))]})

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        total = unpacked(add(pdf)["cells"].iloc[0], block)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "total": [int(total.sum())], "logs": [np.round(8 * np.log2(total + 1.0)).astype(np.uint8).tobytes()]})

    each = docs.mapInArrow(count, "block int, cells binary").withColumn("_r", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = each.groupBy("block", "_r").applyInPandas(add, "block int, cells binary")
    rows = some.groupBy("block").applyInPandas(shrink, "block int, total long, logs binary").collect()
    logs = np.zeros(size, np.uint8)
    for r in rows:
        logs[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.logs), np.uint8)
    background = 1.3 * sum(r.total for r in rows) / size + 3
    counts = np.round(np.exp2(np.arange(256) / 8) - 1)
    above = np.maximum(counts - background, 0)
    ranks = np.where(above > 0, np.floor(np.log2(above + 1)), 0)
    return np.where(counts >= COMMON + background, 128 + ranks, ranks).astype(np.uint8)[logs]


def packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), "<u4")


def ordered(s: np.ndarray, ranks: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles under a global order: rarity class first, then all but the order's own residue, then a hash."""
    bits = int(ranks.size).bit_length() - 1
    rank, h = ranks[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64), mixed(s)
    late = (h % np.uint64(ORDERS) == np.uint64(order)).astype(np.uint64)
    return (rank << np.uint64(56)) | (late << np.uint64(55)) | (h >> np.uint64(9))


def prefix(s: np.ndarray, ranks: np.ndarray, order: int, percent: int = PERCENT, more: int = 0) -> np.ndarray:
    """The distinct shingles ``s`` that come first under an order: a prefix, and ``more`` elements."""
    p = prefix_length(len(s), percent) + more
    return s[np.argpartition(ordered(s, ranks, order), p - 1)[:p]] if p < len(s) else s


def postings(s: np.ndarray, cls: int, ranks: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(postings, ties) of a class with shingles ``s``: its prefixes' rare shingles, and the plain prefix's common ones, rarest first."""
    n, hot = len(s), is_common(s, ranks)
    p, more = prefix_length(n, percent), int(least_shared(n)) - 1
    mask = np.zeros(n, np.uint8)
    for k in range(ORDERS):
        key = ordered(s, ranks, k)
        if k == 0:
            first = key
        mask[np.argpartition(key, p + more - 1)[: p + more] if p + more < n else slice(None)] |= np.uint8(1 << k)
    rare = np.flatnonzero(~hot & (mask > 0))
    out = np.zeros(len(rare), POST)
    # Rare shingles come first under each order, so all orders' prefixes hold equally many common ones.
    few = int((~hot).sum())
    out["token"], out["cls"], out["n"], out["mask"], out["common"] = s[rare], cls, n, mask[rare], min(255, max(0, min(n, p + more) - few))
    if few >= p:
        return out, s[:0]
    by = np.argsort(first)[:p]
    return out, s[by[hot[by]]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: Bits for each order's count in a pair's sum of meetings.
COUNT_BITS = 20


def pairs_in_groups(posts: np.ndarray, hints: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, ties) from all postings of some shingles.

    Pairs (a, b, need, times): classes that meet at a shingle and whose sizes allow a link; ``times`` counts, in
    COUNT_BITS for each order, the shingles that both prefixes under that order hold. A link needs ``need`` of them under
    each order: common shingles of the prefixes, which meet elsewhere, may stand in for as many. Where both classes have
    common shingles in their plain prefixes, these may stand in for all of an order's but the first one's, whose plain
    prefixes share a common shingle, or else a rare one. A pair that a common hint ties already is left out.

    Ties (class, shingle): postings of shingles with more than GROUP of them, which make no pairs.
    """
    posts = posts[np.lexsort((posts["cls"], posts["token"]))]
    same = (posts["token"][1:] == posts["token"][:-1]) & (posts["cls"][1:] == posts["cls"][:-1])
    posts = posts[np.append(True, ~same)] if len(posts) else posts
    t = posts["token"]
    starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(t)))
    of = np.repeat(sizes, sizes)
    ties = np.stack([posts["cls"][of > GROUP], signed(t[of > GROUP])], 1)
    posts = posts[(of > 1) & (of <= GROUP)]
    t, c, n, common, mask = (posts[k] for k in ("token", "cls", "n", "common", "mask"))
    hints = hints[np.unique(hints["cls"], return_index=True)[1]]
    at = np.clip(np.searchsorted(hints["cls"], c), 0, max(0, len(hints) - 1))
    tied = (hints["cls"][at] == c) if len(hints) else np.zeros(len(c), bool)
    mine = np.where(tied[:, None], hints["hints"][at], 0) if len(hints) else np.zeros((len(c), HINTS), np.uint64)
    out = [np.zeros((0, 4), np.int64)]
    for d in range(1, GROUP):
        i = np.flatnonzero(t[d:] == t[:-d])
        if not len(i):
            break
        j = i + d
        ok = (100 * np.minimum(n[i], n[j]).astype(np.int64) >= percent * np.maximum(n[i], n[j]).astype(np.int64)) & (mask[i] & mask[j] > 0)
        both = np.flatnonzero(ok & tied[i] & tied[j])
        for x in range(HINTS):
            for y in range(HINTS):
                ok[both] &= ~((mine[i[both], x] == mine[j[both], y]) & (mine[i[both], x] > 0))
        i, j = i[ok], j[ok]
        stand = np.minimum(common[i], common[j]).astype(np.int64)
        need = least_shared(np.minimum(n[i], n[j])) - stand
        need = np.where(tied[i] & tied[j], np.maximum(need, 0), np.maximum(need, 1))
        shared = (mask[i] & mask[j]).astype(np.int64)
        times = sum(((shared >> k) & 1) << (COUNT_BITS * k) for k in range(ORDERS))
        out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), need, times], 1))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))) if len(rows) else np.zeros(0, np.int64)
    pairs = rows[first]
    if len(rows):
        pairs[:, 3] = np.add.reduceat(rows[:, 3], first)
    return pairs, ties


def in_chunks(posts: np.ndarray, most: int = PAIRS) -> Iterator[np.ndarray]:
    """Postings in chunks of whole shingles that make about ``most`` pairs; a shingle that one posting holds is left out.

    Shingles with the same least class lie side by side, so most of a pair's meetings fall into one chunk.
    """
    posts = posts[np.lexsort((posts["cls"], posts["token"]))]
    sizes = np.unique(posts["token"], return_counts=True)[1]
    posts, sizes = posts[np.repeat(sizes, sizes) > 1], sizes[sizes > 1]
    if not len(posts):
        return
    least = posts["cls"][np.cumsum(sizes) - sizes]
    by = np.argsort(least, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    posts, sizes = posts[np.argsort(np.repeat(rank, sizes), kind="stable")], sizes[by]
    meeting = np.minimum(sizes, GROUP)
    chunk = np.cumsum(meeting * (meeting - 1) // 2 + sizes) // most
    ends = np.cumsum(sizes)[np.append(chunk[1:] != chunk[:-1], True)]
    for lo, hi in itertools.pairwise([0, *ends.tolist()]):
        yield posts[lo:hi]


def block_links(ids: np.ndarray, sets: list[np.ndarray], part: np.ndarray, ranks: np.ndarray, percent: int = PERCENT, orders: int = ORDERS) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a block: between its two parts, or within its only one.

    Returns the links and each class's number of links. For one class at a time,
    the classes that share prefix tokens under the first order are looked up in
    an inverted file, the other orders' files narrow them down, and what is left
    is verified with a file of the whole sets.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    two = len(np.unique(part)) > 1

    def file(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        token, owner = np.concatenate(lists), np.repeat(np.arange(n), [len(x) for x in lists])
        by = np.argsort(token, kind="stable")
        return token[by], owner[by]

    def shared(f: tuple[np.ndarray, np.ndarray], mine: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(f[0], mine, "left"), np.searchsorted(f[0], mine, "right")
        m = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
        return np.bincount(f[1][at], minlength=n)

    prefixes = [[prefix(s, ranks, k, percent) for s in sets] for k in range(orders)]
    files, whole = [file(p) for p in prefixes], file(sets)
    links, degree = [], np.zeros(n, np.int64)
    for i in range(n):
        may = (np.arange(n) > i) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if two:
            may &= part != part[i]
        for f, p in zip(files, prefixes, strict=True):
            if not may.any():
                break
            may &= shared(f, p[i]) > 0
        if not may.any():
            continue
        inter = shared(whole, sets[i])
        yes = np.flatnonzero(may & (100 * inter >= percent * (sizes + sizes[i] - inter)))
        degree[i] += len(yes)
        degree[yes] += 1
        links += [(i, int(j)) for j in yes]
    return links, degree


def forest(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def described(rows: DataFrame, ranks, width: int, percent: int) -> DataFrame:
    """All that a pass over the texts gives, written to the shared folder; ``kind`` tells the rows apart:
    0 members (a id, b class or null, x set size), 1 ties (a class, b shingle), 2 parts of pairs (a, b, x need, y times)."""
    facts = rows.agg(F.sum(F.length("b")).alias("bytes")).first()
    # About one posting for 16 bytes of text; a bucket for each shuffle partition at least.
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(facts.bytes or 0) // (16 * BUCKET)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, r, sent = WordHashes(), ranks.value, set()
        posts: list[np.ndarray] = []
        hints, members, ties, held = [], [], [], 0

        def send() -> pa.RecordBatch:
            nonlocal posts, hints, members, ties, held
            all_ = np.concatenate(posts) if posts else np.zeros(0, POST)
            bucket = (mixed(all_["token"], 1) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            all_, bucket = all_[by], bucket[by]
            known = np.array(hints, HINT) if hints else np.zeros(0, HINT)
            known = known[np.argsort(known["cls"], kind="stable")]
            out: list[tuple] = []
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(all_) else np.zeros(0, np.int64)
            for lo, hi in itertools.pairwise([*cuts.tolist(), len(all_)]):
                part = all_[lo:hi]
                out.append((int(bucket[lo]), part.tobytes(), known[np.isin(known["cls"], part["cls"])].tobytes() if len(known) else b"", None, None))
            if members:
                m = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*members, strict=True)], ["a", "b", "x"])
                at = int(np.int64(members[0][0])) % buckets
                out.append((at, b"", b"", _ipc(m), np.array(ties, np.int64).reshape(-1, 2).tobytes()))
            posts, hints, members, ties, held = [], [], [], [], 0
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "posts", "hints", "members", "ties"])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(raw)
                if not words:
                    members.append((i, None, 0))
                    continue
                c, s = class_of(words), np.unique(shingles(words, cache, width))
                members.append((i, c, len(s)))
                if c not in sent:
                    if len(sent) >= CACHE_SIZE:
                        sent.clear()
                    sent.add(c)
                    p, t = postings(s, c, r, percent)
                    posts.append(p)
                    held += len(p) + len(t) + 1
                    if len(t):
                        hints.append((c, tuple(np.append(t[:HINTS], np.zeros(max(0, HINTS - len(t)), np.uint64)).tolist())))
                        ties += [(c, x) for x in signed(t).tolist()]
                if held >= HELD:
                    yield send()
        if members or posts:
            yield send()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        posts, hints = [], []
        for pdf in batches:
            posts.extend(pdf["posts"])
            hints.extend(pdf["hints"])
            own = pdf[pdf["members"].notna()]
            for m, t in zip(own["members"], own["ties"], strict=True):
                rows = pa.ipc.open_stream(m).read_all().to_pandas(types_mapper=lambda _: pd.Int64Dtype())
                yield rows.assign(kind=0, y=0)[["kind", "a", "b", "x", "y"]]
                yield _rows(1, np.frombuffer(t, np.int64).reshape(-1, 2))
        known = np.frombuffer(b"".join(hints), HINT)
        known = known[np.unique(known["cls"], return_index=True)[1]]
        for some in in_chunks(np.frombuffer(b"".join(posts), POST)):
            pairs, ties = pairs_in_groups(some, known, percent)
            yield _rows(2, pairs)
            yield _rows(1, ties)

    sent = rows.mapInArrow(describe, "bucket int, posts binary, hints binary, members binary, ties binary")
    return cut(sent.groupBy("bucket").applyInPandas(meet, "kind int, a long, b long, x long, y long"), "described")


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(kind: int, x: np.ndarray):
    cols = {"kind": np.full(len(x), kind), **{c: (x[:, k] if k < x.shape[1] else np.zeros(len(x), np.int64)) for k, c in enumerate(("a", "b", "x", "y"))}}
    return pd.DataFrame(cols).astype({c: "Int64" for c in ("a", "b", "x", "y")})


def meetings(parts: DataFrame) -> DataFrame:
    """(a, b) of pairs that meet often enough under each order, from ``parts`` (a, b, need, times) of their meetings.

    A part counts in COUNT_BITS what one chunk of postings holds, which is less than those bits tell; parts are summed
    an order at a time in longs, so that no number of meetings wraps.
    """
    share = lambda k: F.shiftright("times", COUNT_BITS * k).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    met = parts.groupBy("a", "b").agg(F.max("need").alias("need"), *[F.sum(share(k)).alias(f"t{k}") for k in range(ORDERS)])
    enough = F.col("t0") >= F.greatest("need", F.lit(1))
    for k in range(1, ORDERS):
        enough &= F.col(f"t{k}") >= F.col("need")
    return met.where(enough).select("a", "b")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, n_links) for every id.

    ``component_id`` is the smallest id that links reach; ``n_links`` counts the other texts (word
    sequences) that link with this one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text_bytes(text).alias("b"))
    bits = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(8 * max(1, rows.count())))))
    ranks = spark.sparkContext.broadcast(sketch(rows.select("b"), bits, width))
    seen = described(rows, ranks, width, percent)
    members = seen.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("cls"), F.col("x").alias("n"))
    full = members.where(F.col("cls").isNotNull())
    met = meetings(seen.where("kind = 2").select("a", "b", F.col("x").alias("need"), F.col("y").alias("times")))
    # A common shingle's node must not meet a class's: classes are even, shingles odd.
    even = lambda c, name: F.col(c).bitwiseAND(F.lit(-2)).alias(name)
    ties = seen.where("kind = 1").select(even("a", "a"), F.col("b").bitwiseOR(F.lit(1)).alias("b"))
    clusters = connected_components(met.select(even("a", "a"), even("b", "b")).union(ties))
    clusters = clusters.where(F.col("node").bitwiseAND(F.lit(1)) == 0).withColumnRenamed("node", "even")
    sizes = full.groupBy("cls").agg(F.max("n").alias("n")).select(even("cls", "even"), "n").groupBy("even").agg(F.sum("n").alias("n"))
    clusters = clusters.join(sizes, "even")
    large = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).where("m > 1")
    k = F.greatest(F.ceil(F.col("m") / F.greatest(F.lit(float(PART)), 4 * F.sqrt("m"))), F.ceil(8 * F.col("all") / PART_BYTES))
    clusters = cut(clusters.join(large.select("label", k.cast("int").alias("k")), "label").drop("n"), "clusters")

    # Which classes need their sets: a filter of fixed size, whose false hits the join removes.
    needed = spark.sparkContext.broadcast(id_filter(clusters.select("even")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, want, sent = WordHashes(), np.unpackbits(needed.value), set()
        for batch in batches:
            cls, sets = [], []
            for raw in batch.column(0).to_pylist():
                words = words_of(raw)
                if not words:
                    continue
                c = class_of(words)
                if c not in sent and want[filter_cell(np.array([c & -2], np.int64), want.size)[0]]:
                    if len(sent) < CACHE_SIZE:
                        sent.add(c)
                    cls.append(c)
                    sets.append(np.unique(shingles(words, cache, width)).tobytes())
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "s": pa.array(sets, pa.binary())})

    sets = rows.select("b").mapInArrow(sets_of, "cls long, s binary").withColumn("even", F.col("cls").bitwiseAND(F.lit(-2)))
    # Dealt once by what the next join needs; a task sends a class once, so copies hardly show here.
    one = sets.repartition("even").groupBy("even", "cls").agg(F.first("s").alias("s"))
    dealt = one.join(clusters, "even").withColumn("p", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    blocks = dealt.select("label", "cls", "s", "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    blocks = blocks.select("label", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"), "cls", "p", "s")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", kind="stable")
        ids, part = pdf["cls"].to_numpy(np.int64), pdf["p"].to_numpy()
        out = []
        single = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        if len(ids) > 1 and (single or len(np.unique(part)) > 1):
            links, degree = block_links(ids, [np.frombuffer(s, np.uint64) for s in pdf["s"]], part, ranks.value, percent)
            out = [(int(ids[i]), int(ids[j]), 0) for i, j in forest(len(ids), links)]
            out += [(int(ids[i]), None, int(d)) for i, d in enumerate(degree) if d]
        return pd.DataFrame({c: pd.array([r[k] for r in out], dtype="Int64") for k, c in enumerate(("a", "b", "links"))})

    linked = cut(blocks.groupBy("label", "lo", "hi").applyInPandas(verify, "a long, b long, links long"), "links")
    degrees = linked.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n_links"))
    joined = connected_components(linked.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "label")
    # Classes of one id (repeated rows) belong together as well.
    classes = full.groupBy("cls").agg(F.min("id").alias("least"))
    named = classes.join(joined, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "label").join(degrees, "cls", "left").select("cls", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Texts without words have no class to meet at.
    alone = members.where(F.col("cls").isNull()).select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    by_row = full.join(by_class, "cls").select("id", "n", "component_id", "n_links").unionByName(alone)
    out = by_row.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"), F.max("n_links").cast("long").alias("n_links"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: that with the smallest id, once
    (of repeated ids the row with the smallest text). Rows without an id stay."""
    parts = link_components(docs, key, text, width, percent)
    going = cut(parts.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_id")), "going")
    repeated = cut(docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_id"), "repeated")
    # Most rows go by a look at a filter of ids and never leave their task; only those it marks are joined, texts and all.
    marks = docs.sparkSession.sparkContext.broadcast(id_filter(going.union(repeated)))

    @F.pandas_udf("boolean")
    def marked(ids: pd.Series) -> pd.Series:
        bits = np.unpackbits(marks.value) if ids.notna().any() else np.zeros(1, np.uint8)
        return pd.Series(bits[filter_cell(ids.fillna(0).to_numpy(np.int64), bits.size)] > 0)

    # Inside, columns go by place, so that no name of the input meets one of ours.
    own = [f"c{k}" for k in range(len(docs.columns))]
    id_, words = (F.col(own[docs.columns.index(c)]) for c in (key, text))
    rows = docs.toDF(*own).withColumn("_id", id_.cast("long")).withColumn("_look", F.col("_id").isNotNull() & marked("_id"))
    looked = rows.where("_look").join(going, "_id", "left_anti")
    # Ids repeat in few rows, if at all; only these are put in order.
    once = F.row_number().over(Window.partitionBy("_id").orderBy(words.asc_nulls_first()))
    again = looked.join(repeated, "_id", "left_semi").withColumn("_once", once).where("_once = 1")
    parts_of = [rows.where("NOT _look"), looked.join(repeated, "_id", "left_anti"), again]
    return functools.reduce(DataFrame.unionByName, [x.select(*own) for x in parts_of]).toDF(*docs.columns)


def filter_cell(x: np.ndarray, size: int) -> np.ndarray:
    """Places of ids in a filter of ``size`` bits, a power of 2."""
    return (mixed(x.astype(np.int64).view(np.uint64), 3) >> np.uint64(65 - int(size).bit_length())).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of the cells of all ids in the only column, made of the tasks' own by a bitwise or."""
    bits = max(LEAST_FILTER, min(MOST_FILTER, math.ceil(math.log2(16 * max(1, ids.count())))))
    each = 1 << (bits - 9)  # bytes of a part, of 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[filter_cell(batch.column(0).to_numpy(), seen.size)] = True
        if seen.any():
            parts = np.packbits(seen).reshape(64, -1)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(64), pa.int32()), "bits": pa.array([pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(each, np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(pa.decompress(b, each, codec="zstd", asbytes=True), np.uint8)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [out.tobytes()]})

    rows = ids.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect()
    out = np.zeros((64, each), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()
