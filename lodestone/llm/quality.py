"""Quality rules: plain text statistics, and a hashed n-gram logistic regression.

The classifier sees hashed word unigrams and bigrams and hashed character trigrams,
each group as relative frequencies. It is fitted on the driver from a bounded
sample of labelled rows, calibrated by Platt's method on a fifth of that sample,
and scored in Arrow batches: a score is three averages of looked-up weights.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; where labels hold fewer than ``MIN_CLASS`` rows of either class the
verdict is the base rules' alone; repeated rows are scored each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import labelled_sample, short_batches, text_bytes

#: Bounds of the labelled sample: rows, and bytes of a text.
SAMPLE_ROWS, SAMPLE_BYTES, MIN_CLASS = 4000, 40_000, 20
BITS = 16
#: A document is kept where the calibrated probability of good quality reaches this.
KEEP_AT = 0.35
#: Base rules: fewer words than this, or more than this percentage of repeated words, fail.
MIN_WORDS, MAX_REPEATED = 10, 20

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
_NOT_CODE_POINTS = SPACES + bytes(range(0x80, 0xC0))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words whose hash a worker keeps.
CACHE_SIZE = 500_000


class WordHashes(dict):
    """Word -> 64-bit hash, within bounds."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key ^ (key >> np.uint64(29))) * _M1 + hashes[k : k + n]
    key = key * _M2
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(raw: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    n, repeated = len(words), repeated_words(hashes)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    return n, len(raw.translate(None, _NOT_CODE_POINTS)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed


def buckets(raw: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashed features by group: word unigrams, word bigrams, trigrams of code points."""
    down = np.uint64(64 - BITS)
    one = (hashes * _M1) >> down
    two = ((hashes[:-1] * _M2 ^ hashes[1:]) * _M1) >> down
    c = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    three = ((c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)) * _M1) >> down
    return [one.astype(np.int64), two.astype(np.int64), three.astype(np.int64)]


#: Scale of the relative frequencies of each group.
GROUP_SCALE = (12.0, 6.0, 40.0)


class Model:
    """Weights of the three groups, a bias, and the calibration's slope and shift."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def raw_score(self, raw: bytes, hashes: np.ndarray) -> float:
        s = self.bias
        for g, at in enumerate(buckets(raw, hashes)):
            if len(at):
                s += GROUP_SCALE[g] * float(self.weights[g][at].mean())
        return s

    def probability(self, raw: bytes, hashes: np.ndarray) -> float:
        z = self.slope * self.raw_score(raw, hashes) + self.shift
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def fit(sample: list[tuple[bytes, int]], steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Model | None:
    """Logistic regression by Adam over all rows; every fifth row calibrates."""
    if min(sum(y for _, y in sample), sum(1 - y for _, y in sample)) < MIN_CLASS:
        return None
    cache, rows, cols, vals, ys = WordHashes(), [], [], [], []
    for i, (raw, y) in enumerate(sample):
        for g, at in enumerate(buckets(raw, cache.of(raw.split()))):
            if len(at):
                u, n = np.unique(at, return_counts=True)
                rows.append(np.full(len(u), i))
                cols.append(u + (g << BITS))
                vals.append(GROUP_SCALE[g] * n / len(at))
        ys.append(y)
    row, col, val, y = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), np.array(ys, float)
    train = np.arange(len(y)) % 5 != 0
    used, col = np.unique(col, return_inverse=True)
    mine = train[row]
    r, c, v = row[mine], col[mine], val[mine]
    w, bias = np.zeros(len(used)), 0.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(r, v * w[c], len(y)) + bias
        err = np.where(train, 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y, 0) / train.sum()
        grad = np.append(np.bincount(c, v * err[r], len(used)) + decay * w, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    z = np.bincount(row, val * w[col], len(y)) + bias
    slope, shift = platt(z[~train], y[~train])
    weights = np.zeros(3 << BITS)
    weights[used] = w
    return Model(weights.reshape(3, -1).astype(np.float32), float(bias), slope, shift)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of Platt's calibration, by Newton's method on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = np.array([((p - goal) * z).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        k = p * (1 - p)
        h = np.array([[(k * z * z).sum() + 1e-3, (k * z).sum()], [(k * z).sum(), k.sum() + 1e-9]])
        d = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -2, 2))
    return max(a, 1e-3), b


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base verdict, calibrated probability of good quality, and whether the row is kept."""
    spark = docs.sparkSession
    short_batches(spark)
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, "quality", rows, SAMPLE_BYTES)))
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = WordHashes(), model.value
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                words = raw.split()
                hashes = cache.of(words)
                stats = statistics(raw, words, hashes)
                p = m.probability(raw, hashes) if m else 1.0
                out.append((*stats, p, not stats[-1] and p >= keep_at))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    out = docs.select(F.col(key).alias("key"), text_bytes(text).alias("b"))
    return out.mapInArrow(score, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean").withColumnRenamed("key", key)
