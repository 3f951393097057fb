"""Toxicity by a linear-chain conditional random field.

Labels mark documents, so labelled tokens are derived first: words that occur in
toxic training documents and hardly in clean ones are tagged toxic where a toxic
document holds them. A two-state chain with features of the word and of both
neighbours is fitted to sentences so tagged, by exact gradients. Scoring runs
forward-backward over each whole text and turns the marginals into a document
score, calibrated on the training documents, and into offending offsets.

Most tokens carry no feature and share one potential. Runs of them are a power
of one 2x2 matrix, taken in closed form, so the exact recursion only visits the
tokens that matter and their neighbours.

Inputs of a score are the text alone. Documents whose crc32(id) mod 5 is 0 are
never used in training.

Defined results: a null or empty text gets the score of a text without toxic
tokens; where the training labels hold fewer than ``MIN_CLASS`` rows of either
class every score is the smoothed share of toxic labels; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, labelled_sample, short_batches, text_bytes

#: Bounds of the labelled sample: rows, and bytes of a text.
SAMPLE_ROWS, SAMPLE_BYTES, MIN_CLASS = 4000, 40_000, 5
#: A tag word occurs in this many distinct toxic documents at least, mostly in toxic ones, and against the odds.
TAG_DOCS, TAG_SHARE, TAG_PRECISION, TAG_ODDS = 3, 0.015, 0.8, 2.5
#: Pieces of sentences that the chain is fitted on, half with a tag word, and their longest length in tokens.
SENTENCES, LONGEST = 6000, 64
#: A token whose marginal reaches this is an offending one.
SPAN_AT = 0.5
CACHE_SIZE = 120_000

EDGES = b".,;:!?*#%&$|<>\"'()[]{}-_~`+=/\\"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Digits and signs that stand for letters in disguised words.
LOOKALIKES = bytes.maketrans(b"013457@$", b"oieastas")


def normal(word: bytes) -> bytes:
    """Lower case, without punctuation at the edges."""
    return word.lower().strip(EDGES)


def disguised(word: bytes) -> bytes:
    """The plain form of a word whose letters were exchanged for look-alikes."""
    return word.translate(LOOKALIKES)


class Codes(dict):
    """Raw word -> index of its tag word, 0 if it is none."""

    def __init__(self, tags: list[bytes]):
        super().__init__()
        self.tags = {w: k + 1 for k, w in enumerate(tags)}

    def __missing__(self, word: bytes) -> int:
        plain = normal(word)
        code = self.tags.get(plain) or self.tags.get(disguised(plain), 0)
        if len(word) <= 64:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Chain:
    """Potentials: a bias of the toxic state, weights of the word and of its neighbours, and four transitions."""

    def __init__(self, tags: list[bytes]):
        n = len(tags) + 1
        self.tags = tags
        self.bias, self.here, self.left, self.right = -3.0, np.zeros(n), np.zeros(n), np.zeros(n)
        self.move = np.zeros((2, 2))

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Log potential of the toxic state over the other, by token; works on rows of sentences too."""
        e = self.bias + self.here[codes]
        e[..., 1:] += self.left[codes[..., :-1]]
        e[..., :-1] += self.right[codes[..., 1:]]
        return e

    def marginals(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, probability of the toxic state there) for the tokens with a feature and their neighbours."""
        n = len(codes)
        events = np.flatnonzero(codes)
        at = np.unique(np.clip(np.concatenate([events - 1, events, events + 1]), 0, n - 1))
        if not len(events):
            return events, np.zeros(0)
        padded = np.concatenate([[0], codes, [0]])
        e = self.bias + self.here[padded[at + 1]] + self.left[padded[at]] * (at > 0) + self.right[padded[at + 2]] * (at < n - 1)
        t = np.exp(self.move)
        plain = t * np.exp(np.array([0.0, self.bias]))[None, :]  # step onto a token without features
        power = _powers(plain)
        emit = np.stack([np.zeros(len(at)), e], 1)
        emit = np.exp(emit - emit.max(1, keepdims=True))
        gaps = np.diff(at) - 1
        # Forward: the first token starts the chain with no transition.
        a, f = np.empty((len(at), 2)), None
        for k, p in enumerate(at.tolist()):
            if k == 0:
                if p == 0:
                    f = emit[0].copy()
                else:
                    f = np.array([1.0, math.exp(self.bias)]) @ power(p - 1) @ t * emit[0]
            else:
                f = (f @ power(int(gaps[k - 1])) @ t) * emit[k]
            f = f / f.sum()
            a[k] = f
        b, g = np.empty((len(at), 2)), power(int(n - 1 - at[-1])) @ np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            g = g / g.sum()
            b[k] = g
            if k:
                g = power(int(gaps[k - 1])) @ (t @ (emit[k] * g))
        m = a * b
        return at, m[:, 1] / m.sum(1)


def _powers(step: np.ndarray):
    """k -> step^k up to a factor, from the eigenvalues (real and distinct, as all entries are positive)."""
    values, vectors = np.linalg.eig(step)
    order = np.argsort(-values.real)
    values, vectors = values.real[order], vectors.real[:, order]
    inverse, ratio = np.linalg.inv(vectors), values[1] / values[0]
    first, second = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
    known: dict[int, np.ndarray] = {}

    def power(k: int) -> np.ndarray:
        if k not in known:
            known[k] = np.eye(2) if k == 0 else np.maximum(first + ratio**k * second, 0)
        return known[k]

    return power


def tag_words(sample: list[tuple[bytes, int]]) -> list[bytes]:
    """Words that mark toxic documents. Near copies of a document seen already do not count again."""
    toxic, clean, seen = Counter(), Counter(), set()
    n_toxic = n_clean = 0
    for raw, y in sample:
        words = raw.lower().split()
        runs = sorted({zlib.crc32(b" ".join(words[k : k + 8])) for k in range(0, max(1, len(words) - 7))})[:4]
        if len(words) >= 8 and seen.intersection(runs):
            continue
        seen.update(runs)
        found = {normal(w) for w in words}
        (toxic if y else clean).update(found)
        n_toxic, n_clean = n_toxic + y, n_clean + 1 - y
    least = max(TAG_DOCS, TAG_SHARE * n_toxic)
    odds = lambda w: math.log((toxic[w] + 0.5) / (n_toxic + 1)) - math.log((clean[w] + 0.5) / (n_clean + 1))
    return sorted(w for w, a in toxic.items() if w and a >= least and a >= TAG_PRECISION * (a + clean[w]) and odds(w) >= TAG_ODDS)


def fit_chain(sample: list[tuple[bytes, int]], tags: list[bytes], steps: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """Maximum likelihood on tagged sentences, by Adam on exact gradients.

    A long sentence counts in consecutive pieces; of too many pieces those with the smallest hash are taken.
    """
    chain, codes = Chain(tags), Codes(tags)
    tagged: list[tuple[int, np.ndarray, np.ndarray]] = []
    plain: list[tuple[int, np.ndarray, np.ndarray]] = []
    for raw, y in sample:
        for sentence in re.split(rb"(?<=[.!?\n])\s+", raw):
            whole = codes.of(sentence.split())
            for at in range(0, len(whole), LONGEST):
                c = whole[at : at + LONGEST]
                (tagged if c.any() else plain).append((zlib.crc32(b"%d" % at, zlib.crc32(sentence)), c, (c > 0) & bool(y)))
    rows = [(c, yy) for part in (tagged, plain) for _, c, yy in sorted(part, key=lambda p: p[0])[: SENTENCES // 2]]
    if not rows or not tags:
        return chain
    n, width = len(rows), max(len(c) for c, _ in rows)
    c, y, mask = np.zeros((n, width), np.int32), np.zeros((n, width)), np.zeros((n, width))
    for i, (cc, yy) in enumerate(rows):
        c[i, : len(cc)], y[i, : len(cc)], mask[i, : len(cc)] = cc, yy, 1
    last = mask.sum(1).astype(int) - 1
    size = len(tags) + 1
    both = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            both[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j)) * mask[:, 1:]).sum()
    m1 = m2 = 0.0
    for step in range(1, steps + 1):
        t = np.exp(chain.move)
        e = np.exp(np.clip(np.stack([np.zeros((n, width)), chain.emissions(c)], 2), -30, 30))
        f = np.zeros((n, width, 2))
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for k in range(1, width):
            x = (f[:, k - 1] @ t) * e[:, k]
            f[:, k] = x / x.sum(1, keepdims=True)
        b, pair = np.ones((n, width, 2)) / 2, np.zeros((2, 2))
        for k in range(width - 2, -1, -1):
            x = (e[:, k + 1] * b[:, k + 1]) @ t.T
            b[:, k] = np.where((k < last)[:, None], x / x.sum(1, keepdims=True), 0.5)
            joint = f[:, k, :, None] * t[None] * (e[:, k + 1] * b[:, k + 1])[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pair += (joint * mask[:, k + 1, None, None]).sum(0)
        p = f * b
        p = p[..., 1] / p.sum(2) * mask
        diff = (y - p) * mask
        grad = np.concatenate([
            [diff.sum()],
            np.bincount(c.ravel(), diff.ravel(), size),
            np.bincount(c[:, :-1].ravel(), diff[:, 1:].ravel(), size),
            np.bincount(c[:, 1:].ravel(), diff[:, :-1].ravel(), size),
            (both - pair).ravel(),
        ]) / n
        w = np.concatenate([[chain.bias], chain.here, chain.left, chain.right, chain.move.ravel()])
        grad[1 : 1 + 3 * size : size] = 0  # code 0 carries no weight
        grad -= decay * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w = w + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        chain.bias, chain.here, chain.left, chain.right, chain.move = float(w[0]), w[1 : 1 + size], w[1 + size : 1 + 2 * size], w[1 + 2 * size : 1 + 3 * size], w[1 + 3 * size :].reshape(2, 2)
    return chain


def summary(marginals: np.ndarray, n: int) -> list[float]:
    """What a document's marginals amount to: some token toxic (log odds), how many, and how dense."""
    none = float(np.log1p(-np.clip(marginals, 0, 1 - 1e-9)).sum())
    some = -math.expm1(none)
    logit = math.log(max(some, 1e-6)) - max(none, -13.8) if some > 0 else -13.8
    many = float(marginals.sum())
    return [logit / 5, math.log1p(many), math.log1p(100 * many / max(1, n)) / 3]


class Model:
    def __init__(self, chain: Chain, weights: np.ndarray):
        self.chain, self.weights = chain, weights

    def score(self, s: list[float]) -> float:
        z = float(self.weights[0] + self.weights[1:] @ np.array(s))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(sample: list[tuple[bytes, int]]) -> Model:
    ys = np.array([y for _, y in sample], float)
    if min(ys.sum(), len(ys) - ys.sum()) < MIN_CLASS:
        share = (ys.sum() + 1) / (len(ys) + 4)
        return Model(Chain([]), np.array([math.log(share / (1 - share)), 0, 0, 0]))
    chain = fit_chain(sample, tag_words(sample))
    codes, x = Codes(chain.tags), []
    for raw, _ in sample:
        c = codes.of(raw.split())
        x.append([1.0, *summary(chain.marginals(c)[1], len(c))])
    x, w = np.array(x), np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        d = np.linalg.solve(h, x.T @ (p - ys) + 0.5 * w)
        w = w - np.clip(d, -2, 2)
    return Model(chain, w)


def offending(raw: bytes, positions: np.ndarray) -> list[dict]:
    """Code point offsets of the words at ``positions`` (ascending)."""
    out, want, byte, point = [], set(positions.tolist()), 0, 0
    if want:
        for k, m in enumerate(WORD.finditer(raw)):
            if k in want:
                point += len(raw[byte : m.start()].decode("utf-8", "replace"))
                end = point + len(m.group().decode("utf-8", "replace"))
                out.append({"start": point, "end": end})
                byte, point = m.end(), end
    return out


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, held_out, score, predicted, n_toxic_tokens, spans array<struct<start,end>>) for every row."""
    spark = docs.sparkSession
    short_batches(spark)
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", rows, SAMPLE_BYTES, training_only=True)))
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        codes, nothing = Codes(m.chain.tags), m.score(summary(np.zeros(0), 1))
        for batch in batches:
            scores, spans = [], []
            for raw in batch.column(1).to_pylist():
                c = codes.of(raw.split())
                if not c.any():
                    scores.append(nothing)
                    spans.append([])
                    continue
                at, p = m.chain.marginals(c)
                scores.append(m.score(summary(p, len(c))))
                spans.append(offending(raw, at[p >= SPAN_AT]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], ["key", "score", "spans"])

    out = docs.select(F.col(key).alias("key"), text_bytes(text).alias("b")).mapInArrow(of, f"key {kind}, score double, spans array<struct<start:bigint,end:bigint>>")
    out = out.withColumnRenamed("key", key)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_toxic_tokens"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", at: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score is below ``at``, unchanged."""
    spark = docs.sparkSession
    short_batches(spark)
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", rows, SAMPLE_BYTES, training_only=True)))
    place = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        codes, nothing = Codes(m.chain.tags), m.score(summary(np.zeros(0), 1))
        for batch in batches:
            keep = []
            for raw in batch.column(place).cast(pa.large_binary()).to_pylist():
                c = codes.of((raw or b"").split())
                s = m.score(summary(m.chain.marginals(c)[1], len(c))) if c.any() else nothing
                keep.append(s < at)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
