"""Topics by online variational inference (latent Dirichlet allocation), with the model as a table.

The state is (term, weights): one row for each term of all documents seen, so a vocabulary of any size is dealt like any
other table. Documents are packed once into blocks of about BUCKET (document, term) counts, whose terms are named once a
block. Terms are dealt once by a hash to parts of about PART of the blocks' terms, and numbered in their part; a block asks a part
for numbers. An update takes a slice of the blocks: each part gives its numbers' rows to the blocks that ask for them, all
documents of a block are inferred from these, and what they say of its terms goes back to the parts and is summed there: arrays, a row
for a block and a part, not rows of terms. Documents are dealt to slices
and blocks by hashes of the id; a pass makes UPDATES of slices, and the driver sees sums of as many numbers as there are
topics or slices. New documents update a fitted model: their new terms join the table, and the step size goes on falling.

Defined results: documents of fewer than LEAST_TOKENS counted words take no part in the fit and are of the topic "general"
with probability 1; null and empty texts are such documents; repeated rows and ids are one document with all their words.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.storage import cut

#: Topics, prior of a document's topics and of a topic's terms, falling of the step, its offset, rounds
#: and least change of an inference, words of a document that has topics, least probability and coherence of "general".
TOPICS, ALPHA, ETA, DECAY, OFFSET, ROUNDS, LEAST_CHANGE = 3, 0.1, 0.01, 0.5, 1.0, 50, 0.001
LEAST_TOKENS, LEAST_PROBABILITY, GENERAL_COHERENCE = 5, 0.01, 0.5
#: Passes over all documents, updates in a pass.
PASSES, UPDATES = 2, 2
#: Counts (document, term), or characters of texts, of a block, on average; a task packs or infers a block at a time.
BUCKET, CHARACTERS = 200_000, 2_000_000
#: Terms of blocks that a part answers for, on average.
PART = 500_000


@dataclasses.dataclass
class Model:
    #: (term, weights array<double>)
    state: DataFrame
    topics: int
    documents: int
    updates: int
    alpha: float = ALPHA
    eta: float = ETA
    #: The same weights by parts, beside the blocks that they were dealt for.
    dealt: Dealt | None = None


@dataclasses.dataclass
class Dealt:
    """Terms and weights by parts, and what the blocks ask of them."""

    blocks: DataFrame
    #: (part, block, slice, places, ids): the term at each of the block's places has that number in the part
    asks: DataFrame
    #: (part, terms), by number
    terms: DataFrame
    #: (part, weights), those of a term one after another, by number; NaN of terms that the model does not know
    weights: DataFrame


def counted(text: Column) -> Column:
    """The words of a text that count, in order, as keyword density counts them: runs of three ASCII letters or more that are no stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,}+(?![\p{L}\p{N}_]))|[\p{L}\p{N}_]++"), F.lit(1))
    return F.filter(runs, lambda w: (w != "") & ~w.isin(*T.KEYWORD_STOP_WORDS))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, n): the counted words of each document."""
    return docs.select(F.col(key).alias("doc"), F.explode(counted(F.col(text))).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


BLOCK = "slice int, block long, terms array<string>, docs array<string>, ends array<int>, at array<int>, n array<int>"


def _row(key: tuple, doc: np.ndarray, ids: np.ndarray, at: np.ndarray, terms: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """A block from distinct (document, term) counts, by document; documents of too few words drop out."""
    enough = np.bincount(doc, n, len(ids)) >= LEAST_TOKENS
    stay = enough[doc]
    used, at = np.unique(at[stay], return_inverse=True)
    names = [None if pd.isna(i) else i for i in ids[enough]]
    row = (int(key[0]), int(key[1]), terms[used], names, np.cumsum(np.bincount(doc, minlength=len(ids))[enough]), at, n[stay])
    return pd.DataFrame([row] if len(names) else [], columns=["slice", "block", "terms", "docs", "ends", "at", "n"])


def _dealt(blocks: int, slices: int) -> tuple[Column, Column, Column]:
    """Slice and block of a document, and its id as text."""
    part = F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(slices)).cast("int")
    return part.alias("slice"), (F.pmod(F.xxhash64("doc"), F.lit(blocks)) * slices + part).alias("block"), F.col("doc").cast("string").alias("doc")


def packed(bags: DataFrame, slices: int = 1) -> DataFrame:
    """(slice, block, terms, docs, ends, at, n): the bags of documents with LEAST_TOKENS words or more, a row a block.

    ``docs`` are ids as text; the k-th one's counts ``n`` are those up to ``ends[k]``, each of the term at place ``at`` in ``terms``.
    """

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        doc, ids = pd.factorize(pdf["doc"].to_numpy(object), use_na_sentinel=False)
        at, terms = pd.factorize(pdf["term"].to_numpy(object), sort=True)
        order = np.lexsort((at, doc))
        return _row(key, doc[order], ids, at[order], terms, pdf["n"].to_numpy()[order])

    rows = bags.select(*_dealt(-(-bags.count() // (BUCKET * slices)) or 1, slices), "term", "n")
    return rows.groupBy("slice", "block").applyInPandas(pack, BLOCK)


def packed_texts(docs: DataFrame, slices: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same from texts: ``packed(words(docs))``, with one shuffle of the counted words and none of counts."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        docs = rows["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
        said = pc.split_pattern(rows["said"].combine_chunks(), " ")
        of = np.repeat(docs.indices.to_numpy().astype(np.int64), pc.list_value_length(said).to_numpy())
        coded = said.flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        both, n = np.unique(of * len(order) + place[coded.indices.to_numpy()], return_counts=True)
        terms, ids = coded.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False), docs.dictionary.to_numpy(zero_copy_only=False)
        row = _row(tuple(k.as_py() for k in key), both // len(order), ids, both % len(order), terms, n)
        return pa.Table.from_pandas(row, _arrow(BLOCK), preserve_index=False)

    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    rows = docs.select(F.col(key).alias("doc"), F.array_join(counted(F.col(text)), " ").alias("said")).where(F.col("said") != "")
    return rows.select(*_dealt(-(-size // (CHARACTERS * slices)) or 1, slices), "said").groupBy("slice", "block").applyInArrow(pack, BLOCK)


def _arrow(schema: str) -> pa.Schema:
    """Of names and types as Spark writes them."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    kind = lambda t: pa.list_(kinds[t[6:-1]]) if t.startswith("array<") else kinds[t]
    return pa.schema([(name, kind(t)) for name, t in (field.split() for field in schema.split(", "))])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """What the arrays of a column hold, one after another."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """A column of arrays, the k-th one ``values`` up to ``ends[k]``."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: the recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def infer_many(n: np.ndarray, beta: np.ndarray, starts: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gamma, what each count says of its term, bound) of documents whose counts begin at ``starts``, from their terms' rows of exp E[log beta].

    All go on together; a document stops at its own least change. Counts of stopped documents are taken out once they are a fifth.
    """
    k, sizes = beta.shape[1], np.diff(np.append(starts, len(n)))
    gamma, live = np.ones((len(starts), k)), np.arange(len(starts))
    moving, own, first, own_n, own_beta = np.ones(len(starts), bool), sizes, starts, n, np.ascontiguousarray(beta.T)
    for _ in range(ROUNDS):
        before = gamma[live]
        theta = np.exp(digamma(before) - digamma(before.sum(1))[:, None]).T
        share = np.full(len(own_n), 1e-100)
        for b, t in zip(own_beta, theta, strict=True):
            more = np.repeat(t, own)
            more *= b
            share += more
        np.divide(own_n, share, out=share)
        after = alpha + (theta * np.stack([np.add.reduceat(share * b, first) for b in own_beta])).T
        gamma[live[moving]] = after[moving]
        moving &= np.abs(after - before).mean(1) >= LEAST_CHANGE
        if not moving.any():
            break
        if own[moving].sum() < 0.8 * len(own_n):
            stay, live, own = np.repeat(moving, own), live[moving], own[moving]
            own_n, own_beta = own_n[stay], np.stack([b[stay] for b in own_beta])
            first, moving = np.cumsum(own) - own, np.ones(len(live), bool)
    log_theta = digamma(gamma) - digamma(gamma.sum(1))[:, None]
    theta = np.repeat(np.exp(log_theta), sizes, axis=0)
    norm = (beta * theta).sum(1) + 1e-100
    bound = np.add.reduceat(n * np.log(norm), starts) + ((alpha - gamma) * log_theta).sum(1) + (_lgamma(gamma) - math.lgamma(alpha)).sum(1) + math.lgamma(alpha * k) - _lgamma(gamma.sum(1))
    return gamma, (n / norm)[:, None] * theta * beta, bound


def infer_one(n: np.ndarray, beta: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, float]:
    """The same of one document."""
    gamma, stat, bound = infer_many(n, beta, np.zeros(1, np.int64), alpha)
    return gamma[0], stat, float(bound[0])


def new_terms(terms: DataFrame, topics: int) -> DataFrame:
    """(term, weights): first weights near 1, told apart by a hash of term and topic."""
    return terms.select("term").distinct().select("term", F.array(*[_first(F.col("term"), k) for k in range(topics)]).alias("weights"))


def _first(term: Column, k: int) -> Column:
    return 0.8 + 0.4 * (F.pmod(F.xxhash64(term, F.lit(k)), F.lit(1 << 20)) / (1 << 20))


def _shared(terms: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of some terms, where each one's end, and the terms' places in order of the parts."""
    part = (pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable").astype(np.int32)
    own, n = np.unique(part, return_counts=True)
    return own, np.cumsum(n), order


DEALT = "part int, block long, slice int, places array<int>, terms array<string>, weights array<double>"
NUMBERED = "part int, block long, slice int, places array<int>, ids array<int>, terms array<string>, weights array<double>"


def deal(blocks: DataFrame, topics: int, state: DataFrame | None = None, fresh: bool = True) -> Dealt:
    """Terms of written ``blocks``, and those of ``state``, by parts. ``fresh``: terms that the state lacks get first weights."""
    asked = blocks.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-(asked + (state.count() if state is not None else 0)) // PART) or 1
    dealt, numbered = _arrow(DEALT), _arrow(NUMBERED)

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, piece, terms in zip(*batch.columns, strict=True):
                own, ends, order = _shared(terms.values, parts)
                one = lambda x: pa.array(np.repeat(x.as_py(), len(own)))  # noqa: B023, E731
                columns = [pa.array(own), one(block), one(piece).cast(pa.int32()), _lists(ends, order), _lists(ends, terms.values.take(pa.array(order))), pa.nulls(len(own), dealt.field("weights").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=dealt)

    def of_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends, order = _shared(batch.column(0), parts)
            none = [pa.nulls(len(own), dealt.field(c).type) for c in ("block", "slice", "places")]
            weights = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, topics)[order].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(own), *none, _lists(ends, batch.column(0).take(pa.array(order))), _lists(ends * topics, weights)], schema=dealt)

    def number(key: tuple, rows: pa.Table) -> pa.Table:
        terms, known = rows["terms"].combine_chunks(), rows["block"].is_null().to_numpy()
        coded, sizes = terms.flatten().dictionary_encode(), pc.list_value_length(terms).to_numpy()
        ids, told = coded.indices.to_numpy(), np.repeat(known, sizes)
        weights = np.full((len(coded.dictionary), topics), np.nan)
        weights[ids[told]] = _flat(rows["weights"]).reshape(-1, topics)
        asks = rows.filter(pa.array(~known)).select(["part", "block", "slice", "places"])
        asks = asks.append_column("ids", _lists(np.cumsum(sizes[~known]), ids[~told].astype(np.int32)))
        model = {"part": [key[0].as_py()], "terms": _lists(np.array([len(weights)]), coded.dictionary), "weights": _lists(np.array([weights.size]), weights.ravel())}
        full = lambda t: pa.table([t[f.name] if f.name in t.column_names else pa.nulls(len(t), f.type) for f in numbered], schema=numbered)
        return pa.concat_tables([full(asks), full(pa.table(model))])

    rows = blocks.select("block", "slice", "terms").mapInArrow(of_blocks, DEALT)
    if state is not None:
        rows = rows.unionByName(state.select("term", "weights").mapInArrow(of_state, DEALT))
    all_ = cut(rows.groupBy("part").applyInArrow(number, NUMBERED), "dealt")
    own = all_.where("block IS NULL")
    at = lambda i, k: F.col("weights")[i * topics + k]
    first = F.flatten(F.transform("terms", lambda t, i: F.array(*[F.when(F.isnan(at(i, k)), _first(t, k)).otherwise(at(i, k)) for k in range(topics)])))
    weights = cut(own.select("part", first.alias("weights")), "topics") if fresh else own.select("part", "weights")
    return Dealt(blocks, all_.where("block IS NOT NULL").select("part", "block", "slice", "places", "ids"), own.select("part", "terms"), weights)


def _state(dealt: Dealt, topics: int) -> DataFrame:
    """(term, weights) of the terms that the model knows."""
    each = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.array(*[F.col("weights")[i * topics + k] for k in range(topics)]).alias("weights")))
    return dealt.terms.join(dealt.weights, "part").select(F.inline(each).alias("term", "weights")).where(~F.isnan(F.col("weights")[0]))


def _asked(model: Model, bags: DataFrame) -> Model:
    """The model, its weights dealt for the blocks of ``bags``."""
    if model.dealt is not None and model.dealt.blocks is bags:
        return model
    blocks = bags if "ends" in bags.columns else cut(packed(bags), "blocks")
    return dataclasses.replace(model, dealt=deal(blocks, model.topics, model.state, fresh=False))


def _given(model: Model, asks: DataFrame) -> DataFrame:
    """(part, block, places, ids, beta): what a part tells a block, exp E[log beta] of every term under each topic; NaN of unknown ones."""
    topics = model.topics

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for weights in batch.column(0):
                sums = np.nansum(weights.values.to_numpy(zero_copy_only=False).reshape(-1, topics), 0)
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in sums], [f"s{k}" for k in range(topics)])

    sums = model.dealt.weights.select("weights").mapInArrow(total, ", ".join(f"s{k} double" for k in range(topics)))
    sums = sums.agg(*[F.sum(f"s{k}") for k in range(topics)]).first()
    norm, schema = digamma(np.array([float(s or 1.0) for s in sums])), "part int, block long, places array<int>, ids array<int>, beta array<double>"

    def give(asks: pa.Table, own: pa.Table) -> pa.Table:
        if not len(asks):
            return _arrow(schema).empty_table()
        beta = np.exp(digamma(_flat(own["weights"]).reshape(-1, topics)) - norm)
        ends = np.cumsum(pc.list_value_length(asks["ids"]).to_numpy()) * topics
        return asks.append_column("beta", _lists(ends, beta[_flat(asks["ids"])].ravel()))

    own = model.dealt.weights.groupBy("part")
    return asks.select("part", "block", "places", "ids").groupBy("part").cogroup(own).applyInArrow(lambda a, b: give(a, b.select(["weights"])), schema)


def _inferred(model: Model, blocks: DataFrame, asks: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of each block: (block, given rows, places known, first count and results of each document, counts' places and statistics)."""
    topics, alpha = model.topics, model.alpha

    def infer(own: pa.Table, given: pa.Table) -> pa.Table:
        if not len(own) or not len(given):
            return _arrow(schema).empty_table()
        places = _flat(given["places"])
        beta = np.empty((len(places), topics))
        beta[places] = _flat(given["beta"]).reshape(-1, topics)
        has = ~np.isnan(beta[:, 0])
        at, ends = _flat(own["at"]), _flat(own["ends"])
        of, ok = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), has[at]
        at, n, of = at[ok], _flat(own["n"])[ok].astype(float), of[ok]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        gamma, stat, bound = infer_many(n, beta[at], starts, alpha) if len(of) else (np.zeros((0, topics)), np.zeros((0, topics)), np.zeros(0))
        total = np.stack([np.bincount(at, stat[:, k], len(beta)) for k in range(topics)], 1)
        return run(own, given, has, of[starts], gamma, bound, places, total)

    return blocks.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(infer, schema)


def inferred(model: Model, bags: DataFrame, terms: bool = True) -> DataFrame:
    """(doc, term, stat, bound) of bags or packed blocks: a row (doc, null, gamma, bound) for each document with a term that the model knows;
    ``doc`` is text. With ``terms``, a row (null, term, what the documents of a block say of it) for each of a block's terms, too."""
    model = _asked(model, bags)
    schema = "doc string, term string, stat array<double>, bound double"
    blocks = model.dealt.blocks.select("block", "docs", "ends", "at", "n", *(["terms"] if terms else []))

    def rows(own, given, has, docs, gamma, bound, places, total) -> pa.Table:
        lists = lambda x: _lists(np.arange(1, len(x) + 1) * x.shape[1], x.ravel())
        out = [pa.table([own["docs"].combine_chunks().flatten().take(pa.array(docs)), pa.nulls(len(docs), pa.string()), lists(gamma), pa.array(bound)], schema=_arrow(schema))]
        if terms:
            n = int(has.sum())
            out.append(pa.table([pa.nulls(n, pa.string()), own["terms"].combine_chunks().flatten().filter(pa.array(has)), lists(total[has]), pa.nulls(n, pa.float64())], schema=_arrow(schema)))
        return pa.concat_tables(out)

    return _inferred(model, blocks, _given(model, model.dealt.asks), rows, schema)


def _step(model: Model, blocks: DataFrame, asks: DataFrame, documents: int) -> Model:
    """The dealt model after one update with these blocks and what they ask."""
    topics, eta, schema = model.topics, model.eta, "part int, ids array<int>, stat array<double>"
    rho = (OFFSET + model.updates) ** -DECAY
    scale = model.documents / max(1, documents)

    def rows(own, given, has, docs, gamma, bound, places, total) -> pa.Table:
        ends = np.cumsum(pc.list_value_length(given["ids"]).to_numpy()) * topics
        return given.select(["part", "ids"]).append_column("stat", _lists(ends, total[places].ravel()))

    def move(told: pa.Table, own: pa.Table) -> pa.Table:
        w = _flat(own["weights"]).reshape(-1, topics)
        ids, stat = (_flat(told["ids"]), _flat(told["stat"]).reshape(-1, topics)) if len(told) else (np.zeros(0, np.int64), np.zeros((0, topics)))
        sums = np.stack([np.bincount(ids, stat[:, k], len(w)) for k in range(topics)], 1)
        moved = (1 - rho) * w + rho * (eta + scale * sums)
        return pa.table([own["part"], _lists(np.array([moved.size]), moved.ravel())], names=["part", "weights"])

    stats = _inferred(model, blocks.select("block", "ends", "at", "n"), _given(model, asks), rows, schema)
    weights = cut(stats.groupBy("part").cogroup(model.dealt.weights.groupBy("part")).applyInArrow(move, "part int, weights array<double>"), "topics")
    dealt = dataclasses.replace(model.dealt, weights=weights)
    return dataclasses.replace(model, dealt=dealt, state=_state(dealt, topics), updates=model.updates + 1)


def stepped(model: Model, bags: DataFrame, documents: int) -> Model:
    """The model after one update with the bags or packed blocks of ``documents`` documents."""
    model = _asked(model, bags)
    return _step(model, model.dealt.blocks, model.dealt.asks, documents)


def _documents(blocks: DataFrame) -> dict[int, int]:
    """Documents of each slice."""
    return {r["slice"]: r["n"] for r in blocks.groupBy("slice").agg(F.sum(F.size("ends")).alias("n")).collect()}


def _passes(model: Model, sizes: dict[int, int], passes: int) -> Model:
    for _ in range(passes):
        for k in sorted(sizes):
            own = F.col("slice") == k
            model = _step(model, model.dealt.blocks.where(own), model.dealt.asks.where(own), sizes[k])
    return model


def fit(bags: DataFrame, topics: int = TOPICS, passes: int = PASSES, updates: int = UPDATES, alpha: float = ALPHA, eta: float = ETA) -> Model:
    """A model of all documents of ``bags`` (doc, term, n), which are read twice, or of packed blocks, whose slices are the updates."""
    blocks = bags if "ends" in bags.columns else cut(packed(bags, updates), "blocks")
    sizes, dealt = _documents(blocks), deal(blocks, topics)
    return _passes(Model(_state(dealt, topics), topics, sum(sizes.values()), 0, alpha, eta, dealt), sizes, passes)


def update(model: Model, bags: DataFrame, passes: int = 1, updates: int = 1) -> Model:
    """``model`` with further documents: their new terms are added, and they are passed over ``passes`` times."""
    blocks = cut(packed(bags, updates), "blocks")
    sizes, dealt = _documents(blocks), deal(blocks, model.topics, model.state)
    grown = dataclasses.replace(model, dealt=dealt, state=_state(dealt, model.topics), documents=model.documents + sum(sizes.values()))
    return _passes(grown, sizes, passes)


def topic_terms(model: Model, terms: int = 10) -> DataFrame:
    """(topic, rank, term, weight, coherence): each topic's heaviest terms; coherence is their mean weight."""
    each = model.state.select("term", F.posexplode("weights").alias("topic", "w"))
    total = each.groupBy("topic").agg(F.sum("w").alias("total"))
    by = Window.partitionBy("topic").orderBy(F.desc("w"), "term")
    top = each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= terms).join(F.broadcast(total), "topic")
    weight = F.col("w") / F.col("total")
    return top.select("topic", "rank", "term", weight.alias("weight")).withColumn("coherence", F.avg("weight").over(Window.partitionBy("topic")))


def coherence(weights: Column) -> Column:
    """Mean weight of a topic's terms; 0 of none."""
    return F.when(F.size(weights) > 0, F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) / F.size(weights)).otherwise(F.lit(0.0))


def document_topics(model: Model, docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_PROBABILITY, bags: DataFrame | None = None) -> DataFrame:
    """(key, topic, probability): topics of each document from ``least`` up; topic -1 is "general". ``bags``: the documents' words, packed or not, where at hand."""
    bags = cut(packed_texts(docs, 1, key, text), "blocks") if bags is None else bags
    gamma = cut(inferred(model, bags, terms=False).select(F.col("doc").cast(docs.schema[key].dataType), F.col("stat").alias("g")), "gamma")
    share = F.transform("g", lambda x: x / F.aggregate("g", F.lit(0.0), lambda a, y: a + y))
    known = gamma.select("doc", F.posexplode(share).alias("topic", "probability")).where(F.col("probability") >= least)
    short = docs.select(F.col(key).alias("doc")).distinct().join(gamma.select("doc"), "doc", "left_anti")
    return known.unionByName(short.select("doc", F.lit(-1).alias("topic"), F.lit(1.0).alias("probability"))).withColumnRenamed("doc", key)
