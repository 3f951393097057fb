"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and
their token counts; tier two is a cache that each Python worker fills with the
pre-tokens that tier one misses. No pre-token is ever a key of a shuffle: what the
first pass sends is one bounded summary a task, and summaries are merged whole, in
two rounds, into one of the table's size.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives an empty result; columns other than the
id and the text are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, text_bytes

#: Pre-tokens that one task may report, and that the broadcast table holds at most (about 2 MB).
SUMMARY_SIZE, TABLE_SIZE = 4096, 32768
#: Summaries that the second round merges.
ROUND = 32
#: A task's counter is pruned to its most frequent entries beyond this size.
COUNTER_SIZE = 300_000
#: Entries of a worker's cache before it starts anew, and the longest pre-token that is cached.
CACHE_SIZE, CACHED_LENGTH = 400_000, 64
#: Code points that Unicode added lately, which regular expression engines class
#: differently. Texts that hold one are encoded whole by the library.
UNSURE = (
    "[՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
    "\U00010000-\U0001f2ff\U0001fb00-\U0010ffff]"
)
#: Fixed value: the vocabulary's special string, which the library maps to one token.
SPECIAL = "<|endoftext|>"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokenLengths(dict):
    """Pre-token -> number of tokens; misses are encoded and kept, within bounds."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_SIZE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


class Splitter:
    """Splits texts into the tokenizer's pre-tokens; None where only the library's own splitting is safe."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.unsure = regex.compile(UNSURE).search

    def __call__(self, text: str) -> list[str] | None:
        if SPECIAL in text or not (text.isascii() or self.unsure(text) is None):
            return None
        return self.find(text)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, seen = Splitter(), Counter()
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            seen.update(split(raw.decode("utf-8", "replace")) or ())
            if len(seen) > COUNTER_SIZE:
                seen = Counter(dict(seen.most_common(COUNTER_SIZE // 4)))
    yield pa.RecordBatch.from_pydict({"summary": pa.array([_packed(seen, SUMMARY_SIZE)], pa.binary())})


def _packed(seen: Counter, most: int) -> bytes:
    """The most frequent pre-tokens with their counts, equal counts by pre-token."""
    top = sorted(((w, n) for w, n in seen.items() if len(w) <= CACHED_LENGTH), key=lambda x: (-x[1], x[0]))[:most]
    return json.dumps(top).encode()


def _merged(pdf):
    import pandas as pd

    seen: Counter = Counter()
    for raw in pdf["summary"]:
        seen.update(dict(json.loads(raw)))
    return pd.DataFrame({"summary": [_packed(seen, TABLE_SIZE)]})


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """The corpus's most frequent pre-tokens with their token counts.

    Every text is read. A task sends at most ``SUMMARY_SIZE`` pre-tokens and the
    driver receives at most ``TABLE_SIZE``; the table decides speed alone.
    """
    from tokenizers import Tokenizer

    short_batches(docs.sparkSession)
    each = docs.select(text_bytes(text).alias("b")).mapInArrow(_summaries, "summary binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ROUND)))
    some = each.groupBy("part").applyInPandas(_merged, "summary binary").withColumn("part", F.lit(0))
    whole = some.groupBy("part").applyInPandas(_merged, "summary binary").collect()  # one row
    words = [w for w, _ in json.loads(bytes(whole[0].summary))] if whole else []
    encoded = Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, encoded, strict=True)}


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    spark = docs.sparkSession
    short_batches(spark)
    path = path or vocabulary_path()
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        split, lengths = Splitter(), PreTokenLengths(tokenizer, table.value)
        for batch in batches:
            sizes, counts = [], []
            for raw in batch.column(1).to_pylist():
                whole = raw.decode("utf-8", "replace")
                words = split(whole)
                sizes.append(len(raw))
                counts.append(len(tokenizer.encode(whole, add_special_tokens=False).ids) if words is None else sum(map(lengths.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), text_bytes(text).alias("b")).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
