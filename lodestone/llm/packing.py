"""Best-fit packing with Martello-Toth dominance reduction.

Lengths lie between 1 and the capacity, so the whole instance is a histogram of
at most ``capacity`` numbers however many documents there are. The driver
reduces that histogram by dominance (a large piece with its best partner is
fixed wherever no other set can do better), packs the remainder best-fit
decreasing, and describes the sequences as runs: "so many pieces of length l, q
to a sequence, from this offset on". Executors then give each piece its rank
among the pieces of its length, by two levels so that no length is gathered in
one task, and look its run up.

Defined results: a null or empty text is the one closing token; repeated rows
are packed each; an empty table gives no pieces; other columns are ignored.
Texts longer than the capacity are cut into full pieces and one rest.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, short_batches, text_bytes

CAPACITY, CLOSING_ID = 4096, 1
#: Entries of one generation of a worker's cache, and the longest word that is cached.
CACHE_SIZE, CACHED_LENGTH = 150_000, 64
#: Pieces of one length that are ranked together.
RANKED_TOGETHER = 20_000
#: Runs up to which the table of runs is broadcast (40 bytes each).
BROADCAST_RUNS = 100_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of Latin letters alone: one pre-token, composed already, lower-cased alike everywhere.
SIMPLE = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Control characters that Python's ``split`` takes for white space and the tokenizer does not.
NOT_SPACE = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")


class WordIds(dict):
    """Word without white space -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what it separates, so a text's
    ids are its words' ids. A word of plain letters goes straight to the merges,
    any other through the whole tokenizer; a sign behind it counts by itself and
    takes no place in the cache. Words seen lately are kept in two generations: a
    full one replaces the one before it.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.older = tokenizer, tokenizer.model, {}
        self.letter = byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word[-1] in ".,;:!?" and SIMPLE.fullmatch(word, 0, len(word) - 1):
                return self[word[:-1]] + self[word[-1]]
            ids = self.encode(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_SIZE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word):
            low = word.lower()
            plain = low if low.isascii() else "".join(map(self.letter.__getitem__, low.encode()))
            ids = [t.id for t in self.model.tokenize(plain)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = array("I", ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def of(self, raw: bytes) -> bytes:
        """The ids of a whole text."""
        if any(c in raw for c in NOT_SPACE):
            return self.encode(raw.decode("utf-8", "replace"))
        if b"<|" not in raw:  # special strings are known by their case
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.decode("utf-8", "replace").split()))


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


#: One cache for all tasks of a Python worker.
_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        from tokenizers import Tokenizer

        _WORDS.clear()
        _WORDS[path] = WordIds(Tokenizer.from_file(path))
    return _WORDS[path]


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, closing: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids): the pieces of every row, ids as little-endian unsigned 32-bit bytes."""
    short_batches(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = word_ids(path), closing.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            at, piece, start, length, ids = [], [], [], [], []
            for row, raw in enumerate(batch.column(1).to_pylist()):
                whole = words.of(raw) + end
                for k in range(0, len(whole), step):
                    part = whole[k : k + step]
                    at.append(row)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["key", "piece", "start", "length", "ids"],
            )

    out = docs.select(F.col(key).alias("key"), text_bytes(text).alias("b")).mapInArrow(pieces, f"key {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", key)


class Instance:
    """A multiset of lengths: counts, and the lengths that are left in order."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def largest(self, room: int, but: int | None = None) -> int | None:
        """The largest length within ``room``; one piece of length ``but`` is already taken."""
        k = bisect_right(self.lengths, room) - 1
        while k >= 0:
            if self.lengths[k] != but or self.counts[but] > 1:
                return self.lengths[k]
            k -= 1
        return None

    def smallest(self, n: int, but: int) -> list[int]:
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(n - len(out), self.counts[x] - (x == but))
            if len(out) >= n:
                break
        return out

    def best_pair(self, room: int, but: int) -> int:
        """The largest sum of two further pieces within ``room``, 0 if none."""
        best, i, j = 0, 0, bisect_right(self.lengths, room) - 1
        have = lambda x: self.counts[x] - (x == but)
        while i <= j:
            a, b = self.lengths[i], self.lengths[j]
            if a + b > room or not have(b):
                j -= 1
            elif not have(a) or (i == j and have(a) < 2):
                i += 1
            else:
                best = max(best, a + b)
                i += 1
        return best


def dominance(inst: Instance) -> list[tuple[tuple[int, ...], int]]:
    """Fix, from the largest piece down, each set that provably dominates every other set with that piece.

    For a piece j with room r beside it, with k the largest other piece that fits:
    nothing fits: {j}; k fills r, or no two others fit: {j, k}; no three others
    fit and no two exceed k: {j, k}. In each case any other set's members can be
    exchanged for k without needing more sequences. Returns (set, times) and
    removes the fixed pieces from the instance.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in reversed(list(inst.lengths)):
        while j in inst.counts:
            room, n = inst.capacity - j, inst.counts[j]
            k = inst.largest(room, j)
            if k is None:
                fixed.append(((j,), n))
                inst.take(j, n)
                continue
            low = inst.smallest(3, j)
            pair_fits = len(low) > 1 and low[0] + low[1] <= room
            if k < room and pair_fits and ((len(low) > 2 and sum(low) <= room) or inst.best_pair(room, j) > k):
                break
            times = n // 2 if j == k else min(n, inst.counts[k])  # fewer pieces only make the test easier to meet
            fixed.append(((j, k), times))
            inst.take(j, times)
            inst.take(k, times)
    return fixed


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pack a multiset of lengths. Returns runs (length, pieces, per_sequence, first_sequence, offset):
    the next ``pieces`` pieces of that length lie ``per_sequence`` to a sequence, from ``first_sequence``
    and from ``offset`` in each. Runs of a length follow one another in the order of its ranks."""
    inst, runs, next_id = Instance(counts, capacity), [], 0
    rooms: dict[int, list[list[int]]] = defaultdict(list)  # room -> [first sequence, sequences]
    order: list[int] = []  # the rooms in use, ascending

    def open_bins(first: int, n: int, room: int) -> None:
        if n and room:
            if room not in rooms or not rooms[room]:
                insort(order, room)
            rooms[room].append([first, n])

    for members, times in dominance(inst):
        offset = 0
        for length in members:
            runs.append((length, times, 1, next_id, offset))
            offset += length
        open_bins(next_id, times, capacity - offset)
        next_id += times
    for length in reversed(list(inst.lengths)):
        left = inst.counts[length]
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                bins = rooms[room]
                first, n = bins.pop()
                if not bins:
                    order.pop(at)
            else:
                room, per = capacity, capacity // length
                first, n = next_id, -(-left // per)
                next_id += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, full * per, per, first, capacity - room))
                open_bins(first, full, room - per * length)
                left -= full * per
            first, n = first + full, n - full
            if n and left and left < per:  # the rest goes into one more
                runs.append((length, left, left, first, capacity - room))
                open_bins(first, 1, room - left * length)
                first, n, left = first + 1, n - 1, 0
            if n and room < capacity:
                open_bins(first, n, room)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stable table with a ``length`` of 1 to ``capacity`` in each row.

    Read twice, so cut its lineage first. The driver collects one count per length.
    """
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = pack_histogram(counts, capacity)
    salts = max(16, -(-max(counts.values(), default=1) // RANKED_TOGETHER))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sums = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    rank = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(rank)).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    found = run_table(spark, runs)
    if len(runs) <= BROADCAST_RUNS:
        found = F.broadcast(found)
    r = F.col("_rank") - F.col("_low")
    on = (ranked["length"] == found["_length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    return ranked.join(found, on).select(
        *pieces.columns,
        (F.col("_first") + F.floor(r / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(r, F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )


def run_table(spark: SparkSession, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    rows, done = [], defaultdict(int)
    for length, n, per, first, offset in runs:
        rows.append((length, done[length], done[length] + n, per, first, offset))
        done[length] += n
    return spark.createDataFrame(rows, "_length long, _low long, _high long, _per long, _first long, _offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The documents' pieces with their place; ids are kept as a CRC-32, the bytes come from ``tokenise``."""
    pieces = tokenise(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut(pieces, "pieces"))
