"""Spelling variants by anagram hashing: words whose letter sums differ by one letter's value, letter order verified.

1. A pass over all texts counts words; a task sends sums of at most HELD words at a time, Spark adds them up.
2. A word's anagram key is the sum of the fifth powers of its letters, so that all arrangements of the same letters
   share it. A letter's removal takes its power from the key, an addition adds it, an exchange does both.
3. Each word posts its key less the power of each of its letters, with what is left of the word and the place. Where two
   such postings meet, their words' keys differ by an exchange value; where one meets a word's own key, by a removal (or,
   from the other side, an addition). Letter order is verified where they meet: what is left must be equal, and for an
   exchange the place too. Words that meet at one place differ in that letter alone, so as many meet as there are
   letters, and groups give counts and best neighbours without any pairs. A pair meets once: of equal letters in a row
   only the first counts for a removal.
4. Forms are followed to their roots by pointer doubling; n at least doubles at each step, so a few rounds do.

Words over LONG code points are named by their beginning, length and 128 bits of hash while they meet.

Defined results: null and empty texts hold no words; in rows without an id no letter is deleted; repeated rows and ids
count as often as they stand there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, short_batches, text_bytes

#: A run of letters, in UTF-8 with A-Z lowered: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One in EVERY pairs of document and run loses a letter.
EVERY = 97
#: Code points and occurrences of a word at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has at least so many times the word's occurrences.
FORM_FACTOR = 2
#: Words whose counts a task holds before it sends them.
HELD = 300_000
#: Keys are sums modulo this prime, so that words of any length have one.
PRIME = (1 << 61) - 1
#: Longer words meet by a name.
LONG = 64


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): sums over a part of the texts."""
    held: dict[bytes, int] = {}

    def send() -> pa.RecordBatch:
        words = [w.decode() for w in held]
        some = [k for k, w in enumerate(words) if len(w) >= LEAST_LENGTH]
        counts = list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k in some], pa.string()), pa.array([counts[k] for k in some], pa.int64())], ["word", "n"])

    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = None if i is None else zlib.crc32(f"{i}:".encode())
            for run, n in Counter(RUN.findall(raw.lower())).items():
                if start is not None and (h := zlib.crc32(run, start)) % EVERY == 0:
                    whole = run.decode()
                    at = h % len(whole)
                    run = (whole[:at] + whole[at + 1 :]).encode()
                held[run] = held.get(run, 0) + n
            if len(held) >= HELD:
                yield send()
    if held:
        yield send()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    short_batches(docs.sparkSession)
    some = docs.select(F.col(key).cast("string").alias("id"), text_bytes(text).alias("b")).mapInArrow(runs, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def power(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def name(word: Column) -> Column:
    """The word itself, or what stands for a long one."""
    hashed = F.concat_ws("#", F.substring(word, 1, LONG), F.length(word).cast("string"), F.hex(F.xxhash64(word)), F.hex(F.xxhash64(word, F.lit(1))))
    return F.when(F.length(word) <= LONG, word).otherwise(hashed)


def neighbours(words: DataFrame) -> DataFrame:
    """(name, near, best_n, best): for some of a word's near words each, their number and the best of them by name."""
    letters = F.col("letters")
    removed = F.transform(
        letters,
        lambda c, i: F.struct(
            i.alias("place"),
            F.pmod(F.col("key") - power(c), F.lit(PRIME)).alias("key"),
            name(F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word")))).alias("left"),
            ((i == 0) | (F.element_at(letters, F.greatest(i, F.lit(1))) != c)).alias("first"),
        ),
    )
    posted = words.select("name", "n", F.explode(removed).alias("r")).select("name", "n", "r.*")
    # Exchange: the same key without one letter, the same rest in the same order, the same place.
    met = posted.groupBy("key", "left", "place").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "name"))).alias("at"))
    met = met.where(F.size("at") > 1).select("at", F.posexplode("at").alias("k", "me"))
    other = F.when(F.col("k") == 0, F.element_at("at", 2)).otherwise(F.element_at("at", 1))
    exchanged = met.select(F.col("me.name").alias("name"), (F.size("at") - 1).cast("long").alias("near"), other.alias("o")).select("name", "near", (-F.col("o.m")).alias("best_n"), F.col("o.name").alias("best"))
    # Removal and addition: a key without one letter is another word's key, and its rest that word.
    shorter = words.select("key", F.col("name").alias("left"), F.col("n").alias("short_n"))
    pairs = posted.where("first").select("key", "left", "name", "n").join(shorter, ["key", "left"])
    one = F.lit(1).cast("long")
    sides = F.array(F.struct(F.col("name"), one.alias("near"), F.col("short_n").alias("best_n"), F.col("left").alias("best")), F.struct(F.col("left").alias("name"), one.alias("near"), F.col("n").alias("best_n"), F.col("name").alias("best")))
    return exchanged.unionByName(pairs.select(F.explode(sides).alias("s")).select("s.*"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's last form, found by doubling the way at each round."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``."""
    letters = F.split("word", "")
    sums = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: (a + power(x)) % PRIME)
    counted = word_counts(docs, key, text).withColumn("letters", letters)
    words = cut(counted.select("word", "n", "letters", name(F.col("word")).alias("name"), sums(F.col("letters")).alias("key")), "words")
    near = neighbours(words)
    # Names of long words give way to the words before ties are decided.
    long = words.where(F.length("word") > LONG).select(F.col("name").alias("best"), F.col("word").alias("best_word"))
    plain = near.where(F.length("best") <= LONG).withColumn("best_word", F.col("best"))
    named = plain.unionByName(near.where(F.length("best") > LONG).join(long, "best").select(plain.columns))
    best = named.groupBy("name").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best_word").alias("w"))).alias("b"))
    chosen = -F.col("b.m") >= FORM_FACTOR * F.col("n")
    found = words.join(best, "name", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("b.w")).alias("form"), F.when(chosen, -F.col("b.m")).alias("form_n"))
    found = cut(found, "variants")
    out = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
