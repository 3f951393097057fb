"""MinHash near-dedup by a chosen-path set similarity join: trees that branch by minwise tokens, small nodes compared whole.

1. Texts with equal word sequences form one class; from here on classes are linked. A pass over the texts gives each class
   its number of shingles, the least hashes of its shingles under COORDINATES functions (a byte each) and TREES more
   in full width, the roots.
2. Classes that agree in BAND coordinates at once meet under the smallest of them, and each proposes its two most frequent
   partners. What whole sets confirm of these joins most copies of a group before any tree grows.
3. Each tree deals the classes to nodes by its root. A node whose classes are joined already is done. One with at most
   SMALL classes besides its largest component is compared whole, every class outside that component with every other
   of another component. Any other branches: one coordinate, or in one node of four two, chosen by the node, splits it by
   its classes' minwise tokens. So a pair at the limit goes on into one child on average, and one below into fewer.
   Nodes of up to HELD classes grow their trees within a task; larger ones branch as tables, a level at a time.
4. Pairs whose signatures agree well enough leave a tree as edges that span their components, never as pairs. The classes
   that met go to blocks with their whole sets, where pairs that agree are verified until their components are joined;
   only sets decide.
5. Components of the confirmed links are the result.

Trees are independent, so that the part of links that all of them miss falls with their number. A pair at exactly 80 %
that meets at a root (where no passage is common, nearly all do) is missed by all TREES roots with 0.2 ** 24; at the sixth
level of a crowded node a tree still holds it with 0.4, all miss it with 1e-5. The signatures' limit of 70 % drops a link
at exactly 80 % with 3e-5 (four standard deviations). Components lose less, as groups have many links.

Defined results: a null or empty text, or one of white space, has no shingles and is its own component; fewer words than a
shingle are one shingle; repeated ids count as one document with the union of their links; rows without an id take no
part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, short_batches, text_bytes
from lodestone.llm.components import connected_components
from lodestone.llm.ngram_join import CACHE_SIZE, WIDTH, WordHashes, class_of, filter_cell, id_filter, mixed, shingles, words_of

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Coordinates of a signature, and trees.
COORDINATES, TREES = 256, 24
#: Part of the coordinates that must agree for a pair to be verified.
AGREE = 0.70
#: Coordinates of a band, bands, and partners that a class proposes.
BAND, BANDS, PROPOSED = 8, 32, 2
#: Classes of a node besides its largest component that are compared whole; classes of a node that a task holds.
SMALL, HELD = 256, 4096
#: Levels of a tree within a task, after which a node is compared whole; levels as tables, which no input should reach.
DEEPEST, LEVELS = 14, 200
#: Nodes' rows of a bucket, classes of a part of a cluster (more in large ones, by the square root) and its bytes, bytes of a bucket of blocks.
BUCKET, PART, PART_BYTES, BLOCK_BYTES = 20_000, 1024, 8_000_000, 16_000_000

_RANDOM = np.random.default_rng(20_24)
_NARROW = _RANDOM.integers(1 << 31, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_WIDE = _RANDOM.integers(1 << 62, (1 << 63) - 1, TREES, dtype=np.uint64) | np.uint64(1)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the least hashes under all functions, roots) of a set of shingle hashes."""
    least, wide = np.full(COORDINATES, 0xFFFFFFFF, np.uint32), np.full(TREES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(s), 2048):
        part = s[a : a + 2048]
        h = (part >> np.uint64(32)).astype(np.uint32)
        h ^= h >> np.uint32(15)
        np.minimum(least, np.multiply.outer(_NARROW, h).min(1), out=least)
        np.minimum(wide, np.multiply.outer(_WIDE, part).min(1), out=wide)
    byte = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return byte, mixed(wide + np.arange(TREES, dtype=np.uint64), 1).view(np.int64)


def described(rows: DataFrame, width: int) -> DataFrame:
    """(id, cls, n, sig, roots) of every row; a task says the last two of a class once."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sent = WordHashes(), set()
        for batch in batches:
            cls, n, sig, roots = [], [], [], []
            for raw in batch.column(1).to_pylist():
                words = words_of(raw)
                if not words:
                    cls.append(None), n.append(0), sig.append(None), roots.append(None)
                    continue
                c, s = class_of(words), np.unique(shingles(words, cache, width))
                cls.append(c), n.append(len(s))
                if c in sent:
                    sig.append(None), roots.append(None)
                    continue
                if len(sent) >= CACHE_SIZE:
                    sent.clear()
                sent.add(c)
                b, r = signature(s)
                sig.append(b.tobytes()), roots.append(r.tolist())
            cols = [pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(roots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "cls", "n", "sig", "roots"])

    return rows.mapInArrow(describe, "id long, cls long, n long, sig binary, roots array<long>")


def proposed(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the partners that it meets in most bands, among the smallest classes of those."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * BAND + 1, F.lit(BAND)))))
    posts = classes.select("cls", band.alias("band"))
    least = posts.groupBy("band").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "least")
    met = posts.join(least, "band").where("cls <> least").groupBy("cls", "least").agg(F.count(F.lit(1)).alias("m"))
    best = met.groupBy("cls").agg(F.max(F.struct("m", "least")).alias("one"))
    # The second best: the best of those that are left.
    rest = met.join(best, "cls").where("least <> one.least").groupBy("cls").agg(F.max(F.struct("m", "least")).alias("one"))
    return best.unionByName(rest).select(F.least("cls", "one.least").alias("a"), F.greatest("cls", "one.least").alias("b")).distinct()


def class_sets(rows: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(cls, s): the whole sets of the classes in the only column of ``needed``, from another pass over the texts."""
    marks = rows.sparkSession.sparkContext.broadcast(id_filter(needed))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, want, sent = WordHashes(), np.unpackbits(marks.value), set()
        for batch in batches:
            cls, sets = [], []
            for raw in batch.column(0).to_pylist():
                words = words_of(raw)
                if not words:
                    continue
                c = class_of(words)
                if c not in sent and want[filter_cell(np.array([c], np.int64), want.size)[0]]:
                    if len(sent) < CACHE_SIZE:
                        sent.add(c)
                    cls.append(c)
                    sets.append(np.unique(shingles(words, cache, width)).tobytes())
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "s": pa.array(sets, pa.binary())})

    return rows.select("b").mapInArrow(sets_of, "cls long, s binary")


def buckets_of(spark, n: float, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // each))


def confirmed(edges: DataFrame, members: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between the classes of ``members`` (cls, label) whose labels ``edges`` brings into one cluster.

    Clusters are cut into parts of bounded bytes; where two parts meet, all pairs of different labels whose signatures
    agree are verified on the whole sets, best agreement first, unless links of this block join them already. So a
    block gives a spanning forest and no pairs leave it.
    """
    spark = rows.sparkSession
    clusters = connected_components(edges).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    members = members.join(clusters, "label").join(classes.select("cls", "n", "sig"), "cls")
    large = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    k = F.greatest(F.ceil(F.col("m") / F.greatest(F.lit(float(PART)), 4 * F.sqrt("m"))), F.ceil(8 * F.col("all") / PART_BYTES)).cast("int")
    dealt = cut(members.join(large.select("cluster", k.alias("k")), "cluster"), "clusters")
    bytes_ = dealt.agg(F.sum((8 * F.col("n") + COORDINATES) * F.col("k"))).first()[0] or 0
    # Several tasks may send a class with copies: one stays.
    full = dealt.join(class_sets(rows, dealt.select("cls"), width).dropDuplicates(["cls"]), "cls")
    blocks = full.withColumn("p", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    block = F.xxhash64("cluster", F.least("p", "o"), F.greatest("p", "o"))
    bucket = F.pmod(F.col("block"), F.lit(buckets_of(spark, bytes_, BLOCK_BYTES))).cast("int")
    blocks = blocks.select(block.alias("block"), (F.col("p") == F.col("o")).alias("same"), "p", "cls", "n", "label", "sig", "s")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "cls"], kind="stable")
        at, cls, n, label, part = (pdf[c].to_numpy(np.int64) for c in ("block", "cls", "n", "label", "p"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        sets, same = [np.frombuffer(x, np.uint64) for x in pdf["s"]], pdf["same"].to_numpy(bool)
        ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
        out = []
        for lo, hi in itertools.pairwise([0, *ends.tolist()]):
            # A block of two parts holds each with its partner; one of a single part holds that alone.
            of = None if same[lo] else part[lo:hi]
            out += [(cls[lo + i], cls[lo + j]) for i, j in block_forest(sig[lo:hi], n[lo:hi], label[lo:hi], of, sets[lo:hi], percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return cut(blocks.groupBy(bucket.alias("bucket")).applyInPandas(verify, "a long, b long"), "links")


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class Joined(dict):
    """Roots of joined numbers."""

    def root(self, i: int) -> int:
        while i in self:
            up = self[i]
            if up in self:
                self[i] = self[up]
            i = up
        return i

    def join(self, i: int, j: int) -> bool:
        """False if they were joined already."""
        i, j = self.root(i), self.root(j)
        if i != j:
            self[max(i, j)] = min(i, j)
        return i != j


def block_forest(sig: np.ndarray, n: np.ndarray, label: np.ndarray, part: np.ndarray | None, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links of a block that join its labels: between its two parts, or within its only one."""
    own, out = np.unique(label, return_inverse=True)[1], []
    for i in range(len(n) - 1):
        near = agreeing(sig, n, own, i, percent, i + 1)
        if part is not None:
            near = near[part[near[:, 1]] != part[i]]
        for j in near[np.argsort(-near[:, 2], kind="stable"), 1].tolist():
            if own[i] != own[j] and links(sets[i], sets[j], percent):
                own[own == own[j]] = own[i]
                out.append((i, j))
    return out


def agreeing(sig: np.ndarray, n: np.ndarray, label: np.ndarray, i: int, percent: int, first: int = 0) -> np.ndarray:
    """Rows (i, j, coordinates): classes from ``first`` on of another label and a fitting size whose signatures agree with that of ``i``."""
    may = first + np.flatnonzero((label[first:] != label[i]) & (100 * np.minimum(n[first:], n[i]) >= percent * np.maximum(n[first:], n[i])))
    agree = (sig[may] == sig[i]).sum(1)
    yes = agree >= np.ceil(AGREE * sig.shape[1])
    return np.stack([np.full(int(yes.sum()), i), may[yes], agree[yes]], 1)


def grown(sig: np.ndarray, n: np.ndarray, label: np.ndarray, seed: int, percent: int, small: int = SMALL, deepest: int = DEEPEST) -> tuple[list[tuple[int, int]], set[int]]:
    """(edges, met) of a node's tree: pairs of labels that span all it proposes, and the classes that met one of another label.

    The tree branches until nodes are small, which are compared whole.
    """
    joined, edges, met = Joined(), [], set()
    todo = [(np.arange(len(n)), seed, 0)]
    while todo:
        at, node, depth = todo.pop()
        names, own = np.unique(label[at], return_inverse=True)
        if len(names) < 2:
            continue
        major = np.bincount(own).argmax()
        minor = np.flatnonzero(own != major)
        if len(minor) <= small or depth >= deepest:
            here = (sig[at], n[at], label[at])
            for i in minor.tolist():
                near = agreeing(*here, i, percent)[:, 1]
                if len(near):
                    met.add(int(at[i]))
                    met.update(at[near].tolist())
                    a = int(label[at[i]])
                    edges += [(a, b) for b in np.unique(label[at[near]]).tolist() if joined.join(a, b)]
            continue
        draw = np.random.default_rng(node & 0x7FFFFFFFFFFFFFFF)
        for c in draw.choice(sig.shape[1], 1 + (draw.random() < 0.25), replace=False).tolist():
            values = sig[at, c]
            by = np.argsort(values, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(values[by]) != 0, True)) + 1
            for lo, hi in itertools.pairwise([0, *ends.tolist()]):
                if hi - lo > 1:
                    todo.append((at[by[lo:hi]], hash((node, c, int(values[by[lo]]))), depth + 1))
    return edges, met


def nodes_to_grow(classes: DataFrame, labels: DataFrame, held: int, small: int) -> DataFrame:
    """(node, part, cls, label, n, sig): nodes that one task can hold, of all trees; larger ones branch as tables first."""
    named = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    rows = named.select(F.explode("roots").alias("node"), "cls", "label")

    def mixed_only(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        nodes = counts.groupBy("node").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("label", "c").alias("major"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        return rows.join(nodes.drop("labels"), "node")

    rows = cut(mixed_only(rows).join(classes.select("cls", "n", "sig"), "cls"), "nodes")
    kept = ["node", "part", "cls", "label", "n", "sig"]
    done = rows.where(F.col("size") <= held).withColumn("part", F.lit(0)).select(kept)
    for _ in range(LEVELS):
        big = rows.where(F.col("size") > held)
        # One large component and few classes besides: these meet every part of it.
        few = F.col("size") - F.col("most") <= small
        parts = F.ceil(F.col("size") / held).cast("int")
        part = F.when(F.col("label") == F.col("major"), F.array(F.pmod(F.xxhash64("cls"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
        done = done.unionByName(big.where(few).withColumn("part", F.explode(part)).select(kept))
        if not big.where(~few).limit(1).count():
            return done
        one, two = (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int") for k in (1, 2))
        chosen = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0, F.array_distinct(F.array(one, two))).otherwise(F.array(one))
        child = big.where(~few).withColumn("c", F.explode(chosen))
        child = child.select(F.xxhash64("node", "c", F.substring("sig", F.col("c") + 1, F.lit(1))).alias("node"), "cls", "label", "n", "sig")
        rows = cut(mixed_only(child), "nodes")
        done = done.unionByName(rows.where(F.col("size") <= held).withColumn("part", F.lit(0)).select(kept))
    raise RuntimeError(f"nodes did not become small in {LEVELS} levels")


def tree_edges(classes: DataFrame, labels: DataFrame, percent: int, held: int = HELD, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(a, b): edges that span the labels which trees bring together and signatures let pass, and (cls, label): the classes by which they met."""
    rows = cut(nodes_to_grow(classes, labels, held, small), "dealt")
    bucket = F.pmod(F.xxhash64("node", "part"), F.lit(buckets_of(classes.sparkSession, rows.count(), BUCKET))).cast("int")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "part", "cls"], kind="stable")
        node, part, cls, label, n = (pdf[c].to_numpy(np.int64) for c in ("node", "part", "cls", "label", "n"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        ends = np.flatnonzero(np.append((node[1:] != node[:-1]) | (part[1:] != part[:-1]), True)) + 1
        joined, met = Joined(), {}
        for lo, hi in itertools.pairwise([0, *ends.tolist()]):
            edges, classes_met = grown(sig[lo:hi], n[lo:hi], label[lo:hi], int(node[lo]), percent, small)
            for a, b in edges:
                joined.join(a, b)
            met.update((int(cls[lo + i]), int(label[lo + i])) for i in classes_met)
        # Each label with the smallest that it is joined to, so that the tasks' edges are often the same.
        out = [("edge", joined.root(x), x) for x in sorted(joined)]
        return pd.DataFrame(out + [("met", c, x) for c, x in met.items()], columns=["kind", "a", "b"]).astype({"a": "int64", "b": "int64"})

    found = cut(rows.groupBy(bucket.alias("bucket")).applyInPandas(grow, "kind string, a long, b long").distinct(), "edges")
    return found.where("kind = 'edge'").select("a", "b"), found.where("kind = 'met'").select(F.col("a").alias("cls"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, held: int = HELD, small: int = SMALL) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every id; ``component_id`` is the smallest id that links reach."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text_bytes(text).alias("b"))
    seen = cut(described(rows, width), "described")
    classes = cut(seen.where(F.col("sig").isNotNull()).select("cls", "n", "sig", "roots").dropDuplicates(["cls"]), "classes")
    near = cut(proposed(classes), "proposed")
    alone = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct().withColumn("label", F.col("cls"))
    close = confirmed(near, alone, rows, classes, width, percent)
    labels = connected_components(close).withColumnRenamed("node", "cls")
    far = confirmed(*tree_edges(classes, labels, percent, held, small), rows, classes, width, percent)
    # Texts of one id belong together as well.
    full = seen.where(F.col("cls").isNotNull()).select("id", "cls")
    several = full.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("id", "a")
    same = full.join(several, "id").select("a", F.col("cls").alias("b")).where("a <> b")
    joined = connected_components(close.unionByName(far).unionByName(same)).select(F.col("node").alias("cls"), "label")
    named = full.groupBy("cls").agg(F.min("id").alias("least")).join(joined, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "label").select("cls", "component_id")
    wordless = seen.where(F.col("cls").isNull()).select("id", "n", F.col("id").alias("component_id"))
    by_row = seen.where(F.col("cls").isNotNull()).select("id", "cls", "n").join(by_class, "cls").select("id", "n", "component_id").unionByName(wordless)
    out = by_row.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
