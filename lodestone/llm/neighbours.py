"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Vectors are dealt to
blocks by a hash of their id; a block posts each vector in the inverted files of
its pivots, with the pivot's position. A query walks the files of its own
pivots, which gives the footrule distance of its order to that of every vector
posted there; the nearest by footrule are reranked by exact inner product.
Largest inner products reduce to smallest angles by one more coordinate that
brings all vectors to the length of the longest.

The index is dealt by document, as inverted files usually are: the files of a block
hold BLOCK vectors, every query visits every block, and only vectors that the files
bring within the footrule cut are ever multiplied with a query. Queries travel,
not the index, which is copied once for QUERY_BLOCK queries. Equal vectors of a
block are one entry with its smallest ids, so a vector that a third of all rows
share costs as much as any other and hides none; all entries at the cut and all
equal scores are kept until ids decide.

Defined results: vectors that are null, empty, zero, of another length than most,
or hold null or non-finite components take no part, as rows without id; of rows
with equal id and vector one counts; equal scores rank by smaller id; fewer
candidates than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, short_batches

#: Pivots (a bounded sample of the vectors), and how many of them represent a vector.
PIVOTS, REPRESENTED_BY = 256, 48
#: Vectors in a block of the index, queries that meet it in one task.
BLOCK, QUERY_BLOCK = 8192, 16384
#: Queries that walk a block's files at once.
TOGETHER = 256
#: Part of a block's vectors that are reranked, and the least number.
RERANKED, LEAST_RERANKED = 0.125, 1024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, norm2) of the rows that take part; ``v`` stays in single precision where it is stored so."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    ok = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    all_ = vectors.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v")).where(ok)
    size = all_.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if size:
        all_ = all_.where(F.size("v") == size[0].d)
    return all_.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def pivots_of(rows: DataFrame, n: int, longest2: float) -> np.ndarray:
    """At most ``n`` distinct vectors by hash of their id, lengthened and scaled to 1."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(4 * n).collect()
    x = np.unique(np.array([r.v for r in some], float).reshape(len(some), -1), axis=0) if some else np.zeros((0, 1))
    x = np.random.default_rng(7).permutation(x)[:n]
    return lengthened(x, longest2)


def lengthened(x: np.ndarray, longest2: float) -> np.ndarray:
    """Unit vectors whose inner product with (q, 0) orders as that of the originals with q."""
    rest = np.sqrt(np.maximum(0, longest2 - (x * x).sum(1, keepdims=True)))
    return np.hstack([x, rest]) / np.sqrt(longest2)


def represent(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Each row's ``m`` nearest pivots, nearest first; ties to the smaller pivot."""
    near = -(x @ pivots.T)
    m = min(m, near.shape[1])
    return np.argsort(near, axis=1, kind="stable")[:, :m].astype(np.int32)


class Block:
    """Inverted files of one block: distinct vectors posted under their pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, longest2: float, m: int, keep: int):
        x = np.ascontiguousarray(x) + 0.0
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        group = np.cumsum(new) - 1
        self.x, first = x[new], np.flatnonzero(new)
        self.members = [np.unique(ids[a:b][: 4 * keep])[:keep] for a, b in zip(first, np.append(first[1:], len(x)), strict=True)]
        assert len(self.x) == (group[-1] + 1 if len(group) else 0)
        lists = represent(lengthened(self.x, longest2), pivots, m)
        self.m, entry = lists.shape[1], np.repeat(np.arange(len(lists)), lists.shape[1])
        place = np.tile(np.arange(self.m), len(lists))
        by = np.argsort(lists.ravel(), kind="stable")
        self.entry, self.place = entry[by], place[by]
        self.at = np.searchsorted(lists.ravel()[by], np.arange(len(pivots) + 1))

    def footrule(self, queries: np.ndarray) -> np.ndarray:
        """Footrule distances of the queries' pivot orders (rows) to the entries'; an absent pivot counts as in place m.

        With nothing shared, both lists lie at distance m from their ends; each shared pivot then corrects the sum,
        pivot by pivot for all queries and entries that its file joins.
        """
        m, n = self.m, len(self.x)
        distance = np.full((len(queries), n), m * (m + 1), np.int32)
        asks = np.repeat(np.arange(len(queries)), m)
        place = np.tile(np.arange(m), len(queries))
        by = np.argsort(queries.ravel(), kind="stable")
        at = np.searchsorted(queries.ravel()[by], np.arange(len(self.at)))
        correction = (np.abs(np.arange(m)[:, None] - np.arange(m)) - (m - np.arange(m)[:, None]) - (m - np.arange(m))).astype(np.int32)
        for p in range(len(self.at) - 1):
            a, b = self.at[p], self.at[p + 1]
            mine = by[at[p] : at[p + 1]]
            if a < b and len(mine):
                distance[asks[mine][:, None], self.entry[a:b]] += correction[place[mine][:, None], self.place[a:b]]
        return distance

    def search(self, q: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, reranked: int) -> list[tuple[int, int, float]]:
        """(query, vector, inner product): each query's ``k`` best of the ``reranked`` entries nearest by footrule, and
        of those that lie as near as the last of them."""
        n, out = len(self.x), []
        if not n:
            return out
        d = self.footrule(queries) if reranked < n else np.zeros((len(q), n), np.int32)
        cut = np.partition(d, reranked - 1, axis=1)[:, reranked - 1] if reranked < n else np.zeros(len(q), np.int32)
        for r, me in enumerate(own.tolist()):
            c = np.flatnonzero(d[r] <= cut[r])
            exact = (self.x[c] * q[r]).sum(1)  # summed alike wherever the row lies, so equal vectors score equal
            if len(c) > k + 1:  # the query itself may be one of them
                best = np.flatnonzero(exact >= np.partition(exact, len(c) - k - 1)[len(c) - k - 1])
                c, exact = c[best], exact[best]
            found: list[tuple[float, int]] = []
            for j in np.argsort(-exact, kind="stable").tolist():
                if len(found) >= k and -exact[j] > found[-1][0]:
                    break
                found += [(-float(exact[j]), i) for i in self.members[c[j]].tolist() if i != me]
            out += [(me, i, -v) for v, i in sorted(found)[:k]]
        return out


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, represented_by: int = REPRESENTED_BY, reranked: float = RERANKED, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    short_batches(spark, 2048)
    rows = cut(usable(vectors, key, vector), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m2")).first()
    n, longest2 = facts.n, facts.m2 or 1.0
    chosen = spark.sparkContext.broadcast(pivots_of(rows, pivots, longest2))
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-(n // every) // QUERY_BLOCK))
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    index = rows.select("id", "v", dealt(1, blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), F.lit(False).alias("asks"))
    asked = rows.where(F.col("id") % every == 0)
    asked = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), dealt(2, query_blocks).alias("q"), F.lit(True).alias("asks"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        p = chosen.value
        pdf = pdf.sort_values(["asks", "id"], kind="stable")
        ids, asks = pdf["id"].to_numpy(np.int64), pdf["asks"].to_numpy(bool)
        x = np.stack([np.asarray(v, float) for v in pdf["v"]]) if len(pdf) else np.zeros((0, 1))
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        index = Block(ids[~asks], x[~asks], p, longest2, represented_by, k + 1)
        q = x[asks]
        lists = represent(np.hstack([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros((len(q), 1))]), p, represented_by)
        most, own, out = max(LEAST_RERANKED, int(reranked * len(index.x))), ids[asks], []
        for a in range(0, len(q), TOGETHER):
            b = a + TOGETHER
            out += index.search(q[a:b], lists[a:b], own[a:b], k, most)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = index.unionByName(asked).groupBy("b", "q").applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
