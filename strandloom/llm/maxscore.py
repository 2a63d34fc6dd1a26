"""Exact top-k by inner product with MaxScore over shards.

A dimension is a term. In a shard a query's terms are ordered by the range of what they can add; the bound of a term
is the most it adds to any vector of the shard; several terms together add no more than their length times that of
the longest vector. Against the k-th score known so far, the trailing terms whose bounds
together stay below it are non-essential: a vector that the essential terms leave too low can't come in. Vectors are
taken in stretches: essential terms are traversed for all of a stretch, the others only for vectors that still compete,
a few terms at a time; then the k-th score is raised, and with it more terms become non-essential. A first search of a
bounded sample of the vectors gives each query a k-th score that all shards start from. Vectors are dealt to shards by
their largest component, so that the bounds of a shard are tight. The shards' lists are merged by rank. Queries and
vectors meet in a grid of shards and query blocks, each of bounded size, so no side is broadcast and nothing is
gathered whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.distance import tiled
from .common import stored

#: Vectors in a shard and queries in a block at most, about.
SHARD, BLOCK = 1 << 16, 1 << 12
#: Vectors of a stretch, terms probed at a time; the first search takes one vector in PART, and SAMPLE of them at most, about.
STRETCH, PROBE, PART, SAMPLE = 512, 8, 16, 4096


def quantised(rows: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, vec array<long>): components as floor(scale * x); rows with a null key, vector or component, or one not finite, are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return rows.where(F.col(key).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("vec"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as int64; what a shorter list lacks is zero."""
    col = column.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def top(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, floor: float = -np.inf, longest: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, components looked at) of the k best columns of vectors (terms, vectors), ties to smaller ids.

    ids are sorted; none below the score `floor` need be found; no column is longer than `longest`.
    """
    most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(least - most, kind="stable")
    # the most that terms from each on can add: their own bounds, or what a vector of that length can give
    rest = np.concatenate((np.cumsum(most[order][::-1])[::-1], [0]))
    if longest < np.inf:
        length = np.sqrt(np.cumsum(query[order][::-1].astype(np.float64) ** 2))[::-1]
        rest = np.minimum(rest, np.concatenate((length * longest * (1 + 1e-9) + 1, [0])))
    found, score, looked = np.zeros(0, np.int64), np.zeros(0, query.dtype), 0
    for start in range(0, vectors.shape[1], STRETCH):
        essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(order)
        if essential == 0:
            break  # no vector of the shard reaches the floor
        width = min(STRETCH, vectors.shape[1] - start)
        terms = order[:essential]
        part = query[terms] @ vectors[terms, start : start + width]
        looked += essential * width
        alive = np.flatnonzero(part + rest[essential] >= floor)
        part = part[alive]
        for at in range(essential, len(order), PROBE):
            terms = order[at : at + PROBE]
            part = part + query[terms] @ vectors[np.ix_(terms, alive + start)]
            looked += len(terms) * len(alive)
            keep = part + rest[min(at + PROBE, len(order))] >= floor
            alive, part = alive[keep], part[keep]
        other = ids[alive + start] != own
        found, score = np.concatenate((found, alive[other] + start)), np.concatenate((score, part[other]))
        best = np.lexsort((found, -score))[:k]
        found, score = found[best], score[best]
        if len(score) == k:
            floor = max(floor, score[-1])
    return ids[found], score, looked


def search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k best vectors by integer inner product; all, if fewer.

    Both sides are (id, vec array<long>). A vector with the query's id is no candidate; equal scores go to the
    smaller id. Of query rows with one id the one with the least vector is searched; vectors that come again each count. Vectors of unlike length meet as if filled with zeros. Empty sides give no rows. Scores must fit a long.
    """
    vectors = stored(vectors, "vectors")
    queries = stored(queries.groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    n, m = vectors.count(), queries.count()
    if not n or not m:
        return vectors.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    blocks = max(1, -(-m // BLOCK))
    # the sample's size is bounded; equal rows may make it larger, its shards stay bounded all the same
    some = vectors.where(F.pmod(F.xxhash64(F.lit(1), "id", "vec"), F.lit(max(PART, n // SAMPLE))) == 0)
    first = ranked(met(queries.withColumn("floor", F.lit(None).cast("long")), some, blocks, k), k)
    floors = stored(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")), "floors")
    return ranked(met(queries.join(floors, "id", "left"), vectors, blocks, k), k)


def ranked(lists: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met(queries: DataFrame, vectors: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query (id, vec, floor) in each shard of the vectors, none below its floor needed."""
    # vectors with one largest component stand together, in several shards if they are many
    size = F.transform("vec", lambda x: F.abs(x))
    largest = F.coalesce(F.array_position(size, F.array_max(size)), F.lit(0))
    negative = F.coalesce(F.get("vec", (largest - 1).cast("int")), F.lit(0)) < 0
    dealt = vectors.withColumns({"kind": largest * 2 + negative.cast("int"), "own": F.xxhash64("id", "vec")})
    dealt = stored(tiled(dealt, "own", "kind", SHARD).select("id", "vec", F.col("_tile").alias("shard")), "shards")
    shards = dealt.agg(F.max("shard")).first()[0] or 0
    deal = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last)))
    left = queries.select("id", "vec", "floor", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("block"), deal(shards).alias("shard"))
    right = dealt.select("id", "vec", "shard", deal(blocks - 1).alias("block"))

    def cell(own: pa.Table, all_: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and all_.num_rows:
            width = max(int(np.diff(t["vec"].combine_chunks().offsets.to_numpy()).max()) for t in (own, all_))
            x, q = matrix(all_["vec"], width), matrix(own["vec"], width)
            ids = all_["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.ascontiguousarray(x[order].T)
            if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < 2**52:
                x, q = x.astype(np.float64), q.astype(np.float64)  # integers this small are exact
            high, low = x.max(axis=1), x.min(axis=1)
            longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=0).max()))
            floors = [-np.inf if f is None else f for f in own["floor"].to_pylist()]
            for name, row, floor in zip(own["id"].to_numpy(), q, floors, strict=True):
                got, score, _ = top(row, name, x, ids, high, low, k, floor, longest)
                out.append((np.full(len(got), name), got, score.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, "query_id long, vec_id long, score long")
