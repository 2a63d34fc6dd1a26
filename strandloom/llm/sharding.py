"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows stand in source partitions by a hash. Shard sizes are fixed first, at most one apart. The matrix of how many
rows each partition sends to each shard is drawn exactly, as such counts fall in a uniform shuffle: row by row from
hypergeometric laws given what room is left in the shards. A partition permutes its rows and cuts them by its row of
the matrix; the rows go to their shards and are permuted there again. Only the counts of the partitions reach the
driver and only the matrix comes back, both of a size fixed by the numbers of partitions and shards; rows are moved
by window functions and joins.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, join_checked, stored

#: Fewest source partitions, and rows of a partition or of a block of a shard at most, about.
PARTITIONS, ROWS = 64, 1_000_000
#: Equal rows that one task makes again at most.
STRETCH = 100_000


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """The number of good ones among draws without replacement, by inversion outward from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    u = rng.random() - p
    up = down = p
    a = b = mode
    while u > 0 and (a < high or b > low):
        if a < high:
            up *= (good - a) * (draws - a) / ((a + 1) * (bad - draws + a + 1))
            a += 1
            u -= up
            if u <= 0:
                return a
        if b > low:
            down *= b * (bad - draws + b) / ((good - b + 1) * (draws - b + 1))
            b -= 1
            u -= down
            if u <= 0:
                return b
    return mode


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: rows sum to sizes, columns to shard sizes at most one apart."""
    rng = random.Random(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in sizes:
        left, row = sum(room), []
        for s in range(shards):
            left -= room[s]
            x = hypergeometric(room[s], left, n, rng)
            row.append(x)
            n -= x
        room = [r - x for r, x in zip(room, row, strict=True)]
        out.append(row)
    return out


def own_hash(seed: int, step: int, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(step), F.col(key), F.col("text_crc32"), F.col("size"), F.col("copy"))


def key_order(seed: int, step: int, key: str) -> list[Column]:
    """Order of a permutation: a hash by seed and step, then what is left to tell rows apart."""
    return [own_hash(seed, step, key), F.col(key), F.col("text_crc32"), F.col("size"), F.col("copy")]


def numbered(skinny: DataFrame, *by: str) -> DataFrame:
    """The rows with copy: equal rows are counted, by partial sums, and made again with numbers from 0.

    Many equal rows are made again in stretches over many tasks, so they are never one group.
    """
    counts = stored(skinny.groupBy(*by).agg(F.count("*").alias("count")), "counts")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = counts.where(F.col("count") <= STRETCH).select(*by, upto(F.col("count")).alias("copy"))
    many = counts.where(F.col("count") > STRETCH)
    if many.isEmpty():
        return few
    cut = many.select(*by, "count", upto(F.ceil(F.col("count") / STRETCH)).alias("part")).repartition(*by, "part")
    left = F.least(F.lit(STRETCH).cast("long"), F.col("count") - F.col("part") * STRETCH)
    return few.unionByName(cut.select(*by, "part", upto(left).alias("at")).select(*by, (F.col("part") * STRETCH + F.col("at")).alias("copy")))


def measured(docs: DataFrame, text: str) -> dict[str, Column]:
    """size and text_crc32 of a row."""
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return {"size": (F.octet_length(whole) + 16).cast("long"), "text_crc32": F.crc32(whole).cast("long")}


def shuffled(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shards: int = 40, seed: int = 5, partitions: int = PARTITIONS, rows: int = ROWS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each row of docs; slots are gapless from 0 in each shard.

    size is the UTF-8 bytes of the text (null: none) and 16; texts are read whole. Every shuffle of the rows is as
    likely as every other, as far as the hash and the seed go, and shard sizes are at most one apart, with any ties,
    nulls or repeated rows: equal rows are interchangeable and are spread as others are. An empty table gives an empty
    result; other columns play no part.
    """
    return placed_rows(docs, key, text, shards, seed, partitions, rows).drop("copy")


def placed_rows(docs: DataFrame, key: str, text: str, shards: int, seed: int, partitions: int = PARTITIONS, rows: int = ROWS) -> DataFrame:
    """shuffled() with copy, which numbers equal rows from 0."""
    skinny = docs.select(key, *(c.alias(name) for name, c in measured(docs, text).items()))
    placed = stored(numbered(skinny, key, "size", "text_crc32"), "skinny")
    n = placed.count()
    parts = max(partitions, -(-n // rows))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), key, "text_crc32", "size", "copy"), F.lit(parts)).cast("int"))
    count = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # parts rows
    drawn = matrix([count.get(p, 0) for p in range(parts)], shards, seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in drawn]
    sent = docs.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("part", "ends"))  # parts x shards numbers
    first = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*key_order(seed, 1, key))) - 1)
    dealt = first.join(F.broadcast(sent), "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    # the second permutation: blocks of a shard by the leading part of a hash, then by the hash inside a block
    blocks = max(1, -(-n // (shards * rows)))
    moved = stored(dealt.select(key, "size", "text_crc32", "copy", "shard", F.pmod(own_hash(seed, 2, key), F.lit(blocks)).cast("int").alias("block")), "moved")
    heads = moved.groupBy("shard", "block").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = stored(heads.select("shard", "block", start.alias("start")), "heads")  # shards x blocks rows
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy(*key_order(seed, 3, key))) - 1
    return moved.withColumn("inside", inside).join(F.broadcast(heads), ["shard", "block"]).select(key, "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), "copy")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", *, shards: int = 40, seed: int = 5) -> tuple[str, str]:
    """docs as Parquet in one folder for each shard, rows in the order of their slots; the names of the columns of shard and slot.

    Every row is written once, rows with a null key and rows that share a key or are equal too. The new columns are
    called shard and slot, with underscores before the name if docs has such a column. An empty table writes no folder.
    """
    shard, slot = free_name(docs.columns, "shard"), free_name(docs.columns, "slot")
    own = {c: free_name([*docs.columns, shard, slot], c) for c in ("size", "text_crc32", "copy", "part")}
    placed = stored(placed_rows(docs, key, text, shards, seed), "placed")
    again = stored(placed.where("copy > 0").select(F.col(key).alias("k"), F.col("size").alias("s"), F.col("text_crc32").alias("c")).distinct(), "again")
    same = lambda k, s, c: F.col(key).eqNullSafe(F.col(k)) & (F.col(own["size"]) == F.col(s)) & (F.col(own["text_crc32"]) == F.col(c))
    rows = docs.withColumns({own[n]: c for n, c in measured(docs, text).items()})
    once = join_checked(rows, again, same("k", "s", "c"), "left_anti").withColumn(own["copy"], F.lit(0).cast("long"))
    if not again.isEmpty():  # equal keys and texts are numbered inside their partitions, after those of the partitions before
        many = stored(join_checked(rows, again, same("k", "s", "c"), "left_semi").withColumn(own["part"], F.spark_partition_id()), "many")
        group = [key, own["size"], own["text_crc32"]]
        counts = many.groupBy(*group, own["part"]).count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy(*group).orderBy(own["part"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = counts.select(F.col(key).alias("k"), F.col(own["size"]).alias("s"), F.col(own["text_crc32"]).alias("c"), F.col(own["part"]).alias("p"), before.alias("start"))
        inside = F.row_number().over(Window.partitionBy(*group, own["part"]).orderBy(F.lit(0))) - 1
        many = many.withColumn(own["copy"], inside).join(before, same("k", "s", "c") & (F.col(own["part"]) == F.col("p"))).withColumn(own["copy"], (F.col("start") + F.col(own["copy"])).cast("long"))
        once = once.unionByName(many.select(*once.columns))
    at = placed.select(F.col(key).alias("k"), F.col("size").alias("s"), F.col("text_crc32").alias("c"), F.col("copy").alias("n"), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = once.join(at, same("k", "s", "c") & (F.col(own["copy"]) == F.col("n"))).select(*docs.columns, shard, slot)
    out.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot
