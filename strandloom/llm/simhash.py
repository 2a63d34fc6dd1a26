"""SimHash near-duplicates by a self-join of a binary trie over the fingerprints.

Fingerprints are made once per text. Distinct fingerprints are joined with themselves: the 64 bits are cut into
k blocks; two fingerprints that differ in at most `budget` bits agree in at least k - budget of them, so for each
choice of k - budget blocks the trie whose bits start with those blocks has both in one subtree below a node that no
error was spent on. Each such subtree is one key of a shuffle. Inside it node pairs are traversed together, level by
level; a pair carries its differing bits and is dropped when they exceed the budget. k grows with the logarithm of
the number of fingerprints, so that subtrees stay small; one that is large for all that is cut into tiles. A subtree gives a spanning forest of its links as edges of
bounded degree, never all pairs; components are then found by contraction of the edges in DataFrame joins.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from .common import join_checked, map_text, stored

BITS = 64
#: Node pairs that one step of the traversal holds; more are put off to later steps.
FRONTIER = 1 << 19
#: Rows of whole cells that are traversed in one go, and rows of a tile at most, about.
GO, TILE = 1 << 16, 1 << 14
#: Children of a node in the emitted trees of links.
FAN = 16


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Majority bits of XXH64 over all word shingles, repeats included; A-Z lower-cased. No words or null: 0."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    whole = b" ".join(tokens)
    ends = list(itertools.accumulate(len(t) + 1 for t in tokens))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(tokens) - words + 1
    starts = [0, *ends]
    for at in range(0, n, 1 << 16):  # long texts take bounded memory
        h = np.array([digest(whole[a : b - 1], seed) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[at + words - 1 :], strict=False)], np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp long): the fingerprint of each row's whole text, as a signed long."""

    def made(_, texts):
        return [np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)]

    return map_text(docs, key, text, lambda k, t: [pa.array(made(k, t)[0])], "fp long", binary=True)


def blocks_for(n: int, budget: int) -> int:
    """Number of blocks k: the smallest for which k - budget agreeing blocks hold about log2(n) - 6 bits."""
    need = max(0.0, math.log2(max(n, 2)) - 6)
    k = budget + 1
    while (k - budget) * BITS / k < need and k < budget + 5:
        k += 1
    return k


def rotations(k: int, budget: int) -> list[list[tuple[int, int]]]:
    """For each choice of k - budget blocks, the (shift, width) of the chosen blocks, then of the others, from the top bit."""
    cut = [round(i * BITS / k) for i in range(k + 1)]
    fields = [(BITS - cut[i + 1], cut[i + 1] - cut[i]) for i in range(k)]
    return [[fields[i] for i in own] + [fields[i] for i in range(k) if i not in own] for own in itertools.combinations(range(k), k - budget)]


def trie_pairs(bits: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], skip: int, budget: int):
    """Yield arrays (a, b) of positions whose values differ in at most budget bits, from a trie join.

    pairs: ranges [a0, a1) and [b0, b1) of bits, a pair of nodes each, or twice one range for a node with itself. In
    a range the uint64 values are sorted; in a pair all agree in the first skip bits. A node is a range of
    positions. A step takes node pairs at one level, splits both nodes by the next bit, adds the differing bit and
    drops what exceeds the budget. Pairs of single leaves are finished by a popcount of what is left.
    """
    stack = [(skip, *pairs, np.zeros(len(pairs[0]), np.int8))]
    ones = {}
    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            h = len(a0) // 2
            stack += [(level, a0[:h], a1[:h], b0[:h], b1[:h], diff[:h]), (level, a0[h:], a1[h:], b0[h:], b1[h:], diff[h:])]
            continue
        same = a0 == b0
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        done = leaf & ~same
        if done.any():
            x, y = a0[done], b0[done]
            near = np.bitwise_count(bits[x] ^ bits[y]) <= budget
            if near.any():
                yield x[near], y[near]
        keep = ~leaf
        if not keep.any():
            continue
        a0, a1, b0, b1, diff, same = a0[keep], a1[keep], b0[keep], b1[keep], diff[keep], same[keep]
        if level < BITS:
            if level not in ones:
                ones[level] = np.concatenate(([0], np.cumsum((bits >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)))
            c = ones[level]
            am, bm, by = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0]), 1
        else:  # ranges of equal values are halved
            am, bm, by = (a0 + a1) // 2, (b0 + b1) // 2, 0
        parts = []
        for p0, p1, q0, q1, cost, which in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, by, None), (am, a1, b0, bm, by, ~same)):
            ok = (p1 > p0) & (q1 > q0) & (diff + cost <= budget)
            if which is not None:
                ok &= which  # of a node with itself the two mixed children are one pair
            if ok.any():
                parts.append((p0[ok], p1[ok], q0[ok], q1[ok], diff[ok] + np.int8(cost)))
        if parts:
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


class Forest:
    """Union-find over positions by vectorised hooking to the smaller root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        r = self.root
        while True:
            x, y = r[a], r[b]
            far = x != y
            if not far.any():
                return
            a, b, x, y = a[far], b[far], x[far], y[far]
            np.minimum.at(r, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = r[r]
                if (up == r).all():
                    break
                r[:] = up


def spanning_edges(values: np.ndarray, rotated: np.ndarray, pairs: tuple, skip: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of trees with FAN children a node that span the values that the node pairs link."""
    forest = Forest(len(values))
    for a, b in trie_pairs(rotated, pairs, skip, budget):
        forest.link(a, b)
    order = np.lexsort((values, forest.root))
    root = forest.root[order]
    first = np.concatenate(([True], root[1:] != root[:-1])) if len(root) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(root)), 0))
    place = np.arange(len(root)) - start
    child = place > 0
    return values[order[child]], values[order[start[child] + (place[child] - 1) // FAN]]


def links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(u, v) edges, u > v, over a stored table of distinct fingerprints (fp long) with the components of all links."""
    n = prints.count()
    k = blocks_for(n, budget)
    plans = rotations(k, budget)
    skips = [sum(w for _, w in plan[: k - budget]) for plan in plans]
    mask = lambda w: (1 << w) - 1

    def keyed(plan):
        key = F.lit(0).cast("long")
        for shift, width in plan[: k - budget]:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask(width))))
        return key

    rows = prints.select("fp", F.posexplode(F.array(*[keyed(p) for p in plans])).alias("trie", "node"))

    def turned(fp: np.ndarray, trie: int) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for shift, width in plans[trie]:
            out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64(mask(width)))
        return out

    def go(trie, bits, values, pairs, _):
        u, v = spanning_edges(values[0], bits, pairs, skips[trie], budget)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return cells(tiled(rows), (), go, "u long, v long", turned).distinct()


def cells(rows: DataFrame, more: tuple[str, ...], go, schema: str, turned=lambda fp, _: fp) -> DataFrame:
    """The batches go(trie, bits, values, pairs, cell) for whole cells of rows (fp, trie, node, left, right, tile, *more).

    A cell is a node with itself, or two tiles of a large node with each other. Many cells of a trie are handed over at
    once, sorted by cell, tile and bits: values are fp and the columns `more`, pairs the ranges for trie_pairs(), cell
    the number of each row's cell.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ("trie", "node", "left", "right")
    rest = [c for c in more if c not in cell]
    rows = rows.select("fp", *cell, "tile", *rest).repartition(parts, *cell).sortWithinPartitions(*cell)

    def starts(*columns: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1))

    def whole(trie: int, fp, node, left, right, tile, *others):
        bits = turned(fp, trie)
        order = np.lexsort((bits, tile, right, left, node))
        bits, fp, node, left, right, tile, *others = (x[order] for x in (bits, fp, node, left, right, tile, *others))
        own, every = starts(node, left, right), starts(node, left, right, tile)
        ends = np.concatenate((every[1:], [len(fp)]))
        one = left[own] == right[own]
        at = np.searchsorted(every, own)
        other = np.where(one, at, np.minimum(at + 1, len(every) - 1))
        # a cell of two tiles of which one has no rows has no pair
        good = one | ((other > at) & (np.searchsorted(own, every[other], "right") - 1 == np.arange(len(own))))
        at, other = at[good], other[good]
        named = dict(zip(rest, others, strict=True)) | {"node": node}
        number = np.repeat(np.arange(len(own)), np.diff(np.concatenate((own, [len(fp)]))))
        return go(trie, bits, (fp, *(named[c] for c in more)), (every[at], ends[at], every[other], ends[other]), number)

    def column(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy().reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            fp, *others = (column(x) for x in batch.columns)
            if not len(fp):
                continue
            held.append((fp.view(np.uint64), *others))
            if sum(len(x[0]) for x in held) >= GO:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.flatnonzero(np.any([c != c[-1] for c in cols[1:5]], axis=0))
                until = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
                yield from each([c[:until] for c in cols])
                held = [tuple(c[until:] for c in cols)]
        if held:
            yield from each([np.concatenate(x) for x in zip(*held, strict=True)])

    def each(cols):
        fp, trie, *others = cols
        for t in np.unique(trie):
            own = trie == t
            yield whole(int(t), fp[own], *(c[own] for c in others))

    return rows.mapInArrow(run, schema)


def tiled(rows: DataFrame, by: str = "fp") -> DataFrame:
    """rows (fp, trie, node, and more) with left, right and tile: the cell that a row is dealt to, and its place in the cell.

    A node is one cell, (0, 0). One with more than TILE rows is cut into tiles of about that size by a hash of the
    column `by`, and each pair of its tiles is a cell, so that no task holds more than two tiles however many fingerprints stand below a node.
    """
    large = stored(rows.groupBy("trie", "node").count().where(F.col("count") > TILE).select("trie", "node", F.ceil(F.col("count") / TILE).alias("tiles")), "large")
    if large.isEmpty():
        zero = F.lit(0).cast("int")
        return rows.withColumns({"left": zero, "right": zero, "tile": zero})
    dealt = join_checked(rows, large, ["trie", "node"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(by), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    return dealt.withColumns({"left": F.least("tile", "other"), "right": F.greatest("tile", "other")})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) for each row of docs.

    Null, empty and blank texts have fingerprint zero, which links as any other. Equal keys and rows stay as they
    are. component_id is the least key of the component (nulls aside). An empty table gives an empty result; other
    columns play no part.
    """
    prints = stored(fingerprints(docs, key, text, words, seed), "prints")
    least = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    label = stored(components(links(least.select("fp"), budget)).select(F.col("node").alias("fp"), F.col("component").alias("label")), "labels")
    top = stored(label.join(least, "fp").groupBy("label").agg(F.min("least").alias("component_id")), "tops")
    linked = stored(label.join(top, "label").select("fp", "component_id"), "linked")
    named = stored(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return join_checked(prints, named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs whose key is the least of their component; of rows that share that key one stays.

    Rows with a null key can't be named and all stay. Columns and texts are those of docs.
    """
    return least_of_each(docs, near_duplicates(docs, key, text, **how), key)


def least_of_each(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """drop_near_duplicates() by the components found (key, component_id)."""
    found = stored(found.where(F.col(key).isNotNull()), "found")
    gone = stored(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    kept = join_checked(docs, gone, key, "left_anti")
    again = stored(found.groupBy(key).count().where("count > 1").select(key), "again")
    if again.isEmpty():
        return kept
    return join_checked(kept, again, key, "left_anti").unionByName(join_checked(kept, again, key, "left_semi").dropDuplicates([key]))
