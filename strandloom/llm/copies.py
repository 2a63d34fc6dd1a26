"""Near copies: SimHash fingerprints in a binary trie join as candidates, confirmed by the exact Jaccard similarity.

At a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, so the budget must be wide, and then no block of
the bits surely agrees that a trie could start from. Tries start from bands of least shingles instead: a text has BANDS
bands of DEPTH min-hashes each over its set of word shingles, and texts with a band in common stand in one trie. In a
trie node pairs are traversed together with the wide budget; pairs that are left must also have like lengths and parity
maps that allow the similarity. Every text first meets the least one of its tries, which folds most groups at once.
Then each text proposes its few nearest ones of another component; proposals are confirmed on the sets of shingles,
which are made once, confirmed ones are contracted, and rounds go on, with more proposals a text each time, until no
text holds any back. So a group of m copies costs about m confirmations, and no pair below the budget is left out.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from .common import join_checked, map_text, stored
from .simhash import BITS, cells, tiled, trie_pairs

#: Bands and min-hashes in each. Texts of similarity s miss all bands with probability (1 - s^DEPTH)^BANDS: 4e-5 at 0.8.
BANDS, DEPTH = 14, 3
#: Bits in which fingerprints may differ; at a similarity of 0.8 about 9.7 are expected, with a deviation of 2.9.
BUDGET = 24
#: Longs of a text's parity map: each shingle turns one bit over, so two maps differ in no more bits than the sets in shingles.
LONGS = 16
#: Proposals of a text in the first round, and by how much they grow in a round.
FIRST, GROWTH = 4, 64
#: Shingles in the texts that a task compares at once, about.
PACK = 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_MINS = (np.random.default_rng(1).integers(0, 1 << 64, (2, BANDS * DEPTH, 1), np.uint64, False)) | np.uint64(1)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes (uint64) of all word shingles, A-Z lower-cased; fewer words are one shingle."""
    tokens = (text or b"").lower().split()
    h = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    n = max(1, len(h) - words + 1)
    total = np.full(n, min(len(h), words), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            total = (total ^ h[i : i + n]) * np.uint64(_MIX[0])
            total = (total ^ (total >> np.uint64(29))) * np.uint64(_MIX[1])
        total ^= total >> np.uint64(32)
    return np.unique(total)


def sketch(own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(majority fingerprint, band keys, parity map) of a set of shingles."""
    ones, least = np.zeros(BITS, np.int64), np.full(BANDS * DEPTH, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 1 << 14):
            h = own[at : at + (1 << 14)]
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            least = np.minimum(least, ((h ^ _MINS[0]) * _MINS[1]).min(axis=1))
        band = np.arange(1, BANDS + 1, dtype=np.uint64)  # keys of unlike bands differ
        for x in least.reshape(BANDS, DEPTH).T:
            band = (band ^ x) * np.uint64(_MIX[1])
            band ^= band >> np.uint64(31)
    fp = int.from_bytes(np.packbits(ones * 2 > len(own)).tobytes(), "big")
    return fp, band.view(np.int64), parity(own)


def parity(own: np.ndarray) -> np.ndarray:
    """The parity map of a set of shingles, as longs."""
    odd = np.bincount(((own >> np.uint64(7)) % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def identified(docs: DataFrame, text: str) -> DataFrame:
    """(id, text): the hash of each text's bytes, null as empty."""
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.xxhash64(whole).alias("id"), whole.alias("text"))


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(id, fp, n, bands, map) for each row of texts (id, text as bytes)."""

    def made(_, rows):
        out = [[], [], [], []]
        for t in rows:
            own = shingles(t, words)
            for column, x in zip(out, (len(own), *sketch(own)), strict=True):
                column.append(x)
        n, fp, bands, maps = out
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(x[0]), pa.int32()), pa.array(np.concatenate(x)))
        return [np.array(fp, np.uint64).view(np.int64), n, lists(bands), lists(maps)]

    return map_text(texts, "id", "text", made, "fp long, n int, bands array<long>, map array<long>")


def proposals(rows: DataFrame, most: int, pairs_of, allowed) -> DataFrame:
    """(u, v, node, size, more): for each text of a node its `most` likeliest copies of another label, and the node's middle.

    rows: (fp, trie, node, left, right, tile, id, label, n, map). pairs_of(bits, pairs) yields arrays of positions, as
    trie_pairs() does; allowed(n, maps, a, b) gives (a, b, apart) of the pairs that may be links. more: some were held back.
    """

    def go(_, bits, values, pairs, cell):
        fp, node, ids, label, n, maps = values
        maps = maps.view(np.uint64)  # counted without a sign
        kept = [np.zeros(0, np.int64)] * 3
        held = np.zeros(len(fp), bool)

        def unlike(a, b):
            ok = label[a] != label[b]
            return allowed(n, maps, a[ok], b[ok])

        def nearest(a, b, apart):
            order = np.lexsort((ids[b], apart, a))
            a, b, apart = a[order], b[order], apart[order]
            start = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
            place = np.arange(len(a)) - np.maximum.accumulate(np.where(start, np.arange(len(a)), 0))
            held[a[place >= most]] = True
            return [x[place < most] for x in (a, b, apart)]

        for a, b in pairs_of(bits, pairs):
            a, b, apart = unlike(a, b)
            kept = [np.concatenate(x) for x in zip(kept, (a, b, apart), (b, a, apart), strict=True)]
            if len(kept[0]) > 4 * most * len(fp) + (1 << 16):
                kept = nearest(*kept)
        a, b, _ = nearest(*kept)
        if held.any():  # only then the middle of a node saves work
            middle, row = middles(fp, cell)
            ok = row != middle
            x, y, _ = unlike(row[ok], middle[ok])
            a, b = np.concatenate((a, x)), np.concatenate((b, y))
        u, v = ids[a], ids[b]
        cols = (np.minimum(u, v), np.maximum(u, v), node[a], (n[a] + n[b]).astype(np.int64), held[a] | held[b])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["u", "v", "node", "size", "more"])

    return cells(rows, ("node", "id", "label", "n", "map"), go, "u long, v long, node long, size long, more boolean")


def apart(maps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the maps of rows a and b differ."""
    return np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64)


def close(n: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n[a] and n[b] shingles may be as similar as least."""
    return np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-6


def near_maps(n: np.ndarray, maps: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the parity maps differ in no more bits than sets as similar as least do in shingles."""
    both = n[a] + n[b]
    return apart(maps, a, b) <= both - 2 * np.ceil(least / (1 + least) * both - 1e-6)


def bits_apart(a: str, b: str, longs: range) -> Column:
    """apart() of two columns of arrays of longs."""
    return functools.reduce(operator.add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in longs])


def near_columns(u: str, v: str, least: float, longs: range = range(LONGS)) -> Column:
    """close() and near_maps() of two columns (n, map), whose parity maps are at longs."""
    n, m = F.col(f"{u}.n"), F.col(f"{v}.n")
    both = n + m
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-6) & (bits_apart(f"{u}.map", f"{v}.map", longs) <= both - 2 * F.ceil(least / (1 + least) * both - 1e-6))


def middles(fp: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, row): for each row that of its cell whose fingerprint is nearest to the cell's majority bits."""
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((start, [len(cell)])))
    of = np.repeat(np.arange(len(start)), size)
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    major = np.add.reduceat(bits, start, axis=0, dtype=np.int64) * 2 > size[:, None]
    apart = (bits != major[of]).sum(axis=1)
    order = np.lexsort((apart, of))
    return order[start][of], np.arange(len(fp))


def confirmed(pairs: DataFrame, sets: DataFrame, least: float, star: bool = False) -> DataFrame:
    """(u, v) of the stored pairs (u, v, node, size) whose sets of shingles are as similar as least.

    Pairs go in packs of bounded size, those of a node together. The pairs of a large node are cut by blocks of u and
    blocks of v (star: all pairs of a node have the same u, so by v alone): a set goes to about twice the root of the
    node's parts, however many pairs it is in. A pack is one comparison task, which has each of its sets once.
    """
    total = pairs.agg(F.sum("size")).first()[0] or 0
    packs = max(1, -(-total // PACK))
    large = stored(pairs.groupBy("node").agg(F.ceil(F.sum("size") / PACK).alias("parts")).where("parts > 1"), "parts")
    block = lambda c, n: F.pmod(F.xxhash64(c), n)
    parts = F.coalesce("parts", F.lit(1))
    side = F.ceil(F.sqrt(parts)).cast("long")
    part = block("v", parts) if star else block("u", side) * side + block("v", side)
    packed = join_checked(pairs, large, "node", "left").withColumn("pack", F.pmod(F.xxhash64("node", part), F.lit(packs)).cast("int"))
    packed = stored(packed.select("pack", "u", "v"), "packed")
    needed = stored(packed.select("pack", F.explode(F.array("u", "v")).alias("id")).distinct(), "needed")
    dealt = join_checked(sets, needed, "id").select("pack", "id", "set")

    def compare(p: pa.Table, t: pa.Table) -> pa.Table:
        own = {}
        for batch in t.to_batches():
            ends = batch["set"].offsets.to_numpy()
            values = batch["set"].values.to_numpy()
            for i, a, b in zip(batch["id"].to_pylist(), ends[:-1], ends[1:], strict=True):
                own[i] = values[a:b]
        ok = []
        for a, b in zip(p["u"].to_pylist(), p["v"].to_pylist(), strict=True):
            x, y = own[a], own[b]
            if len(x) > len(y):
                x, y = y, x
            shared = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
            ok.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
        return pa.table({"u": p["u"], "v": p["v"]}).filter(pa.array(ok, pa.bool_()))

    return packed.groupBy("pack").cogroup(dealt.groupBy("pack")).applyInArrow(compare, "u long, v long")


def shingle_sets(texts: DataFrame, meeting: DataFrame, words: int) -> DataFrame:
    """(id, set): the sorted shingles of each text (id, text) whose id is in the stored table meeting, once."""

    def made(_, rows):
        sets = [shingles(t, words).view(np.int64) for t in rows]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.sort(x) for x in sets])))]

    return map_text(join_checked(texts, meeting, "id", "left_semi").dropDuplicates(["id"]), "id", "text", made, "set array<long>")


def meeting(marks: DataFrame) -> DataFrame:
    """(id, node, hub), stored: the nodes in which unlike ids of marks (id, bands) meet, and the least id of each."""
    bands = marks.select("id", F.explode("bands").alias("node"))
    shared = stored(bands.groupBy("node").agg(F.min("id").alias("hub"), F.max("id").alias("b")).where("hub < b").select("node", "hub"), "shared")
    return stored(join_checked(bands, shared, "node").distinct(), "met")


def linked(met: DataFrame, own: DataFrame, sets: DataFrame, least: float, near: Callable[[str, str], Column], propose: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(id, label), stored: components of the ids that stand in any link, by the stored tables met, own (id, fp, n, map) and sets.

    First each id meets the least id of its nodes, if near(u, v), a condition over two rows of own, allows a link; then
    rounds of propose(rows, most), as proposals() makes them, go over the nodes that still hold unlike labels.
    """
    side = lambda c: own.select(F.col("id").alias(c), F.struct("fp", "n", "map").alias(f"own_{c}"))
    stars = stored(met.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct(), "stars")
    pairs = join_checked(join_checked(stars, side("v"), "v"), side("u"), "u").where(near("own_u", "own_v"))
    pairs = stored(pairs.select("u", "v", F.col("u").alias("node"), (F.col("own_u.n") + F.col("own_v.n")).cast("long").alias("size")), "pairs")
    edges = stored(confirmed(pairs, sets, least, star=True), "links")
    tested, most = pairs.select("u", "v"), FIRST
    while True:
        label = stored(components(edges).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
        rows = join_checked(met.select("id", "node"), label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_ = stored(rows.groupBy("node").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("node"), "open")
        rows = stored(join_checked(rows, open_, "node", "left_semi").select("id", "label", "node"), "rows")
        found = stored(propose(join_checked(rows, own, "id").withColumn("trie", F.lit(0)), most), "proposals")
        pairs = found.groupBy("u", "v").agg(F.min("node").alias("node"), F.first("size").alias("size"))
        pairs = stored(join_checked(pairs, tested, ["u", "v"], "left_anti"), "pairs")
        new = stored(confirmed(pairs, sets, least), "links")
        if not new.isEmpty():
            edges = stored(edges.unionByName(new), "links")
        if found.where("more").isEmpty():
            return label if new.isEmpty() else stored(components(edges).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
        tested = stored(tested.unionByName(pairs.select("u", "v")), "tested")
        most *= GROWTH


def links(docs: DataFrame, text: str = "text", words: int = 5, least: float = 0.8, budget: int = BUDGET) -> DataFrame:
    """(id, label), stored: components of the texts, named by the hash of their bytes, that stand in any link."""
    texts = identified(docs, text)
    made = stored(sketches(texts, words), "sketches")
    met = meeting(made)
    ids = stored(met.select("id").distinct(), "meeting")
    own = stored(join_checked(made, ids, "id", "left_semi").select("id", "fp", "n", "map").dropDuplicates(["id"]), "own")
    sets = stored(shingle_sets(texts, ids, words), "sets")

    def allowed(n, maps, a, b):
        for sure in (lambda: close(n, a, b, least), lambda: near_maps(n, maps, a, b, least)):
            ok = sure()
            a, b = a[ok], b[ok]
        return a, b, apart(maps, a, b)

    def near(u, v):
        return (F.bit_count(F.col(f"{u}.fp").bitwiseXOR(F.col(f"{v}.fp"))) <= budget) & near_columns(u, v, least)

    pairs_of = lambda bits, pairs: trie_pairs(bits, pairs, 0, budget)
    return linked(met, own, sets, least, near, lambda rows, most: proposals(tiled(rows, "id"), most, pairs_of, allowed))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, budget: int = BUDGET) -> DataFrame:
    """(key, component_id) for each row of docs: the least key of the rows that chains of near copies link (nulls aside).

    Null, empty and blank texts are copies of each other. Equal keys and rows stay as they are; long texts are read
    whole. An empty table gives an empty result; other columns play no part.
    """
    names = stored(docs.select(key, F.xxhash64(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("id")), "names")
    named = stored(names.groupBy("id").agg(F.min(key).alias("least")), "distinct")
    whole = stored(join_checked(named, links(docs, text, words, least, budget), "id", "left").withColumn("label", F.coalesce("label", "id")), "whole")
    top = stored(whole.groupBy("label").agg(F.min("least").alias("component_id")), "tops")
    linked = stored(join_checked(whole, top, "label").select("id", "component_id"), "linked")
    return join_checked(names, linked, "id").select(key, "component_id")
