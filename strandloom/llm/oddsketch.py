"""MinHash near-duplicates, with odd sketches between the bands and the exact check.

A text's set of word shingles has BANDS * DEPTH MinHash samples. Texts that agree in all samples of a band meet in a
node. The samples are also folded into a parity map of BITS bits: each turns one bit over, so the maps of two texts
differ by the samples in which the texts differ, and the count of ones of their XOR estimates a high similarity far more
precisely than a band does. Pairs whose count is not credible for a link are dropped; the others must be near enough by
sure bounds on their sets' difference (their sizes, and a parity map of the whole sets, which differs in no more bits
than the sets do in shingles) and are confirmed on the whole sets. llm.copies says how pairs of a node are visited
without emitting them all.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, map_text, stored
from .copies import LONGS as MAP, apart, bits_apart, close, identified, linked, meeting, near_columns, near_maps, parity, proposals, shingle_sets, shingles
from .simhash import tiled

#: Bands and samples in each. Texts of similarity s share no band with probability (1 - s^DEPTH)^BANDS: 8e-7 at 0.85.
BANDS, DEPTH = 24, 5
#: Bits of the odd sketch, in longs.
LONGS = 8
#: Probability that the sketches of two texts of just the least similarity differ by more than is allowed.
MISS = 1e-7
#: Shingles hashed at once.
STRETCH = 1 << 11
#: Pairs that are compared at once.
PAIRS = 1 << 19
_SAMPLES = BANDS * DEPTH
_KEYS = np.random.default_rng(2).integers(0, 1 << 64, (3, _SAMPLES, 1), np.uint64, False) | np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def allowed_bits(least: float, samples: int = _SAMPLES, bits: int = 64 * LONGS, miss: float = MISS) -> int:
    """The fewest differing bits that sketches of two texts of similarity `least` exceed with probability `miss` at most.

    A sample differs with probability 1 - least and then turns over one bit of either sketch.
    """
    walk = np.zeros(bits + 1)
    walk[0] = 1.0
    up = 1 - np.arange(bits + 1) / bits
    total, chance = np.zeros(bits + 1), float(least) ** samples
    for differ in range(samples + 1):
        total += chance * walk
        chance *= (samples - differ) / (differ + 1) * (1 - least) / least
        for _ in range(2):
            moved = np.zeros_like(walk)
            moved[1:] += (walk * up)[:-1]
            moved[:-1] += (walk * (1 - up))[1:]
            walk = moved
    tail = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(tail > miss)[-1])


def estimate(differing: np.ndarray, samples: int = _SAMPLES, bits: int = 64 * LONGS) -> np.ndarray:
    """Similarity estimated from the number of differing bits."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(differing) / bits, 1e-12))


def sketch(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch of the samples) of a set of shingle hashes."""
    least = np.full((_SAMPLES, 1), (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), STRETCH):
            least = np.minimum(least, ((own[at : at + STRETCH] ^ _KEYS[0]) * _KEYS[1]).min(axis=1, keepdims=True))
        band = np.arange(1, BANDS + 1, dtype=np.uint64)  # keys of unlike bands differ
        for x in least.reshape(BANDS, DEPTH).T:
            band = (band ^ x) * _MIX
            band ^= band >> np.uint64(32)
        place = (least ^ _KEYS[2]) * _MIX
        place = ((place ^ (place >> np.uint64(32))) * _MIX)[:, 0] >> np.uint64(64 - (64 * LONGS).bit_length() + 1)
    odd = np.bincount(place.astype(np.int64), minlength=64 * LONGS) & 1
    return band.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, id, n, bands, map) for each row of docs: the hash of its text's bytes, the size of its set, band keys, odd sketch and parity map."""

    def made(_, rows):
        ids, sizes, bands, maps = [], [], [], []
        for t in rows:
            ids.append(xxhash.xxh64_intdigest(t or b"", 42))
            own = shingles(t, words) if (t or b"").strip() else np.zeros(0, np.uint64)
            band, odd = sketch(own)
            sizes.append(len(own))
            bands.append(band if len(own) else band[:0])
            maps.append(np.concatenate((odd, parity(own))))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(y) for y in x]))), pa.int32()), pa.array(np.concatenate(x)))
        return [np.array(ids, np.uint64).view(np.int64), sizes, lists(bands), lists(maps)]

    return map_text(docs, key, text, made, "id long, n int, bands array<long>, map array<long>", binary=True)


def range_pairs(_, pairs):
    """Yield arrays (a, b) of positions: all pairs of the ranges [a0, a1) and [b0, b1), each once if they are one range."""
    a0, a1, b0, b1 = pairs
    size = a1 - a0
    own = np.repeat(np.arange(len(size)), size)
    row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + a0[own]
    begin = np.where(a0[own] == b0[own], row + 1, b0[own])
    count = b1[own] - begin
    total = np.cumsum(count)
    cut = 0
    while cut < len(count):
        done = total[cut - 1] if cut else 0
        upto = max(cut + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        c = count[cut:upto]
        yield np.repeat(row[cut:upto], c), np.arange(c.sum()) + np.repeat(begin[cut:upto] - (total[cut:upto] - c - done), c)
        cut = upto


def links(docs: DataFrame, marks: DataFrame, text: str = "text", words: int = 5, least: float = 0.85) -> DataFrame:
    """(id, label), stored: components of the texts that stand in any link, by the stored sketches of docs."""
    met = meeting(marks)
    ids = stored(met.select("id").distinct(), "meeting")
    own = stored(join_checked(marks, ids, "id", "left_semi").select("id", F.get("map", F.lit(0)).alias("fp"), "n", "map").dropDuplicates(["id"]), "own")
    sets = stored(shingle_sets(identified(docs, text), ids, words), "sets")
    most_bits = allowed_bits(least)

    def allowed(n, maps, a, b):
        for sure in (lambda: close(n, a, b, least), lambda: apart(maps[:, :LONGS], a, b) <= most_bits, lambda: near_maps(n, maps[:, LONGS:], a, b, least)):
            ok = sure()
            a, b = a[ok], b[ok]
        return a, b, apart(maps[:, :LONGS], a, b)

    def near(u, v):
        return (bits_apart(f"{u}.map", f"{v}.map", range(LONGS)) <= most_bits) & near_columns(u, v, least, range(LONGS, LONGS + MAP))

    return linked(met, own, sets, least, near, lambda rows, most: proposals(tiled(rows, "id"), most, range_pairs, allowed))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs.

    Texts are linked if their sets of distinct word shingles have a Jaccard similarity of `least` or more; component_id
    is the least key (nulls aside) of what chains of links reach, kept tells whether it is the row's own. A text with
    fewer words is one shingle; null, empty and blank texts have none, are linked with nothing and keep their own key.
    A pair of just the least similarity is missed with a probability below 1e-6. Equal keys and rows stay as they are;
    long texts are read whole. An empty table gives an empty result; other columns play no part.
    """
    marks = stored(sketches(docs, key, text, words), "sketches")
    label = links(docs, marks, text, words, least)
    least_key = stored(marks.where("n > 0").groupBy("id").agg(F.min(key).alias("least")), "distinct")
    whole = stored(join_checked(least_key, label, "id", "left").withColumn("label", F.coalesce("label", "id")), "whole")
    top = stored(whole.groupBy("label").agg(F.min("least").alias("component_id")), "tops")
    named = stored(join_checked(whole, top, "label").select("id", "component_id"), "named")
    out = join_checked(marks.select(F.col(key), "id", F.col("n").cast("long").alias("n_shingles")), named, "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
