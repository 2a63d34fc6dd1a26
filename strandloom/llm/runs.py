"""Maximal runs of words by Stoye and Gusfield's traversal of a suffix tree, and texts with their runs collapsed.

Each text has its own suffix tree over word numbers, held as intervals of a suffix array: prefix doubling sorts the
suffixes of many texts at once, the lengths of common prefixes give the tree's nodes. At a node of depth d only the
leaves outside its largest child are listed; leaf i gives a branching tandem repeat of period d if i + d, or i - d, is
a leaf of the node too and the words after the two copies differ. Rotating such a repeat to the left as far as words
at distance d agree gives its whole run, so every maximal run is found from the one repeat that ends where it ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
#: Words whose trees are built at once; a longer text is alone.
TOGETHER = 1 << 18
#: (leaf, node) pairs that are looked at in one go.
STRETCH = 1 << 21


class Suffixes:
    """Suffix array of texts that end in a symbol of their own, with the ranks of all blocks of 2^k symbols.

    first: rank of each symbol; symbols of unlike texts are unlike, so no common prefix leaves a text.
    """

    def __init__(self, first: np.ndarray):
        n = len(first)
        self.order = np.argsort(first, kind="stable")
        new = np.concatenate(([True], np.diff(first[self.order]) != 0))
        place = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(new, place, 0))
        self.ranks = [rank.astype(np.int32)]
        slots = self._shared(new)
        while len(slots):
            own, step = self.order[slots], 1 << (len(self.ranks) - 1)
            key = rank[own] * n + rank[own + step]  # a block that occurs twice ends before its text does
            by = np.argsort(key, kind="stable")
            own, key = own[by], key[by]
            self.order[slots] = own
            new = np.concatenate(([True], np.diff(key) != 0))
            rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
            self.ranks.append(rank.astype(np.int32))
            slots = slots[self._shared(new)]
        self.rank = self.ranks[-1]

    @staticmethod
    def _shared(new: np.ndarray) -> np.ndarray:
        """Places in groups of more than one; new tells where groups start."""
        return np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))

    def heights(self) -> np.ndarray:
        """Common prefix of the suffixes at places b - 1 and b, for b from 0 to n; 0 at both ends."""
        n = len(self.order)
        out = np.zeros(n + 1, np.int64)
        equal = [np.arange(1, n)]
        for rank in self.ranks:
            b = equal[-1]
            equal.append(b[rank[self.order[b - 1]] == rank[self.order[b]]])
        for k in range(len(self.ranks) - 1, -1, -1):
            b, rank = equal[k + 1], self.ranks[k]
            h = out[b]
            out[b] = h + ((rank[self.order[b - 1] + h] == rank[self.order[b] + h]).astype(np.int64) << k)
        return out

    def backwards(self, at: np.ndarray, apart: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """How many symbols before at, no further than lowest, equal those `apart` places later."""
        out = np.zeros(len(at), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            p = at - out - (1 << k)
            ok = p >= lowest
            ok[ok] = self.ranks[k][p[ok]] == self.ranks[k][p[ok] + apart[ok]]
            out[ok] += 1 << k
        return out


def _smaller(heights: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """For each place b the next one in direction way with a smaller height, by following pointers of pointers."""
    to = np.arange(len(heights)) + way
    while len(b):
        b = b[heights[to[b]] >= heights[b]]
        to[b] = to[to[b]]
    return to


def branching(tree: Suffixes, fewest: int = EXPONENT):
    """Yield (start, period) arrays of branching tandem repeats, at nodes of at least `fewest` leaves; some twice."""
    heights, first = tree.heights(), tree.ranks[0]
    inner = np.flatnonzero(heights)
    left, right = _smaller(heights, inner, -1), _smaller(heights, inner, 1)
    inner = inner[right[inner] - left[inner] >= fewest]
    inner = inner[np.lexsort((inner, right[inner], left[inner]))]
    if not len(inner):
        return
    lo, hi = left[inner], right[inner]
    new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    node = np.cumsum(new) - 1  # a node's boundaries cut its leaves into one child more
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(inner)])) - 1
    at = np.arange(len(inner)) + node
    starts, ends = np.empty(len(inner) + len(begin), np.int64), np.empty(len(inner) + len(begin), np.int64)
    starts[at + 1], starts[at[begin]] = inner, lo[begin]
    ends[at], ends[at[last] + 1] = inner, hi[begin]
    size, of = ends - starts, np.empty(len(starts), np.int64)
    of[at], of[at[last] + 1] = node, node[last]
    most = np.maximum.reduceat(size, at[begin])
    largest = np.flatnonzero(size == most[of])
    light = np.ones(len(size), bool)
    light[largest[np.concatenate(([True], np.diff(of[largest]) != 0))]] = False  # one largest child a node isn't listed
    starts, size, of = starts[light], size[light], of[light]
    depth, lo, hi = heights[inner[begin]], lo[begin], hi[begin]
    total = np.cumsum(size)
    cut = 0
    while cut < len(size):
        done = total[cut - 1] if cut else 0
        upto = max(cut + 1, int(np.searchsorted(total, done + STRETCH, "right")))
        count = size[cut:upto]
        v = np.repeat(of[cut:upto], count)
        i = tree.order[np.arange(count.sum()) + np.repeat(starts[cut:upto] - (total[cut:upto] - count - done), count)]
        d = depth[v]
        for near, far in ((i, i + d), (i - d, i)):
            other = far if near is i else near
            ok = other >= 0
            ok[ok] = (tree.rank[other[ok]] >= lo[v[ok]]) & (tree.rank[other[ok]] < hi[v[ok]])
            ok[ok] = first[near[ok] + d[ok]] != first[far[ok] + d[ok]]
            yield near[ok], d[ok]
        cut = upto


def maximal(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """For each text, as word numbers, its maximal runs as rows (start, length, period) by start, then period.

    A run has at least max(least, exponent * period) words, period is its smallest one; exponent is 2 or more.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
    if not lengths.sum():
        return [np.zeros((0, 3), np.int64) for _ in texts]
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    top = max(int(t.max()) for t in texts if len(t)) + 1
    symbols = np.full(bounds[-1], top, np.int64)
    ends = np.zeros(len(symbols), bool)
    ends[bounds[1:] - 1] = True
    symbols[~ends] = np.concatenate(texts)
    tree = Suffixes(owner * (top + 1) + symbols)
    found = [np.zeros((0, 2), np.int64)] + [np.stack((s, d), 1) for s, d in branching(tree, exponent)]
    start, period = np.unique(np.concatenate(found), axis=0).T
    begin = start - tree.backwards(start, period, bounds[owner[start]])
    length = start + 2 * period - begin
    ok = length >= np.maximum(least, exponent * period)
    begin, length, period = begin[ok], length[ok], period[ok]
    by = np.lexsort((period, length, begin))
    begin, length, period = begin[by], length[by], period[by]
    if len(begin):  # a multiple of the period gives the same stretch
        one = np.concatenate(([True], (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])))
        begin, length, period = begin[one], length[one], period[one]
        by = np.lexsort((period, begin))
        begin, length, period = begin[by], length[by], period[by]
    cuts = np.searchsorted(begin, bounds)
    return [np.stack((begin[a:b] - o, length[a:b], period[a:b]), 1) for a, b, o in zip(cuts, cuts[1:], bounds, strict=False)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def periodic(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(key, runs, collapsed) for each row of docs, by words `[^\\x20\\x09-\\x0D]+` numbered from 0.

    runs: array of (start, length, period) by start, then period. collapsed: the text without the repeats. Null, empty
    and blank texts have no runs and an empty text. Texts are read whole; one of any length is one tree in one task,
    in memory linear in its words (times the logarithm of its longest repeat). Equal rows and null keys stay as they
    are; an empty table gives an empty result; other columns play no part.
    """

    def found(_, texts):
        every, counts, rows = [], [], []
        held, weight = [], 0

        def settle():
            numbers: dict[bytes, int] = {}
            coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in held]
            for words, own in zip(held, maximal(coded, least, exponent), strict=True):
                every.append(collapsed(words, own))
                counts.append(len(own))
                rows.append(own)
            held.clear()

        for t in texts:
            words = (t or b"").split()
            if held and weight + len(words) > TOGETHER:
                settle()
                weight = 0
            held.append(words)
            weight += len(words) + 1
        settle()
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"])
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), struct), pa.array(every, pa.binary()).cast(pa.string())]

    return map_text(docs, key, text, found, "runs array<struct<start:long,length:long,period:long>>, collapsed string", binary=True)


def repeated_tail(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, where the words of every tenth text, by a hash of its key, go on periodically from some word on.

    h = crc32(decimal key), g = h div 10; if h % 10 = 0, word i >= a = g % n becomes word a + (i - a) % p with
    p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without a key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def turned(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))))

    whole = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, turned(w)).otherwise(F.col(text))), 1)
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), whole).otherwise(F.col(text)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each row of periodic(): the number of runs, the longest one, and hashes of the runs and the text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = found.withColumn("best", longest)
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
