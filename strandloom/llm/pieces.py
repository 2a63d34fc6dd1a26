"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is a leading blank, then its characters, blanks written as the word mark. Symbols start as characters; an
agenda holds the neighbouring pairs whose joint string is a piece and gives the best score first, then the leftmost.
A candidate taken from it is skipped where the keyed hash of (seed, epoch, text, the chunk's place in the text, place in
the chunk, piece) falls below the dropout rate; so each occurrence of a word in any text is cut by chance of its own, and
the segmentation depends on the seed and the text, not on the order of rows or on a task. Characters that are
no piece, and the word mark itself where a text holds it, become byte pieces, so that decoding gives back each text.

Pieces hold the word mark at their start only and some characters stand in no longer piece; texts are cut there
into chunks, which no merge crosses. The decisions are drawn anew for each occurrence. What is remembered of a chunk is
which candidates are taken if none is skipped, and the ids that this gives; an occurrence that skips one of these is
merged from its characters, all such occurrences together, a candidate of each in a round.
"""

from __future__ import annotations

import heapq
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

MARK = "▁"
#: Fixed values of the model format: the types of pieces.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Chunks that a Python worker gathers before it forgets them; characters of chunks that are merged together.
REMEMBER, WIDTHS = 200_000, (4, 8, 12, 16, 24, 32)
LONGEST = WIDTHS[-1]
#: The order of what is no candidate.
NEVER = np.iinfo(np.int32).max
_M = (1 << 64) - 1
_PLACE, _PIECE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Characters of a long text that are cut into chunks at once.
PART = 1 << 20
#: Characters of short texts that are merged at once, about; a worker holds some hundred bytes for each.
TOGETHER = 1 << 18
_CUT = re.compile("(?<! ) ")


def mixed(z: np.ndarray) -> np.ndarray:
    """The hash of a candidate, from its key and its place and piece."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX)
    return z ^ (z >> np.uint64(31))


class Ragged:
    """Lists of numbers one after another, with room to grow."""

    def __init__(self, kind: type):
        self.data, self.start = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64)
        self.n = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        end = self.start[self.n]
        while end + len(flat) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        while self.n + len(sizes) + 1 > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.data[end : end + len(flat)] = flat
        self.start[self.n + 1 : self.n + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the lists `which` in one array, and the lists' sizes."""
        start = self.start[which]
        sizes = self.start[which + 1] - start
        return self.data[spread(start, sizes)], sizes


def spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(start - before, sizes) + np.arange(int(sizes.sum()))


class Symbols(dict):
    """Characters that are pieces; -1 for others."""

    def __missing__(self, _) -> int:
        return -1


def below(hashes: np.ndarray, drop: int) -> np.ndarray:
    """Whether the hashes are below drop, which may be 2^64."""
    return hashes <= np.uint64(drop - 1) if drop else np.zeros(len(hashes), bool)


class Vocabulary:
    """Pieces of a BPE model with byte fallback; small enough to go to every worker, where it remembers chunks."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.best = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.bytes = [0] * 256
        self.raw = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
                self.raw.append(bytes([int(p[1:-1], 16)]))
            else:
                self.raw.append(b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode())
        joined = {c for p in self.best if len(p) > 1 for c in p} - {MARK}
        if any(MARK in p.lstrip(MARK) for p in self.best):
            raise ValueError("pieces with the word mark after another character can't be cut into chunks")
        inner = "".join(re.escape(c) for c in sorted(joined)) or MARK
        self.chunk = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|.", re.S)
        # two neighbours join if their joint string is a piece; a symbol is a piece, or `none` where there is no more
        self.none = len(pieces)
        best = self.best
        pairs = {}
        for p, (_, i) in best.items():
            for cut in range(1, len(p)):
                if (left := best.get(p[:cut])) and (right := best.get(p[cut:])):
                    pairs[left[1] * (self.none + 1) + right[1]] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joint = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        costs = np.array([best[p][0] if p in best else np.inf for p, _, _ in pieces] + [np.inf])
        self.symbol = Symbols({p: i for p, (_, i) in best.items() if len(p) == 1})
        self.order = np.where(np.isfinite(costs), np.unique(costs, return_inverse=True)[1], NEVER).astype(np.int32)
        self._forget()

    def _forget(self) -> None:
        """No chunk is remembered: its characters, what is tried without dropout, and the ids that gives."""
        self.number: dict[str | None, int] = {}
        self.chars, self.tried, self.ids = Ragged(np.int32), Ragged(np.uint64), Ragged(np.int32)

    def _joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or none."""
        if not len(self.pairs):
            return np.full(len(left), self.none, np.int32)
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joint[at], np.int32(self.none))

    def _learn(self, chunks: list[str | None]) -> None:
        """Remember new chunks; None is a word mark of a text. Long chunks and odd ones have no ids, they are merged one by one."""
        apart = [c for c in chunks if c is None or not 1 < len(c) <= LONGEST]
        rest = [c for c in chunks if c is not None and 1 < len(c) <= LONGEST]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        flat = np.fromiter(map(self.symbol.__getitem__, "".join(rest)), np.int32, int(sizes.sum()))
        if rest:
            odd = np.minimum.reduceat(flat, np.cumsum(sizes) - sizes) < 0
            apart += [rest[i] for i in np.flatnonzero(odd).tolist()]
            group = np.where(odd, -1, np.searchsorted(WIDTHS, sizes))
        for c in apart:
            ids = self._id(c or MARK, c is None) if c is None or len(c) == 1 else b""
            self.number[c] = len(self.number)
            self.ids.add(np.frombuffer(ids, np.int32), np.array([len(ids) // 4]))
            self.tried.add(np.zeros(0, np.uint64), np.array([0]))
            self.chars.add(np.zeros(0, np.int32), np.array([0]))
        for g, width in enumerate(WIDTHS):
            own = np.flatnonzero(group == g) if rest else np.zeros(0, np.int64)
            if not len(own):
                continue
            n = sizes[own]
            chars = flat[spread((np.cumsum(sizes) - sizes)[own], n)]
            tried: list = []
            ids, kept = self.merged(chars, n, width, np.zeros(len(own), np.uint64), 0, tried)
            at = len(self.number)
            self.number.update(zip([rest[i] for i in own.tolist()], range(at, at + len(own)), strict=True))
            self.chars.add(chars, n)
            self.ids.add(ids, kept)
            row, trial = (np.concatenate(x) for x in zip(*tried, strict=True)) if tried else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            self.tried.add(trial[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(own)))

    def merged(self, chars: np.ndarray, sizes: np.ndarray, width: int, keys: np.ndarray, drop: int, tried: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of chunks of width characters at most, all at once: a round takes each chunk's best candidate.

        chars: the chunks' symbols, one after another. tried: a list that is given (row, hash part) of each candidate taken.
        """
        n, w = len(sizes), width + 1
        row = np.arange(n) * w
        symbol = np.full(n * w, self.none, np.int32)
        symbol[spread(row, sizes)] = chars
        piece = np.full(n * w, self.none, np.int32)
        piece[:-1] = self._joint(symbol[:-1], symbol[1:])
        order = self.order[piece]
        place = np.arange(n * w) % w
        after, before = np.minimum(place + 1, width), place - 1
        on = np.arange(n)
        with np.errstate(over="ignore"):
            while len(on):
                base = row[on]
                at = order.reshape(n, w)[on].argmin(axis=1)
                cell = base + at
                go = order[cell] < NEVER
                on, at, cell, base = on[go], at[go], cell[go], base[go]
                found = piece[cell]
                trial = at.astype(np.uint64) * np.uint64(_PLACE) + found.astype(np.uint64) * np.uint64(_PIECE)
                if tried is not None:
                    tried.append((on, trial))
                skipped = below(mixed(keys[on] + trial), drop)
                order[cell[skipped]] = NEVER
                keep = ~skipped
                at, cell, base, found = at[keep], cell[keep], base[keep], found[keep]
                gone = base + after[cell]
                then = after[gone]
                symbol[cell], symbol[gone], order[gone] = found, self.none, NEVER
                after[cell], before[base + then] = then, at
                piece[cell] = joint = self._joint(found, symbol[base + then])
                order[cell] = self.order[joint]
                left = before[cell]
                some = left >= 0
                cell = base[some] + left[some]
                piece[cell] = joint = self._joint(symbol[cell], found[some])
                order[cell] = self.order[joint]
        left = symbol.reshape(n, w) != self.none
        return symbol[left.ravel()], left.sum(axis=1)

    def merge_all(self, chunks: list[str], keys: list[int], drop: int) -> list[bytes]:
        """merge() of many chunks at once."""
        ids, sizes = self._encoded(chunks, np.array(keys, np.uint64), drop)
        ends = np.cumsum(sizes)
        return [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def _encoded(self, chunks: list[str | None], keys: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of chunks, each by its own key; None is a word mark of the text."""
        if new := set(chunks).difference(self.number):
            self._learn(list(new))
        number = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        ids, sizes = self.ids.take(number)
        apart = np.flatnonzero(sizes == 0).tolist()
        tried, n = self.tried.take(number)
        with np.errstate(over="ignore"):
            hit = below(mixed(np.repeat(keys, n) + tried), drop)
        anew = np.unique(np.repeat(np.arange(len(chunks)), n)[hit])
        length = self.chars.start[number[anew] + 1] - self.chars.start[number[anew]]
        made = []
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            own = anew[(length > low) & (length <= width)]
            if len(own):
                made.append((own, *self.merged(*self.chars.take(number[own]), width, keys[own], drop)))
        long = [np.frombuffer(self.merge(chunks[i], int(keys[i]), drop), np.int32) for i in apart]
        if long:
            made.append((np.array(apart), np.concatenate(long), np.array([len(x) for x in long])))
        if not made:
            return ids, sizes
        own, got, n = (np.concatenate(x) for x in zip(*made, strict=True))
        kept = np.ones(len(chunks), bool)
        kept[own] = False
        ids, sizes = ids[np.repeat(kept, sizes)], np.where(kept, sizes, 0)
        sizes[own] = n
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        out[spread(start[kept], sizes[kept])] = ids
        out[spread(start[own], n)] = got
        return out, sizes

    def encode_all(self, texts: list[str | None], keys: list[int], drop: int) -> list[np.ndarray | None]:
        """Ids of whole texts, each by its own key; long ones in parts that are cut before blanks, where chunks begin."""
        short = [None if t is None or len(t) > PART else t for t in texts]
        group = (np.cumsum([len(t or "") for t in short]) // TOGETHER).tolist()
        out: list[np.ndarray | None] = []
        for _, own in itertools.groupby(range(len(texts)), group.__getitem__):
            own = list(own)
            out += [None if x is None else x[0] for x in self.encode_parts([short[i] for i in own], [keys[i] for i in own], drop, True)]
        for i, t in enumerate(texts):
            if t is not None and len(t) > PART:
                cuts, at = [0], PART
                while (m := _CUT.search(t, at)) is not None:
                    cuts.append(m.start())
                    at = m.start() + PART
                parts, place = [], 0
                for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True):
                    ids, n = self.encode_parts([t[a:b]], [keys[i]], drop, a == 0, place)[0]
                    parts.append(ids)
                    place += n
                out[i] = np.concatenate(parts)
        return out

    def encode_parts(self, texts: list[str | None], keys: list[int], drop: int, first: bool, place: int = 0) -> list[tuple[np.ndarray, int] | None]:
        """Ids and number of chunks of texts of bounded length; a chunk's key is of its text's key and its place, counted from `place`."""
        if len(self.number) > REMEMBER:
            self._forget()
        cut = [None if t is None else self.chunks(t, first) for t in texts]
        counts = [len(own or ()) for own in cut]
        every = [c for own in cut for c in own or ()]
        if not every:
            return [None if own is None else (np.zeros(0, np.int32), 0) for own in cut]
        begin = np.cumsum([0, *counts])
        with np.errstate(over="ignore"):
            at = (np.arange(len(every)) - np.repeat(begin[:-1], counts) + place + 1).astype(np.uint64)
            own = np.repeat(np.array(keys, np.uint64), counts) + at * np.uint64(0xD1B54A32D192ED03)
            own = (own ^ (own >> np.uint64(32))) * np.uint64(0xAEF17502108EF2D9)
            own ^= own >> np.uint64(29)
        ids, sizes = self._encoded(every, own, drop)
        ends = np.concatenate(([0], np.cumsum(sizes)))[begin].tolist()
        return [None if c is None else (ids[ends[i] : ends[i + 1]], counts[i]) for i, c in enumerate(cut)]

    def merge(self, chunk: str, key: int, drop: int) -> bytes:
        """Ids (int32, little-endian) of one chunk; candidates whose hash is below drop are skipped."""

        def keep(i: int, piece: int) -> bool:
            z = (key + i * _PLACE + piece * _PIECE) & _M
            z = ((z ^ (z >> 30)) * _MIX) & _M
            return z ^ (z >> 31) >= drop

        best = self.best
        n = len(chunk)
        if n == 1:
            return self._id(chunk)
        symbol, after, before = list(chunk), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def offer(i: int, j: int) -> None:
            joint = symbol[i] + symbol[j]
            if found := best.get(joint):
                agenda.append((found[0], i, found[1], len(joint))) if starting else heapq.heappush(agenda, (found[0], i, found[1], len(joint)))

        starting = True
        for i in range(n - 1):
            offer(i, i + 1)
        starting = False
        heapq.heapify(agenda)
        while agenda:
            _, i, piece, size = heapq.heappop(agenda)
            j = after[i]
            if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != size:
                continue  # one of the two has gone into another symbol
            if not keep(i, piece):
                continue
            symbol[i] += symbol[j]
            symbol[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return b"".join([self._id(s) for s in symbol if s])

    def _id(self, symbol: str, as_bytes: bool = False) -> bytes:
        if (found := self.best.get(symbol)) is not None and not as_bytes:
            return found[1].to_bytes(4, "little")
        return array("i", [self.bytes[b] for b in symbol.encode()]).tobytes()

    def chunks(self, text: str, first: bool = True) -> list[str | None]:
        """The text in chunks; None for a word mark that the text holds. An empty text has none. first: it has the leading blank."""
        if not text:
            return []
        lead = MARK if first else ""
        if MARK not in text:
            return self.chunk.findall(lead + text.replace(" ", MARK))
        out: list[str | None] = []
        for at, part in enumerate(text.split(MARK)):
            out += [None] if at else []
            out += self.chunk.findall(("" if at else lead) + part.replace(" ", MARK))
        return out

    def encode(self, text: str, key: int, drop: int) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text], [key], drop)[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the leading blank."""
        raw = self.raw
        parts = [b"".join([raw[i] for i in ids[at : at + PART].tolist()]) for at in range(0, len(ids), PART)]
        return b"".join(parts)[1:].decode()


def load(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each piece of a model file, in the order of ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: BYTE if sp.is_byte(i) else UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else NORMAL
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def _sent(df: DataFrame, path: str):
    """The pieces for the workers: as many as the model file has, whatever the data; a worker builds its vocabulary once."""
    return df.sparkSession.sparkContext.broadcast({"pieces": load(path)})


def _held(sent) -> Vocabulary:
    value = sent.value
    if "vocabulary" not in value:
        value["vocabulary"] = Vocabulary(value.pop("pieces"))
    return value["vocabulary"]


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
    flat = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
    mask = pa.array([r is None for r in rows]) if any(r is None for r in rows) else None
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat), mask=mask)


def _keys(texts: list[str | None], seed: int, epoch: int) -> list[int]:
    """A text's key is the hash of the text: equal texts have equal keys."""
    own = xxhash.xxh64_intdigest(f"{seed}:{epoch}")
    return [xxhash.xxh64_intdigest((t or "").encode(), own) for t in texts]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", *, dropout: float = 0.1, seed: int = 7, epoch: int = 0) -> DataFrame:
    """(key, ids array<int>) for each row of docs: the whole text's pieces; a null text has null ids, an empty one no ids.

    dropout 0 skips no merge, 1 all of them. Equal rows and null keys stay; an empty table gives an empty result.
    """
    sent = _sent(docs, model)
    drop = int(dropout * 2.0**64)

    def made(_, texts):
        return [_lists(_held(sent).encode_all(texts, _keys(texts, seed, epoch), drop))]

    return map_text(docs, key, text, made, "ids array<int>")


def decode(tokens: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) for each row of tokens (ids array<int>); null ids give a null text, no ids an empty one.

    Equal rows and null keys stay; an empty table gives an empty result; other columns play no part.
    """
    sent = _sent(tokens, model)
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches):
        vocabulary = _held(sent)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [None if not x.is_valid else vocabulary.decode(x.values.to_numpy()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def encode_checked(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", *, dropout: float = 0.1, seed: int = 7, epoch: int = 0) -> DataFrame:
    """(key, n_tokens, lossless, ids): encode() with each row decoded again; lossless says that the text came back.

    A null text has null ids, no tokens and counts as lossless, an empty one has no ids; long texts are encoded whole.
    Equal texts have equal ids in an epoch; repeated rows and null keys stay. An empty table gives an empty result; other
    columns play no part.
    """
    sent = _sent(docs, model)
    drop = int(dropout * 2.0**64)

    def made(_, texts):
        vocabulary = _held(sent)
        rows = vocabulary.encode_all(texts, _keys(texts, seed, epoch), drop)
        right = [r is None or vocabulary.decode(r) == t for r, t in zip(rows, texts, strict=True)]
        return [[0 if r is None else len(r) for r in rows], right, _lists(rows)]

    return map_text(docs, key, text, made, "n_tokens long, lossless boolean, ids array<int>").select(key, F.col("n_tokens"), "lossless", "ids")
