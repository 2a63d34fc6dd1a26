"""Language identification by a bit-sliced Bloom filter of letter n-grams.

A slot of the filter is a mask with one bit for each language. An n-gram reads one slot for each hash; the AND of
the slots has the bits of all languages that contain the n-gram, and perhaps some by chance. A text's votes for a
language are the n-grams with its bit, less the number expected by chance from the share of slots that have it.
A language contains the n-grams that make up at least `rate` of its n-grams and at least `part` of the rate in the
language where they are most common; so the filter holds at most 1 / rate n-grams of a language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, map_batches, map_text, slices, stored

#: Longest n-grams; a code point takes 21 bits of a code.
GRAM = 3
#: Characters looked at in one go.
GO = 1 << 18
#: Distinct n-grams that a task holds before it hands on its partial counts.
FLUSH = 1 << 19
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

_letters: np.ndarray | None = None  #: of a Python worker


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of lower-cased words, a blank before and after each word, and the text each is of.

    Texts are joined with blanks, so no n-gram spans two; anything but letters is a blank; n-grams with a blank in
    the middle are left out.
    """
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    points = np.where(alpha[points], points, 0).astype(np.uint64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    good = b != 0
    codes = ((a[good] << np.uint64(42)) | (b[good] << np.uint64(21)) | c[good]).astype(np.uint64)
    return codes, owner[: len(b)][good]


def pieces(texts: list[str | None]):
    """(position, part) of the texts, cut at blanks, or else anywhere, into runs of about GO characters that together are whole."""
    held, size = [], 0
    for i, t in enumerate(texts):
        at, n = 0, len(t or "")
        while True:
            stop = min(n, at + GO)
            if stop < n and (cut := t.rfind(" ", at, stop)) > at:
                stop = cut
            held.append((i, (t or "")[at:stop]))
            size += stop - at
            if size >= GO:
                yield held
                held, size = [], 0
            at = stop
            if at >= n:
                break
    if held:
        yield held


@dataclass(frozen=True)
class Filter:
    """slots: (size, words) masks; fill: share of slots with each language's bit; names in the order of the bits."""

    names: list[str]
    slots: np.ndarray
    fill: np.ndarray

    def places(self, codes: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        return [((codes ^ (codes >> np.uint64(29))) * m) >> shift for m in _MIX]

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        p = self.places(codes)
        return self.slots[p[0]] & self.slots[p[1]] & self.slots[p[2]]

    def votes(self, texts: list[str | None], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) n-grams with each language's bit, and the number of n-grams of each text."""
        out, n = np.zeros((len(texts), len(self.names)), np.int64), np.zeros(len(texts), np.int64)
        for held in pieces(texts):
            codes, owner = grams([t for _, t in held], alpha)
            of = np.array([i for i, _ in held])[owner] if len(owner) else owner
            n += np.bincount(of, minlength=len(texts))
            masks = self.masks(codes)
            for k in range(len(self.names)):
                bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                out[:, k] += np.bincount(of, weights=bit, minlength=len(texts)).astype(np.int64)
        return out, n

    def decide(self, texts: list[str | None], alpha: np.ndarray) -> tuple[list[str], list[float]]:
        """Most votes after correction, ties to the first name; the score is their share of the votes of the best two."""
        found, n = self.votes(texts, alpha)
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        chance = self.fill ** len(_MIX)
        right = np.maximum(0, (found - n[:, None] * chance) / (1 - np.minimum(chance, 0.999)))
        best = right.argmax(axis=1)
        top = np.sort(right, axis=1)[:, ::-1]
        second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(texts))
        score = np.where(n > 0, (top[:, 0] + 0.5) / (top[:, 0] + second + 1), 0.0)
        return [self.names[b] if m else "und" for b, m in zip(best, n, strict=True)], score.tolist()


def build(rows: list[tuple[str, int]], names: list[str], least: int = 1 << 12) -> Filter:
    """From (language, code) of what each language contains; about 16 slots for each n-gram."""
    size = max(least, 1 << max(1, 16 * len({c for _, c in rows})).bit_length() - 1)
    slots = np.zeros((size, max(1, -(-len(names) // 64))), np.uint64)
    out = Filter(names, slots, np.zeros(len(names)))
    for k, name in enumerate(names):
        codes = np.array([c for x, c in rows if x == name], np.uint64)
        for p in out.places(codes):
            slots[p, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        out.fill[k] = ((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
    return out


def _counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Partial counts (lang, code, n) of the n-grams of all rows."""
    schema = T._parse_datatype_string("lang string, code long, n long")
    arrow = _arrow_schema(schema)

    def run(batches):
        alpha = letters()
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for part in slices(batch):
                by: dict[str, list] = {}
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(k, []).append(t)
                for k, texts in by.items():
                    for some in pieces(texts):
                        codes, n = np.unique(grams([t for _, t in some], alpha)[0], return_counts=True)
                        held.setdefault(k, []).append((codes, n))
                        size += len(codes)
                        if size > FLUSH:
                            held = {x: [merged(v)] for x, v in held.items()}
                            size = sum(len(v[0][0]) for v in held.values())
                            if size > FLUSH // 2:
                                yield from out(held)
                                held, size = {}, 0
        yield from out(held)

    def merged(parts):
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)

    def out(held):
        for k, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], schema=arrow)

    return map_batches(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), run, schema)


#: Languages that a filter can hold; more are an error, never dropped.
MOST = 4096


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", *, rate: float = 1e-4, part: float = 0.2) -> Filter:
    """A filter from all rows of docs that have a language."""
    counts = stored(_counts(docs.where(F.col(lang).isNotNull()), text, lang).groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r["lang"] for r in total.select("lang").limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    share = counts.join(F.broadcast(total), "lang").select("lang", "code", "n", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= rate)
    top = share.groupBy("code").agg(F.max("share").alias("top"))
    own = share.join(top, "code").where(F.col("share") >= part * F.col("top"))
    # the shares of a language sum to 1, so at most 1 / rate of its n-grams reach the driver, whatever the corpus
    rows = [(r["lang"], r["code"]) for r in own.select("lang", "code").collect()]
    return build(rows, names)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """(key, held_out, lang_pred, score) for each row of docs, by a filter learned from its rows that aren't held out.

    A null text, or one without letters, is `und` with score 0, as is any text where no language could be learned.
    A null key is not held out. Rows with a null language are not learned from. Repeated rows stay, long texts are read
    whole, an empty table gives an empty result; other columns play no part.
    """
    train = docs.where(~F.coalesce(held_out(key), F.lit(False))).select(text, lang)
    model = learn(train, text, lang, **how)

    def made(_, texts):
        global _letters
        if _letters is None:
            _letters = letters()
        return list(model.decide(texts, _letters))

    out = map_text(docs, key, text, made, "lang_pred string, score double")
    return out.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "lang_pred", "score")
