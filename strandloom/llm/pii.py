"""Personal data: fixed patterns, and terms whose co-occurrence in the corpus discloses a protected entity.

Emails, IP addresses, payment cards and phone numbers are found by pattern. Each value found is a protected entity, and
so is what it belongs to: the email's domain, the network of the address, the card's issuer, the phone number's block.
A word among the `window` words before or after an entity is a candidate. With n(t) the documents that hold term t and
n(t,e) those that hold t inside a window of entity e, the term leaves -log2 p(e|t) bits of the entity open, of the
log2 (M + 1) / n(e) bits that it has without the term, M being the documents that hold any entity and n(e) those with e. p(e|t) = n(t,e) / n(t) is an estimate from few documents, so its lower
confidence bound (Wilson's, one deviation) stands for it. Copies of a passage are one observation: the bound is that of
n(t) c / n(t,e) documents, where c of the n(t,e) are unlike texts with unlike windows. So one text leaves a bit open at
least, and a term that stands elsewhere, or a second text without the entity, leaves more. At `generalise` bits or fewer
all places of the term in documents that hold e are spans and are replaced by a class; at `remove` bits or fewer, which
takes two texts, they are taken out; never if the term leaves as much open as there was. Whether a pair is marked
depends on the documents that hold its term or an entity, not on the size of the corpus. Counts cover all documents.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, free_name, join_checked, map_batches, slices, small, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Words counted in a task before they are handed on as partial counts.
FLUSH = 200_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches, found from the at-sign: the local part is the run of its characters before it."""
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of the pattern kinds, by start, then kind; null: none."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 10 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def groups(kind: int, value: str) -> tuple[str, ...]:
    """A value and what it belongs to: domain, network, issuer, block of numbers."""
    whole = (value.rpartition("@")[2], value.rpartition(".")[0], value[:6], value[:-4])[kind]
    return f"{kind}:{value}", f"{kind}:in:{whole}"


def free_words(text: str, spans) -> list[re.Match]:
    """The words of a text that no span touches; spans are sorted by start."""
    out, at, end = [], 0, -1
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][2])
            at += 1
        if end <= m.start():
            out.append(m)
    return out


def windows(text: str, spans, window: int) -> list[tuple[int, int, str]]:
    """(entity, context, term) for each word near each span; entity and context are hashes, no values."""
    words = free_words(text, spans)
    starts = [m.start() for m in words]
    out = []
    for a, kind, b, value in spans:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        near = [m[0].lower() for m in (*words[max(0, i - window) : i], *words[j : j + window])]
        context = _signed(" ".join(near))
        out += [(_signed(e), context, w) for e in groups(kind, value) for w in near]
    return out


def _signed(text: str) -> int:
    """The hash that Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _scan(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """One row for each document, and rows (word, df) with the documents of a task that hold each word."""
    kind = docs.schema[key].dataType
    near = "array<struct<entity:long,context:long,term:string>>"
    schema = T.StructType([T.StructField("key", kind)] + list(T._parse_datatype_string(f"same long, base array<struct<start:int,kind:int,stop:int>>, counts array<long>, digest string, near {near}, word string, df long").fields))
    arrow = _arrow_schema(schema)
    names = arrow.names

    def rows(found: list[dict]):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], arrow.field(n).type) for n in names], schema=arrow)

    def run(batches):
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                out = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    spans = base_spans(t)
                    words.update(set(_WORD.findall(t.lower())) if t else ())
                    out.append({"key": k, "same": _signed(t or ""), "base": [{"start": a, "kind": i, "stop": b} for a, i, b, _ in spans], "counts": [sum(s[1] == i for s in spans) for i in range(4)], "digest": hashlib.sha256(listed(spans).encode()).hexdigest(), "near": [dict(zip(("entity", "context", "term"), w, strict=True)) for w in windows(t, spans, window)] if spans else []})
                yield rows(out)
                if len(words) > FLUSH:
                    yield counted(words)
                    words = Counter()
        if words:
            yield counted(words)

    def counted(words: Counter):
        w = pa.array(list(words), pa.string())
        n = len(w)
        of = {"word": w, "df": pa.array(list(words.values()), pa.int64())}
        return pa.RecordBatch.from_arrays([of[f.name].cast(f.type) if f.name in of else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)


def term_spans(text: str, base, terms: dict[str, float]) -> list[tuple[int, int, int, float]]:
    """(start, place in KINDS, end, bits left open) of each word of the text that is among terms and outside the base spans."""
    found = ((m, terms.get(m[0].lower())) for m in free_words(text, base))
    return [(m.start(), 4, m.end(), left) for m, left in found if left is not None]


def bits_left(n_te: Column, n_t: Column, unlike: Column) -> Column:
    """-log2 of Wilson's lower bound, one deviation wide, of the share n_te of n_t, if only `unlike` of the n_te are observations."""
    p, n = F.least(n_te / n_t, F.lit(1.0)), n_t * unlike / n_te
    low = (p + 0.5 / n - F.sqrt(p * (1 - p) / n + 0.25 / (n * n))) / (1 + 1 / n)
    return -F.log2(low)


def disclosed(rows: DataFrame, words: DataFrame, support: int, generalise: float) -> tuple[DataFrame, DataFrame]:
    """(entity, term, n_e, n_t, n_te, left) of disclosing pairs, stored; and the stored (key, same, entity, context, term) they are made of.

    rows: (key, same, near) for each document; words: (word, df), partial counts of the documents that hold a word.
    """
    near = rows.where("size(near) > 0").select("key", "same", F.explode("near").alias("w")).select("key", "same", "w.*")
    near = stored(near, "near")
    holders = near.select("key", "same").distinct().count()
    # documents, not places: a document counts once for a pair, an entity or a term
    documents = F.count_distinct(F.struct("key", "same"))
    unlike = F.least(F.count_distinct("context"), F.count_distinct("same"))
    pairs = near.groupBy("entity", "term").agg(unlike.alias("unlike"), documents.alias("n_te")).where(F.col("unlike") >= support)
    pairs = stored(pairs, "pairs")
    terms = stored(pairs.select(F.col("term").alias("word")).distinct(), "terms")
    # a word's partial counts, one of each task that met it, are summed before they meet the terms
    whole = words.groupBy("word").agg(F.sum("df").alias("n_t"))
    freq = stored(join_checked(whole, terms, "word").select(F.col("word").alias("term"), "n_t"), "freq")
    left = bits_left(F.col("n_te"), F.col("n_t"), F.col("unlike"))
    close = stored(join_checked(pairs, freq, "term").withColumn("left", left).where(F.col("left") <= generalise), "close")
    some = stored(close.select("entity").distinct(), "entities")
    entity = stored(join_checked(near.select("entity", "key", "same"), some, "entity").groupBy("entity").agg(documents.alias("n_e")), "n_e")
    flagged = join_checked(close, entity, "entity").where(F.col("left") < F.log2(F.lit(holders + 1.0) / F.col("n_e")) + 1e-12)
    return stored(flagged.select("entity", "term", "n_e", "n_t", "n_te", "left"), "flagged"), near


def _found(docs: DataFrame, key: str, text: str, window: int, support: int, generalise: float):
    """The documents' rows, and (key, same, marks), stored: the disclosing terms of each text of a key."""
    scanned = stored(_scan(docs, key, text, window), "scan")
    rows = scanned.where("digest is not null")
    flagged, near = disclosed(rows, scanned.where("word is not null").select("word", "df"), support, generalise)
    holds = near.select("key", "same", "entity").distinct()
    terms = join_checked(holds, flagged.select("entity", "term", "left"), "entity").groupBy("key", "same", "term").agg(F.min("left").alias("left"))
    return rows, stored(terms.groupBy("key", "same").agg(F.collect_list(F.struct("term", "left")).alias("marks")), "marks")


def _marked(docs: DataFrame, key: str, text: str, marks: DataFrame, how: str) -> DataFrame:
    """docs with the marks of their key and text, null keys too, in a last column."""
    name, own, same = (free_name(docs.columns, x) for x in ("marks", "marked", "same"))
    marks = marks.select(F.col("key").alias(own), F.col("same").alias(same), F.col("marks").alias(name))
    met = docs[key].eqNullSafe(marks[own]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == marks[same])
    return docs.join(F.broadcast(marks) if small(marks) else marks, met, how).select(*[docs[c] for c in docs.columns], name)


def _terms(marks: list[dict] | None) -> dict[str, float]:
    return {t["term"]: t["left"] for t in marks or ()}


def _places(docs: DataFrame, key: str, text: str, marks: DataFrame) -> DataFrame:
    """(key, same, extra: array of (start, kind, stop)) of the documents in which terms are marked, each text of a key once."""
    joined = _marked(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", marks, "inner")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)] + list(T._parse_datatype_string("same long, extra array<struct<start:int,kind:int,stop:int>>").fields))
    arrow = _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = []
                for k, t, m in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    spans = term_spans(t or "", base_spans(t), _terms(m))
                    made.append((k, _signed(t or ""), [{"start": a, "kind": i, "stop": b} for a, i, b, _ in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return map_batches(joined, run, schema).where("size(extra) > 0").groupBy("key", "same").agg(F.first("extra").alias("extra"))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 6, support: int = 1, generalise: float = 2.0) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for each row of docs.

    A null text counts as empty: no spans. Equal rows get equal spans; a repeated key is no matter, spans go by key
    and text. An empty table gives an empty result; other columns play no part. An entity of all documents that
    hold any carries no information and is disclosed by nothing. Texts are read whole, however long.
    """
    rows, marks = _found(docs, key, text, window, support, generalise)
    # null keys meet too
    by = stored(_places(docs, key, text, marks), "places").select(F.col("key").alias("k"), F.col("same").alias("s"), "extra")
    kept = rows.select("key", "same", "base", "counts", "digest")
    joined = kept.join(F.broadcast(by) if small(by) else by, kept["key"].eqNullSafe(by["k"]) & (kept["same"] == by["s"]), "left")
    term = F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    spans = F.sort_array(F.concat("base", term))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    as_text = F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))))
    counts = [F.get("counts", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return joined.select(F.col("key").alias(key), *counts, F.col("digest").alias("base_sha256"), as_text.alias("spans"), F.size(term).cast("long").alias("n_term"))


def redact(text: str, spans, remove: float) -> str:
    """text with each span replaced by its class, or taken out; of overlapping spans the joint stretch goes by its first kind."""
    out, at = [], 0
    for a, kind, b, left in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append("" if kind == 4 and left <= remove else f"[{KINDS[kind]}]")
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 6, support: int = 1, generalise: float = 2.0, remove: float = 0.6) -> DataFrame:
    """docs with the spans of detect() replaced in the text column; a null text stays null, other columns stay.

    A column n_chars of docs is set to the new length. Texts are read whole, however long. Rows with a null key or the
    key of another row are treated by their own texts, repeated rows stay, an empty table stays empty.
    """
    _, marks = _found(docs, key, text, window, support, generalise)
    schema = docs.schema
    arrow = _arrow_schema(schema)
    place = docs.columns.index(text)
    joined = _marked(docs, key, text, marks, "left")

    def run(batches):
        for batch in batches:
            for part in slices(batch, place):
                texts = part.column(place).to_pylist()
                more = part.column(len(arrow)).to_pylist()
                new = []
                for t, m in zip(texts, more, strict=True):
                    if t is not None:
                        spans = [(a, k, b, 0.0) for a, k, b, _ in base_spans(t)]
                        spans += term_spans(t, spans, _terms(m)) if m else []
                        t = redact(t, spans, remove) if spans else t
                    new.append(t)
                cols = [part.column(i) for i in range(len(arrow))]
                cols[place] = pa.array(new, arrow.field(place).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    out = map_batches(joined, run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(schema["n_chars"].dataType))
    return out
