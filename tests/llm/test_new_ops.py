"""Runs of words, MinHash near-duplicates, conversations: against plain versions, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import dialogue, oddsketch, runs
from strandloom.llm.common import table
from strandloom.llm.queries import QUERIES

from .test_text_ops import LONG, empty, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- runs


def plain_runs(words, least=6, exponent=4):
    found, seen = [], set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = (i, j - i + q)
            if stretch[1] >= max(least, exponent * q) and j > i and stretch not in seen:  # a smaller period came first
                seen.add(stretch)
                found.append((*stretch, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_tail(key, words):
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_digest(key, text):
    words = plain_tail(key, WORD.findall(text or ""))
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = best[1] * 1000 // best[2] if found else None
    return (key, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 50))]
            if rng.random() < 0.5 and len(w) > 4:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(2, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        got = runs.maximal([np.array(w, np.int64) for w in texts])
        assert [[tuple(r) for r in x.tolist()] for x in got] == [plain_runs(w) for w in texts]


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3), (20, 5)])
def test_runs_of_known_words(least, exponent):
    fib = ["a", "ab"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    for w in [fib[-1], "a" * 99, "ab" * 40 + "b" * 9 + "ab" * 30, "abcabcabcabc" * 5 + "abd" * 7, "xyz", ""]:
        got = runs.maximal([np.array([ord(c) for c in w], np.int64)], least, exponent)[0]
        assert [tuple(r) for r in got.tolist()] == plain_runs(w, least, exponent)


def test_long_run():
    assert runs.maximal([np.arange(300_000) % 1000])[0].tolist() == [[0, 300_000, 1000]]


def test_runs_of_documents(spark, sf_dir):
    text = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_runs"](spark, sf_dir).collect()}
    assert len(got) == len(text)
    short = [k for k, t in text.items() if len(t or "") < 12_000]
    assert len(short) > 0.9 * len(text)
    assert [got[k] for k in short] == [plain_digest(k, text[k]) for k in short]


def test_runs_on_odd_rows(spark):
    rows = odd_docs(spark).withColumn("runs", F.lit("own")).withColumn("collapsed", F.lit(1))
    got = runs.digest(runs.periodic(runs.repeated_tail(rows))).collect()
    want = [plain_digest(r["doc_id"], r["text"]) for r in rows.collect() if r["text"] != LONG]
    assert sorted(map(repr, (tuple(r) for r in got if r["doc_id"] != 4))) == sorted(map(repr, want))
    (long,) = [r for r in got if r["doc_id"] == 4]
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 60_000, 1)
    assert long["collapsed_sha256"] == sha("wort")
    assert runs.digest(runs.periodic(runs.repeated_tail(empty(spark)))).collect() == []


def test_collapsed_text(spark):
    rows = spark.createDataFrame([(1, "so a b a b a b a b end  end")], "doc_id long, text string")
    (got,) = runs.periodic(rows).collect()
    assert [tuple(r) for r in got["runs"]] == [(1, 8, 2)]
    assert got["collapsed"] == "so a b end end"


# --- near-duplicates by MinHash


def shingle_set(text, words=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def plain_near(rows, least=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= least * (len(sets[i]) + len(sets[j]) - shared):
            root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [k for k in groups[find(i)] if k is not None]
        top = key if not sets[i] else min(keys, default=None)
        out.append((key, len(sets[i]), top, key is not None and key == top))
    return out


def test_near_duplicates_of_documents(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_minhash"](spark, sf_dir).collect())
    assert got == sorted(plain_near(rows))
    assert any(not r[3] for r in got)


def test_near_duplicates_of_families(spark):
    """Chains of edits, families below the similarity, and many copies: nothing is capped."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        for _ in range(40):  # each step one word further: links are chains
            base = base.copy()
            base[rng.randrange(len(base))] = word()
            rows.append(" ".join(base))
    shared = [word() for _ in range(100)]
    rows += [" ".join(shared + [word() for _ in range(45)]) for _ in range(60)]  # about half alike, no links
    rows += [" ".join(shared[:7])] * 5 + [" ".join(shared[:8]), "one two", "One  TWO", "", None, " \t"]
    rows = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_near(rows))


def test_packs_and_blocks(spark, monkeypatch):
    """The same links when each pack holds few pairs."""
    from strandloom.llm import copies

    monkeypatch.setattr(copies, "PACK", 2000)
    test_near_duplicates_of_families(spark)


def test_near_duplicates_on_odd_rows(spark):
    rows = odd_docs(spark).select("*", F.lit(1).alias("id"), F.lit(2).alias("n"), F.lit(3).alias("bands"), F.lit(4).alias("kept"))
    got = oddsketch.near_duplicates(rows).collect()
    want = plain_near([(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()])
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert oddsketch.near_duplicates(empty(spark)).collect() == []


def test_odd_sketch_estimates():
    rng = np.random.default_rng(4)
    for j in (0.85, 0.9, 0.97):
        far, shares = [], []
        for _ in range(150):
            n, own = 2000, int(2000 * (1 - j) / (1 + j))
            h = rng.integers(0, 1 << 63, n + own).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            (ba, a), (bb, b) = oddsketch.sketch(h[:n]), oddsketch.sketch(h[own:])
            far.append(int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum()))
            shares.append((ba == bb).any())
        assert abs(np.mean(oddsketch.estimate(np.array(far))) - j) < 0.01
        assert max(far) <= oddsketch.allowed_bits(0.85)
        assert all(shares)
    assert oddsketch.estimate(oddsketch.allowed_bits(0.85)) > 0.6


# --- conversations


def plain_edits(codes):
    """All edit sequences by exhaustion: (cost, audit, [(role or None for its own, row)])."""
    best = None
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(i, last, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and last in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if inserts < 2:
            role = "a" if last == "u" else "u"
            go(i, role, cost + 5, audit + "I", [*out, (role, None)], inserts + 1)
        if i < len(codes):
            initial, gone, late = codes[i]
            if not gone:
                if initial and initial in fits[last]:
                    go(i + 1, initial, cost + 5 * late, audit + "K", [*out, (None, i)], 0)
                role = "a" if last == "u" else "u"
                go(i + 1, role, cost + 1 + 5 * late, audit + "R", [*out, (role, i)], 0)
            go(i + 1, last, cost + 2, audit + "D", out, 0)

    go(0, "", 0, "", [], 0)
    return best


def plain_order(turn, role, text):
    return (turn is not None, turn or 0, role, sha(f"{len(role)}:{role}{text}"))


def plain_report(rows, damage=True):
    """rows: (conv, turn, role, text)."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 9
        role, text = name(role), name(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: plain_order(*r))
        seen, codes, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        for _, role, text in own:
            visible = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            n["blank"] += fault == "blank"
            n["duplicate"] += fault == "duplicate"
            n["truncated"] += fault == "truncated"
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = plain_edits(codes)
        roles = {"u": "user", "a": "assistant"}
        repaired = "\n".join(f"{own[i][1] if role is None else roles[role]}:{'' if i is None else own[i][2]}" for role, i in lines)
        out[conv] = (gaps, *n.values(), cost, audit, sha(repaired))
    return out


def report_of(got, conv="conv_id"):
    return {r[conv]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


def test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversations"](spark, sf_dir).collect()
    assert report_of(got) == plain_report(rows)
    assert len(got) == len({r[0] for r in rows})


SPEECH = "conv_id long, turn long, role string, text string"


def random_talk(seed, n=400, longest=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for _ in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No", "  ", "", None, "What?\n", "Go on. ", "é!", f"{rng.randrange(9)}."])
            rows.append((conv if conv else None, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text))
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_random_conversations(spark, damage):
    rows = random_talk(11 + damage)
    df = spark.createDataFrame(rows, SPEECH).withColumn("conv", F.lit("own")).withColumn("audit", F.lit(1))
    got = dialogue.report_damaged(df).collect() if damage else dialogue.report(dialogue.conversations(df)).collect()
    assert report_of(got, "conv_id" if damage else "conv") == plain_report(rows, damage)


def test_segments_change_nothing(spark, monkeypatch):
    """Conversations cut into segments of two rows have the same edits."""
    rows = random_talk(21)
    monkeypatch.setattr(dialogue, "SEGMENT", 2)
    got = dialogue.report_damaged(spark.createDataFrame(rows, SPEECH)).collect()
    assert report_of(got) == plain_report(rows)


def test_long_conversation(spark):
    """More rows than a segment, most of them copies; repaired rows alternate."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(3001)] + [(1, 7, "user", "Again.")] * 2000
    df = spark.createDataFrame(rows, SPEECH)
    (got,) = dialogue.report(dialogue.conversations(df)).collect()
    assert (got["duplicate"], got["blank"], got["gaps"]) == (1999, 0, 0)
    lines = sorted(dialogue.repaired(dialogue.conversations(df)).collect(), key=lambda r: r["place"])
    roles = "".join(r["role"][0] for r in lines)
    assert re.fullmatch("(ua)+", roles)
    assert sha("\n".join(f"{r['role']}:{r['text']}" for r in lines)) == got["repaired_sha256"]
    audit = got["audit"]
    assert len(audit) == 5001 + audit.count("I")
    assert got["cost"] == audit.count("R") + 2 * audit.count("D") + 5 * audit.count("I")


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 2, "user", "x")], SPEECH)
    assert dialogue.report_damaged(df.limit(0)).collect() == []
    gone = [(c, 1, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    got = dialogue.report_damaged(spark.createDataFrame(gone, SPEECH)).collect()
    assert gone and report_of(got) == {c: (0, 0, 0, 0, 0, 0, "", sha("")) for c, *_ in gone}


def test_every_short_signature():
    for n in range(1, 5):
        for letters in itertools.product("suaoSUAOx", repeat=n):
            cost, audit, end, _ = dialogue.solve("".join(letters), dialogue.ENDING)[0]
            codes = [("" if c in "oOx" else c.lower(), c == "x", c.isupper()) for c in letters]
            want = plain_edits(codes)
            assert (cost + dialogue.ENDING[end], audit + "I" * dialogue.CLOSING[end]) == want[:2]
