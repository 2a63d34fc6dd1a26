"""Pages, mixing, top-k, sharding, media, pieces: against plain versions, and on odd rows."""

import hashlib
import html as stdlib_html
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandloom.llm import html, maxscore, media, mixing, pieces, queries, sharding
from strandloom.llm.common import stored, table

from .test_text_ops import LONG, empty, odd_docs

# --- pages


def plain_article(page):
    art = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    art = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", art))
    return " ".join(stdlib_html.unescape(art).split())


def test_articles_of_pages(spark, sf_dir):
    pages = table(spark, sf_dir.replace("0.001", "0.01"), "pages")
    got = html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        assert r["text"] == plain_article(r["html"]) and r["n_chars"] == len(r["text"])


def test_labeller_on_unseen_made_pages():
    wrong = total = 0
    net = html.trained()
    for page, main in html.made_pages(200, 12345):
        found = html.blocks(page)
        assert len(found) == len(main)
        if found:
            y = net.label([found])[0] >= 0.5
            wrong, total = wrong + (y != np.array(main)).sum(), total + len(main)
    assert wrong / total < 0.02


def test_long_pages_are_read_in_parts(monkeypatch):
    pages = [html.blocks(p) for p, _ in html.made_pages(30, 7)] + [[]]
    net = html.trained()
    whole = net.label(pages)
    monkeypatch.setattr(html, "STEPS", 3)
    parts = net.label(pages)
    assert all(a == pytest.approx(b, abs=1e-5) for a, b in zip(whole, parts, strict=True))


def test_gradients_of_the_network():
    net, rng = html.Labeller(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = html._padded([rng.normal(size=(n, html.INPUT)).astype(np.float32) for n in (4, 1, 3)])
    y = rng.integers(0, 2, mask.shape).astype(np.float32) * mask
    _, grad = net.step(x, mask, y)
    for name in ("fx", "fh", "fc", "bx", "bh", "bc", "w", "o"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        keep, eps, loss = net.p[name][at], 1e-2, []
        for d in (eps, -eps):
            net.p[name][at] = keep + d
            loss.append(net.step(x, mask, y)[0])
        net.p[name][at] = keep
        assert grad[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=0.02, abs=2e-4)


def test_blocks_of_damaged_markup():
    text = lambda page: [b[0] for b in html.blocks(page)]
    assert text("") == [] and text("plain words") == ["plain words"]
    assert text("<p>a<b>b</b>c<p>d<br>e&amp;f &#233;&nbsp;g<!-- x --><script>var t='</p>';</script>h</p>") == ["abc", "d e&f é gh"]
    assert text("<ul><li>one<li>two</ul><td>x</td><p>un<closed") == ["one", "two", "x", "un"]
    assert text("<p title=it's>some<br>words</p>") == ["some words"] and text("<p a='x>y' b=\">\">in</p><!-- open") == ["in"]
    assert text("<style>p{}</style><div>1 < 2 and 3 > 2</div><title>t</title>") == ["1 < 2 and 3 > 2"]
    bits = lambda size, *words: sum({1 << html._slot(w, size) for w in words})
    path = (bits(html.PATH, "div", ".ad", ".slot", ".big", "p"), bits(html.LAST, "p"))
    assert html.blocks('<div class="ad-slot Big"><p><a href="#">go</a></p></div>') == [("go", path, 1.0)]


def test_blocks_of_odd_tags():
    text = lambda page: [b[0] for b in html.blocks(page)]
    assert text('<p>a</p><script src="x.js"/>var leak=1;</script><p>b</p>') == ["a", "b"]
    assert text("<p>the sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</p><svg/>end") == ["the sum x+1 holds", "end"]
    assert [b[2] for b in html.blocks("<p><a href=/x/>all of it</a></p>")] == [1.0]
    assert text('<div class="foo>Some text <a href="x.html">here</a></div>') == ["Some text here"]
    assert text("<p>a<![CDATA[b & c]]>d</p><p>e <!-- f > --> g</p><? h ?>i") == ["ab & cd", "e g", "i"]
    assert text("<p>a</ p>b</>c</p><SCRIPT>x</scriptx></ScRiPt >d") == ["abc", "d"]
    assert text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<table><tr><td><p>f</table>g") == ["a", "b", "c", "d", "e", "f", "g"]
    assert text("<p a=b =c 'd \"e>f</p><br/><p/>g") == ["f", "g"]


@pytest.mark.parametrize("unit", ["<div>x", "<span>x<p>y", "<![CDATA[x", "<!!x", "<p a=\"b>", "<p a='", "</p>", "<!--x", "<p><button><i>", "<a/", "<script>"])
def test_time_and_memory_are_linear(unit):
    page = (unit * 10**6)[: 10**6]
    tracemalloc.start()
    began = time.process_time()
    html.blocks(page)
    took = time.process_time() - began
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 40 and most < 400e6, (took, most)  # tracing makes it some ten times slower


def test_pages_with_odd_rows(spark):
    page = "<html><body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>" + "word " * 30_000 + "</p></article><footer>all rights</footer></body></html>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", page, "x"), (3, "u", page, "x"), (None, "u", "<p>some words here to read, as a text.</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 5
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == "" and by[1]["n_chars"] == 0
    assert by[3]["text"] == "Title " + ("word " * 30_000).strip() and by[None]["url"] == "u"
    assert html.extract(df.limit(0)).count() == 0


# --- mixing


def test_mixture_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(mixing.mixture(table(spark, sf_dir, "documents")).toPandas()) == rows(con.sql(queries.ORACLE_SQL["op3_mixing"]).df())


def test_stage_margins(spark, sf_dir):
    """The pipeline's mixture has its target margins and fraction in expectation, and near them as drawn."""
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = stored(mixing.described(docs), "rows")
    rates = mixing.sampling_rates(rows)
    total = rows.agg(F.sum("tokens")).first()[0]
    meant = rows.join(rates, list(mixing.DIMENSIONS)).withColumn("w", F.col("tokens") * F.col("rate"))
    drawn = corpus_pipeline.mix(spark, docs, sf_dir).withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")))
    assert meant.agg(F.sum("w")).first()[0] == pytest.approx(total / 2, rel=1e-6)
    assert drawn.agg(F.sum("tokens")).first()[0] == pytest.approx(total / 2, rel=0.1)
    for dim in mixing.DIMENSIONS:
        before = {r[0]: r[1] for r in rows.groupBy(dim).agg(F.sum("tokens")).collect() if r[1]}
        after = {r[0]: r[1] for r in meant.groupBy(dim).agg(F.sum("w")).collect()}
        roots = sum(v**0.5 for v in before.values())
        for value, n in before.items():
            assert after[value] == pytest.approx(total / 2 * n**0.5 / roots, rel=1e-6)


def test_raked_margins(spark):
    rng = random.Random(2)
    cells = {(f"s{a}", b, c): rng.randint(1, 500) for a in range(6) for b in ("en", "de") for c in ("x", "y", "z")}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    given = {"lang": {"en": 1.0, "de": 3.0}}
    got = mixing.raked(df, targets=given, rounds=40).collect()
    total = sum(cells.values())
    assert sum(r["weight"] for r in got) == pytest.approx(total) and got[0]["gap"] < 1e-6
    assert sum(r["weight"] for r in got if r["lang"] == "de") == pytest.approx(0.75 * total, rel=1e-5)
    tokens = Counter()
    for (s, _, _), v in cells.items():
        tokens[s] += v
    for s, v in tokens.items():
        want = math.sqrt(v) / sum(map(math.sqrt, tokens.values())) * total
        assert sum(r["weight"] for r in got if r["source"] == s) == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("given", [None, {"lang": {"en": 3.0, "de": 1.0}, "topic": {"prose": 1.0}}])
def test_raking_in_one_row_and_by_joins(spark, sf_dir, given):
    """Cells as arrays of one row have the weights and the gap of cells that are joined by value."""
    cells = mixing.described(table(spark, sf_dir, "documents")).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = cells.unionByName(spark.createDataFrame([("none", "none", "prose", 0), ("only", "here", "legal", 7)], cells.schema))
    one, many = ({tuple(r[:3]): r for r in mixing.raked(cells, targets=given, one_row=n).collect()} for n in (1 << 21, 0))
    assert set(one) == set(many) and len(one) > 20
    assert all(one[k]["weight"] == pytest.approx(many[k]["weight"], rel=1e-9, abs=1e-9) and one[k]["gap"] == pytest.approx(many[k]["gap"], abs=1e-9) for k in one)


def test_sampled_tokens_have_the_target_shares(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.1"), "documents")
    got = mixing.mixture(docs).select("lang", (F.col("tokens") * F.col("copies")).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    every = {r["lang"]: r["n"] for r in mixing.described(docs).groupBy("lang").agg(F.sum("tokens").alias("n")).collect()}
    for r in got:
        want = math.sqrt(every[r["lang"]]) / sum(map(math.sqrt, every.values()))
        assert r["n"] / sum(x["n"] for x in got) == pytest.approx(want, abs=0.03)


def test_stage_meets_fraction_and_target_shares(spark, sf_dir):
    """The pipeline's stage repeats rows of cells with a rate above 1, so small cells get their share and the sum its fraction."""
    docs = table(spark, sf_dir.replace("0.001", "0.1"), "documents")
    per = lambda df, c: {r[c]: r["n"] for r in mixing.described(df).groupBy(c).agg(F.sum("tokens").alias("n")).collect()}
    got = stored(corpus_pipeline.mix(spark, docs, sf_dir), "mixed")
    every = per(docs, "topic")
    assert sum(per(got, "topic").values()) / sum(every.values()) == pytest.approx(0.5, abs=0.02)
    for c in ("lang", "topic"):
        every, had = per(docs, c), per(got, c)
        for v, n in every.items():
            assert had[v] / sum(had.values()) == pytest.approx(math.sqrt(n) / sum(map(math.sqrt, every.values())), abs=0.02), v
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mixture(docs).collect()})
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == want and max(want.values()) > 1


def test_mixing_of_odd_rows(spark):
    got = mixing.mixture(odd_docs(spark), fraction=1000.0).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "5", "5", "6", "7", "None"]  # no tokens, no place
    assert {r["lang"] for r in got if r["doc_id"] == 6} == {"none"}
    assert mixing.mixture(empty(spark)).count() == 0
    kept = mixing.mixed(odd_docs(spark), fraction=1000.0)
    assert kept.columns == odd_docs(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "5", "6", "7", "None"]


# --- top-k


def plain_top(vectors, k):
    out = set()
    for q, x in vectors:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)  # noqa: B905
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("high", [3, 1024, 2**28])
def test_top_k_with_ties_and_tiles(spark, monkeypatch, high):
    monkeypatch.setattr(maxscore, "SHARD", 100)
    monkeypatch.setattr(maxscore, "BLOCK", 4)
    monkeypatch.setattr(maxscore, "STRETCH", 20)
    rng = random.Random(high)
    vectors = [(i, [rng.randint(-high, high) for _ in range(rng.choice((20, 20, 18)))]) for i in range(0, 2000, 5)]
    vectors += [(3000 + i, vectors[7][1]) for i in range(15)]
    df = spark.createDataFrame(vectors, "id long, vec array<long>")
    got = [tuple(r) for r in maxscore.search(df.where("id % 100 = 0"), df, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_top(vectors, 10)


def test_bounds_save_work():
    """Clear nearest neighbours: most components of a shard are never looked at once the bounds have risen; the result is whole."""
    rng = np.random.default_rng(3)
    vectors = np.round(1024 * rng.normal(size=(24, 6000)) * (0.8 ** np.arange(24))[:, None])
    query, ids = np.round(1024 * 0.8 ** np.arange(24) * rng.choice((-1, 1), 24)), np.arange(6000)
    got, score, looked = maxscore.top(query, -1, vectors, ids, vectors.max(axis=1), vectors.min(axis=1), 10)
    every = query @ vectors
    want = np.lexsort((ids, -every))[:10]
    assert got.tolist() == want.tolist() and score.tolist() == every[want].tolist()
    assert looked < 0.6 * vectors.size
    longest = float(np.sqrt((vectors**2).sum(axis=0).max()))
    again = maxscore.top(query, -1, vectors, ids, vectors.max(axis=1), vectors.min(axis=1), 10, float(every[want[-1]]), longest)
    assert again[0].tolist() == want.tolist() and again[2] < looked


def test_top_k_of_embeddings_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    got = queries.op4_topk(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.TOPK_SQL).fetchall())


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.25, 0.25]), (5, [0.25, 0.25]), (None, [1.0, 1.0]), (100, [-1.0, 0.0]), (6, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id long, vec int")
    v = maxscore.quantised(df, "vec_id", "embedding")
    got = sorted(map(tuple, maxscore.search(v.where("id % 100 = 0"), v, 10).collect()))
    both = 1024 * 256 + 512 * 256
    assert got == [(0, 1, 5, both), (0, 2, 5, both), (0, 3, 6, 0), (0, 4, 100, -1024 * 1024), (100, 1, 6, 0), (100, 2, 5, -1024 * 256), (100, 3, 5, -1024 * 256), (100, 4, 0, -1024 * 1024)]
    assert maxscore.search(v.limit(0), v.limit(0)).count() == 0 and maxscore.search(v.where("id = 0"), v.limit(0)).count() == 0


# --- sharding


def check_shards(got, shards):
    sizes = Counter(r["shard"] for r in got)
    want = [len(got) // shards + (s < len(got) % shards) for s in range(shards)]
    assert [sizes[s] for s in range(shards)] == want
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(want[s]))


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_shards_of_documents(spark, sf_dir, rows):
    docs = table(spark, sf_dir, "documents")
    got = sharding.shuffled(docs, shards=7, rows=rows).collect()
    check_shards(got, 7)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len({r["doc_id"] for r in got}) == len(text)
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    again = sharding.shuffled(docs.repartition(5), shards=7, rows=rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = sharding.shuffled(docs, shards=7, rows=rows, seed=6).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


def test_matrix_and_its_law():
    rng = random.Random(0)
    for good, bad, draws in ((5, 7, 4), (40, 60, 30), (1, 99, 50), (0, 5, 3), (5, 0, 3)):
        got = [sharding.hypergeometric(good, bad, draws, rng) for _ in range(6000)]
        p = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        for k, want in p.items():
            assert got.count(k) / 6000 == pytest.approx(want, abs=0.03)
    m = sharding.matrix([1000, 0, 13, 2500, 7], 6, 1)
    assert [sum(r) for r in m] == [1000, 0, 13, 2500, 7]
    assert sorted(sum(c) for c in zip(*m, strict=True)) == [586, 586, 587, 587, 587, 587]
    big = sharding.hypergeometric(10**10, 3 * 10**10, 10**8, rng)
    assert abs(big - 25_000_000) < 50_000


def test_places_are_uniform(spark):
    """Over many seeds each row is in each shard about as often."""
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    where = np.zeros((30, 3))
    for seed in range(12):
        for r in sharding.shuffled(df, shards=3, seed=seed, partitions=4).collect():
            where[r["doc_id"], r["shard"]] += 1
    assert (where.sum(axis=0) == 120).all()
    assert ((where - 4) ** 2 / 4).sum() < 95  # chi-square with about 58 degrees of freedom


def test_shards_of_odd_rows(spark, tmp_path):
    got = sharding.shuffled(odd_docs(spark), shards=4).collect()
    check_shards(got, 4)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["size"] == 16 and by[1]["text_crc32"] == 0
    assert sharding.shuffled(empty(spark)).count() == 0
    unique = odd_docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sharding.write_shards(unique, f"file://{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 7 and back.where("doc_id = 4").collect()[0]["text"] == LONG
    check_shards(back.collect(), 3)


def test_written_shards_of_repeated_rows(spark, tmp_path):
    """Null and repeated keys, equal rows, and columns called shard, slot, size and part: each row is written once."""
    rows = [(1, "one", 7, "x"), (1, "one", 8, "y"), (1, "one", 8, "y"), (1, "another", 9, None), (None, "none", 1, "z"), (None, "none", 2, "z"), (None, None, 3, "z"), (2, "two", 4, "w")]
    df = spark.createDataFrame(rows * 30, "doc_id long, text string, shard int, slot string").withColumns({"size": F.lit(5), "part": F.lit("p")}).repartition(7)
    shard, slot = sharding.write_shards(df, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert (shard, slot) == ("_shard", "_slot") and set(back.columns) == {*df.columns, shard, slot}
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    got = back.groupBy(shard).agg(F.collect_set(slot).alias("slots"), F.count("*").alias("n")).collect()
    assert [sorted(r["slots"]) == list(range(60)) and r["n"] == 60 for r in got] == [True] * 4


# --- media


@pytest.mark.parametrize("size, rows", [(0, 1), (1, 1), (576, 1), (577, 2), (1152, 2)])
def test_payload(size, rows):
    p = media.payload(b"a" * size)
    assert p.shape == (rows, 576) and p.tobytes() == b"a" * size + b"\xff" * (rows * 576 - size)


def test_png_round_trip(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 50)
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (1, 576), (7, 576), (300, 576), (64, 33)):
        for x in (rng.integers(0, 256, shape), np.zeros(shape), np.cumsum(rng.integers(0, 3, shape), 0), np.cumsum(rng.integers(0, 3, shape), 1)):
            x = x.astype(np.uint8)
            assert (media.decode(media.encode(x)) == x).all()


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_all_filters(colour):
    """Filters written as the format defines them, byte by byte."""
    rng, step = np.random.default_rng(colour), media.CHANNELS[colour]
    x = rng.integers(0, 256, (12, 9 * step)).tolist()
    raw = b""
    for i, row in enumerate(x):
        kind, up = i % 5, x[i - 1] if i else [0] * len(row)
        out = []
        for j, v in enumerate(row):
            a, b, c = row[j - step] if j >= step else 0, up[j], up[j - step] if j >= step and i else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *out])
    png = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 12, 8, colour, 0, 0, 0)) + media.chunk(b"tEXt", b"any") + media.chunk(b"IDAT", zlib.compress(raw)) + media.chunk(b"IEND", b"")
    assert media.decode(png).tolist() == x


def test_damage_is_found(spark):
    good = media.encode(media.payload(b"some text " * 90))
    bad = [good[:50] + bytes([good[50] ^ 1]) + good[51:], good[:-20], b"", b"GIF89a", good[:8] + good[33:]]
    for b in bad:
        with pytest.raises(ValueError):
            media.decode(b)
    got = media.media_features(spark.createDataFrame([(1, bytearray(good), 7), (2, bytearray(bad[0]), 7), (3, None, 7)], "id long, media binary, feature int")).collect()
    assert got[0]["payload"]["bytes"] == 1152 and got[0]["error"] is None and got[0]["feature"] == 7
    assert got[1]["payload"] is None and "checksum" in got[1]["error"] and got[2]["payload"] is None and got[2]["error"] is None


def test_hash_is_of_low_frequencies():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (64, 96)).astype(np.uint8)
    small = x.reshape(32, 2, 32, 3).mean(axis=(1, 3))
    k, n = np.arange(8)[:, None], np.arange(32)[None]
    c = np.cos(np.pi * (2 * n + 1) * k / 64) / 4
    low = (c @ small @ c.T).ravel()
    want = "".join("1" if v > np.median(low[1:]) else "0" for v in low)
    assert media.image_hash(x) == f"{int(want, 2):016x}"
    near = (x.astype(int) + rng.integers(-2, 3, x.shape)).clip(0, 255).astype(np.uint8)
    assert bin(int(media.image_hash(x), 16) ^ int(media.image_hash(near), 16)).count("1") <= 6


def test_media_of_odd_rows(spark):
    got = media.text_media(odd_docs(spark)).collect()
    assert len(got) == 9
    text = {r["doc_id"]: r["text"] for r in odd_docs(spark).collect()}
    for r in got:
        b = (text[r["doc_id"]] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({tuple(r)[1:] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert media.text_media(empty(spark)).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.load(queries.MODEL))


def some_texts(n=150):
    rng = random.Random(5)
    parts = ["the ", "international", " ", "  ", "\n", "ﬁ", "日本", "▁", "é", "Zug", "1234", "-", "\t", "🎉", "tion", "a", "qu", "\u0000", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "x", "▁", " ", "a" * 500]


def test_without_dropout_as_the_library(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    for t in some_texts():
        got = vocabulary.encode(t, 1, 0)
        if "▁" not in t and "\0" not in t:
            assert got.tolist() == sp.encode(t), t
        assert vocabulary.decode(got) == t


def test_merging_many_at_once_is_merging_each(vocabulary):
    drop = int(0.3 * 2**64)
    chunks = sorted({c for t in some_texts() for c in vocabulary.chunks(t) if c and 1 < len(c) <= 32})
    for d in (0, drop):
        assert vocabulary.merge_all(chunks, [9] * len(chunks), d) == [vocabulary.merge(c, 9, d) for c in chunks]


def test_dropout_varies_and_stays_lossless(vocabulary):
    text = "international representation of understanding " * 8
    seen = set()
    for key in range(6):
        ids = vocabulary.encode(text, key, int(0.2 * 2**64))
        assert vocabulary.decode(ids) == text
        seen.add(ids.tobytes())
    assert len(seen) == 6
    assert len(vocabulary.encode(text, 0, 2**64 - 1)) > len(vocabulary.encode(text, 0, 0))


def test_dropout_of_none_and_of_all(spark, vocabulary):
    """At 0 no merge is skipped, at 1 every one: pieces are characters, and texts come back."""
    text = "international understanding 日本 x"
    chars = vocabulary.encode(text, 3, 2**64)
    assert len(chars) >= len(text) and vocabulary.decode(chars) == text
    assert vocabulary.merge_all(["ational", "ing"], [5, 6], 2**64) == [vocabulary.merge(c, k, 2**64) for c, k in (("ational", 5), ("ing", 6))]
    assert not pieces.below(np.array([0, 5], np.uint64), 0).any() and pieces.below(np.array([0, 2**64 - 1], np.uint64), 2**64).all()
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    none, all_ = (sorted(pieces.encode_checked(docs, queries.MODEL, dropout=d).collect()) for d in (0.0, 1.0))
    assert all(r["lossless"] for r in none + all_) and all_[0]["ids"] == chars.tolist() and none[0]["n_tokens"] < all_[0]["n_tokens"]


def test_long_texts_in_parts(vocabulary, monkeypatch):
    drop = int(0.1 * 2**64)
    whole = [vocabulary.encode(t, 2, drop).tolist() for t in some_texts()]
    monkeypatch.setattr(pieces, "PART", 10)
    assert [vocabulary.encode(t, 2, drop).tolist() for t in some_texts()] == whole
    assert [vocabulary.decode(np.array(w, np.int32)) for w in whole] == some_texts()


def test_each_occurrence_is_cut_anew(spark, vocabulary):
    """A word has many segmentations within a text and at one place over texts."""
    df = spark.createDataFrame([(0, "international " * 400)] + [(i, f"international {i}") for i in range(1, 401)], "doc_id long, text string")
    rows = {r["doc_id"]: r["ids"] for r in pieces.encode(df, queries.MODEL).collect()}

    def words(ids):
        starts = [i for i, x in enumerate(ids) if vocabulary.raw[x].startswith(b" ")] + [len(ids)]
        return [tuple(ids[a:b]) for a, b in zip(starts, starts[1:])]

    assert len(set(words(rows[0])[:-1])) > 8 and len({words(rows[i])[0] for i in range(1, 401)}) > 8
    assert vocabulary.decode(np.array(rows[0], np.int32)) == "international " * 400


def test_chunks_forgotten_give_the_same(vocabulary, monkeypatch):
    drop = int(0.2 * 2**64)
    texts = some_texts()
    whole = [x.tolist() for x in vocabulary.encode_all(texts, list(range(len(texts))), drop)]
    monkeypatch.setattr(pieces, "REMEMBER", 50)
    assert [vocabulary.encode(t, i, drop).tolist() for i, t in enumerate(texts)] == whole


def test_pieces_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    a = {r["doc_id"]: r["ids"] for r in pieces.encode(df.coalesce(1), queries.MODEL).collect()}
    b = {r["doc_id"]: r["ids"] for r in pieces.encode(df.repartition(4), queries.MODEL).collect()}
    assert a == b
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(df, queries.MODEL, epoch=1).collect()}
    assert a != other
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, queries.MODEL, epoch=1), queries.MODEL).collect()}
    assert back == dict(enumerate(some_texts()))


def test_pieces_of_odd_rows(spark):
    got = pieces.encode_checked(odd_docs(spark), queries.MODEL).collect()
    assert len(got) == 9 and all(r["lossless"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["ids"] is None and by[1]["n_tokens"] == 0 and by[2]["ids"] == [] and by[5]["ids"] == by[6]["ids"] and by[4]["n_tokens"] == len(by[4]["ids"]) > 60_000
    assert pieces.encode_checked(empty(spark), queries.MODEL).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(odd_docs(spark), queries.MODEL), queries.MODEL).collect()}
    assert back[1] is None and back[2] == "" and back[4] == LONG
