"""The pipeline's stages, each against the operator's own decisions on the stage's input, and on odd rows."""

import random

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.llm import common, copies, mixing, pieces, pii, quality, simhash
from strandloom.llm.common import stored, table
from strandloom.llm.queries import MODEL

from .test_text_ops import empty, odd_docs


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], sf_dir), name))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.schema.simpleString() == docs.schema.simpleString() for d in seen[1:5])
    accepted = {r["doc_id"] for r in quality.classify(seen[0], labels).where("predicted = 1").collect()}
    assert ids[1] == accepted and accepted < ids[0]
    rows = [(r["doc_id"], r["text"]) for r in seen[1].select("doc_id", "text").collect()]
    assert ids[2] == set(plain_copies(rows).values()) and ids[2] < ids[1]
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen[2:4])
    found = {r["doc_id"]: r["spans"] for r in pii.detect(seen[2]).collect()}
    assert all((before[i] != after[i]) == (found[i] != "") and not pii.base_spans(after[i]) for i in before)
    drawn = {r["doc_id"]: r["copies"] for r in mixing.mixture(seen[3]).collect()}
    assert {r["doc_id"]: r["count"] for r in seen[4].groupBy("doc_id").count().collect()} == drawn
    assert ids[4] == ids[5] == set(drawn) and 0 < len(drawn) < len(ids[3])
    assert seen[5].where("NOT lossless OR n_tokens <> size(ids)").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, seen[5].collect()))


def test_clean_short_documents_pass(spark, sf_dir):
    """Of labelled good documents nearly all pass the classifier, short ones too."""
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    labels = table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    good = quality.classify(docs, labels).join(labels.where("quality = 1"), "doc_id").agg(F.avg("predicted")).collect()[0][0]
    assert good > 0.99


def test_stages_on_odd_rows(spark, sf_dir):
    for docs in (odd_docs(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            docs = stored(out, name)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("NOT lossless").count() == 0


def test_near_copies_leave_one(spark):
    base = " ".join(f"word{i % 97}x{i}" for i in range(4000))
    rows = [(i, base if i < 5 else base.replace("word3x3", f"other{i}")) for i in range(10)] + [(20, "something else, by itself, of some length that stands alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == {0, 20}


def test_without_broadcasts_the_same(spark, sf_dir, monkeypatch):
    """With no side small enough to broadcast, all joins are shuffled and give the same rows."""
    docs, labels = table(spark, sf_dir, "documents").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")), table(spark, sf_dir, "labels")

    def results():
        made = (quality.classify(docs, labels), pii.detect(docs), pii.sanitise(docs), mixing.mixture(docs), mixing.mixed(docs), simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs))
        return [sorted(map(repr, (r.asDict() | ({"score": round(r["score"], 9)} if "score" in r else {}) for r in d.collect()))) for d in made]

    want = results()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert results() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def near_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_copies(rows):
    """The least id of each component of pairs with a similarity of 0.8 or more, by comparing all."""
    sets, top = {i: near_sets(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = {k: x if v == y else v for k, v in top.items()}
    return top


def test_stage_folds_copies_with_edits(spark, sf_dir):
    """Copies with ordinary edits, in chains and beside texts just below the similarity; the stage has exactly their components."""
    rng = random.Random(4)
    rows, shared = [], [f"common{i}" for i in range(30)]
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)] + shared
        for _ in range(8):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.randint(1, 5)):
                base[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
    want = plain_copies(rows)
    kept = set(want.values())
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in copies.near_copies(df).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.dedup(spark, df, sf_dir).collect()} == kept and len(kept) < 50
    assert len({r["component_id"] for r in simhash.near_duplicates(df).collect()}) > len(kept)


def test_near_copies_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()} == plain_copies(rows)


def test_near_copies_of_odd_rows(spark):
    got = copies.near_copies(odd_docs(spark)).collect()
    assert len(got) == 9 and copies.near_copies(empty(spark)).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}


def test_batches_of_texts_are_bounded(spark):
    """No batch that a text stage gets holds more than BATCH_BYTES and a row, however many rows there are; all rows come."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(4000).repartition(1).selectExpr("id AS doc_id", "concat(repeat('word ', 400), id) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    spark.conf.unset(name)
    stage = pii.sanitise(docs)  # a stage sets the bound
    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == stage.count() == 4000
    assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + (1 << 13)
    spark.conf.set(name, "64k")
    common.map_text(docs, "doc_id", "text", lambda k, t: [[len(x) for x in t]], "n long")
    assert spark.conf.get(name) == "64k"  # a smaller one stays
    spark.conf.unset(name)


def test_texts_of_any_grouping_have_equal_ids(monkeypatch):
    texts = ["some words of a text", None, "", "x" * 50, "▁ mark", *(f"word {i} and {i % 3}" for i in range(40))]
    keys, found = pieces._keys(texts, 7, 0), []
    for together in (1 << 18, 20):
        monkeypatch.setattr(pieces, "TOGETHER", together)
        made = pieces.Vocabulary(pieces.load(MODEL)).encode_all(texts, keys, 1 << 61)
        found.append([None if x is None else x.tolist() for x in made])
    assert found[0] == found[1] and found[0][1] is None and found[0][2] == []
