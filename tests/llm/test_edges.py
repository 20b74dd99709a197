"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, decontaminate, jaccard, media, mixing, secrets_scan, suffix_dedup, token_store, toxicity, warc
from lattica.llm.common import shared_dir

WORDS = random.Random(3).choices(["alpha", "beta", "gamma", "delta", "omega", "über", "naïve", "x1"], k=30000)
TEXT = " ".join(WORDS[:80])
ROWS = [(1, None, None), (2, "", "a"), (3, TEXT, "a"), (3, TEXT, "a"), (4, TEXT, None), (None, TEXT, "b"), (None, None, "b"), (5, " ".join(WORDS), "b"), (6, "   \n\t ", ""), (7, "one two", "c"), (8, "ONE two", "c"), (9, "a\x00b ퟿ token = \"9f8e7d6c5b4a39281706f5e4d3c2b1a098765432\"", "c")]
CLASHING = ("key", "n", "tag", "bucket", "token", "label", "score", "packed", "spans", "size", "start", "part", "rank", "component_id", "__size", "__order", "range", "whole", "row", "order")


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    return df.withColumns({c: F.lit("odd") for c in CLASHING})


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    return table(spark, ROWS if request.param == "rows" else [])


def test_suffix(docs):
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    if rows:
        assert [r.n_removed for r in by[3]] == [0, 0], "equal rows leave each other alone"
        assert by[4][0].n_removed == by[4][0].n_bytes == len(TEXT.encode())
        assert sorted(r.n_removed for r in by[None]) == [0, len(TEXT.encode())]
        assert by[1][0].n_bytes == by[2][0].n_bytes == 0


def test_jaccard(docs):
    rows = jaccard.near_duplicate_groups(docs).collect()
    assert len(rows) == docs.count()
    if rows:
        one = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
        assert {(1, 0, 1), (2, 0, 2), (6, 0, 6), (7, 1, 7), (8, 1, 7)} <= one
        assert {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}
        assert {r.component_id for r in rows if r.doc_id is None} == {3, None}


def test_decontaminate(docs, spark):
    items = spark.createDataFrame([(1, TEXT[:200]), (2, None), (3, ""), (4, TEXT[:200])], "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    found = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items).collect()}
    expected = {(d, i, 0) for d in (3, 4, None, 5) for i in (1, 4)} if docs.count() else set()
    assert found == expected
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_toxicity(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == docs.count() and all(r.score == 0.5 for r in rows)
    some = spark.createDataFrame([(3, 1), (7, 0), (8, 0), (5, 1), (4, None)], "doc_id bigint, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.train(docs, some)).collect())


def test_secrets(docs, spark):
    rows = secrets_scan.scan(docs).collect()
    assert [(r.doc_id, r.length, r.is_secret) for r in rows] == ([(9, 40, 1)] if docs.count() else [])


def test_mixing(docs):
    rows = mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", "whole", "extra").collect()
    assert len(rows) == docs.count()
    if rows:
        assert sum(r["whole"] * r["size"] + r["extra"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=4)
    mixed = mixing.mixed_rows(docs)
    assert mixed.schema == docs.schema
    assert {r["__size"] for r in mixed.collect()} <= {"odd"}


def test_token_store(docs, spark):
    rows = sorted(token_store.store_documents(spark, docs).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))


def test_chat(spark):
    rows = [(None, 1, "user", None), (1, None, None, "a"), (1, 2, "user", "x<|end|>y"), (1, 2, "user", "x<|end|>y"), (1, 3, "user", "<\\|turn|>[INST]"), (1, 4, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    back = {r.conv_id: r.turns for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in back[1]] == [("", "a"), ("user", "x<|end|>y"), ("user", "x<|end|>y"), ("user", "<\\|turn|>[INST]"), ("assistant", "")]
    assert [tuple(t) for t in back[None]] == [("user", "")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_warc(spark):
    html = "<p>" + "long " * 60
    rows = [(3, "http://a b\r\n", html), (2, None, html), (2, "u", html), (None, "v", html), (5, "w", None), (6, "w", ""), (7, "w", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit(2)})
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(warc.write_warc(pages, shared_dir(spark, "w")), 300).collect()), key=str)
    n = len(html)
    assert got == sorted([(3, "revisit", 2, n), (2, "response", None, n), (2, "response", None, n), (None, "revisit", 2, n), (5, "response", None, 0), (6, "response", None, 0), (7, "response", None, 5)], key=str)
    assert warc.read_warc(warc.write_warc(pages.limit(0), shared_dir(spark, "w"))).count() == 0


def test_media(spark):
    rows = [(1, [0.1] * 64), (2, [0.1] * 64), (3, None), (4, []), (None, [float(k % 7) for k in range(64)])]
    tunes = media.tunes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("digest", F.lit(1)))
    prints = {r.id: r for r in media.fingerprints(tunes).collect()}
    assert prints[1].digest == prints[2].digest and prints[3].digest is None and prints[4].frames == 0
    broken = spark.createDataFrame([(1, bytearray(b"RIFFnope")), (2, None)], "vec_id bigint, media binary")
    assert all(r.frames == 0 for r in media.fingerprints(broken).collect())


def test_pipeline_stages(docs, spark):
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    docs = docs.unionByName(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        kept[name] = sorted((tuple(r[:3]) for r in out.collect()), key=str)
    rows = sorted((tuple(r[:3]) for r in docs.collect()), key=str)
    assert kept["decontamination"] == rows
    assert kept["toxicity"] in (rows, []) or set(kept["toxicity"]) <= set(rows)
    words = [r for r in kept["near duplicates"] if (r[1] or "").split()]
    assert [r for r in kept["near duplicates"] if not (r[1] or "").split()] == [r for r in rows if not (r[1] or "").split()]
    assert len(words) == len({(r[1] or "").lower() for r in rows if (r[1] or "").split()})
    last = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    assert len(last) == len(rows) and sorted(r.start for r in last) == [sum(r.n_tokens for r in sorted(last, key=lambda r: r.start)[:k]) for k in range(len(last))]


def test_mixing_agrees_with_itself(spark):
    """Rows of one id, or none, and of one size: whatever their order, the same ones are taken, and ranges divide them."""
    rows = [(k % 2 or None, " ".join(random.Random(k).choices(WORDS, k=7)), "ab"[k % 5 == 0]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("extra", F.lit(1))
    taken = [sorted(map(str, mixing.mixed_rows(d).collect())) for d in (df.repartition(1), df.repartition(7, "text"), df.orderBy(F.desc("text")))]
    assert taken[0] == taken[1] == taken[2]
    order = mixing.mix(df).select("row.doc_id", "whole", "extra").collect()
    assert len(order) == 60


def test_jaccard_of_repeated_ids(spark):
    """Rows without id, or of one id, meet by their classes: each class's set is made once."""
    rows = [(None if k % 3 else 7, " ".join(f"w{k // 2}x{j}" for j in range(40)) + (" end" if k % 2 else "")) for k in range(120)]
    df = spark.createDataFrame(rows + rows[:30], "doc_id bigint, text string").repartition(6)
    found = jaccard.near_duplicate_groups(df).collect()
    assert len(found) == 150 and all(r.component_id in (7, None) for r in found)
    keys = jaccard.document_keys(df, spark.sparkContext.broadcast(jaccard.frequent_shingles(df, 3)), 3, 9, 10, False)
    wanted = keys.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"))
    sets = jaccard._class_sets(df, wanted, 3).collect()
    assert len(sets) == len({r.key for r in sets}) == 120


def test_words_that_occur_once_in_a_stretch_count(spark):
    docs = spark.createDataFrame([("zebras alone",), ("zebras again",)], "text string").repartition(2)
    known = secrets_scan.frequent_words(docs)
    assert set(secrets_scan.word_hashes(np.frombuffer(b"zebras", np.uint8))) <= set(known)
