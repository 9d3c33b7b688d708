"""The pipeline's stages, each held against what it must do to its own input."""

import zlib

import corpus_pipeline
from presslens.llm import crf, mixing, neardup, rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((docs, out))
        docs = out
    assert all(out.columns == COLUMNS for _, out in seen[:-1])

    before, after = seen[0]
    kept = {r.doc_id for r in before.collect() if not any(x.rejects(rules.Facts(r.text)) for x in rules.RULES)}
    assert {r.doc_id for r in after.collect()} == kept

    before, after = seen[1]
    groups = neardup.near_duplicates(before, percent=80).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups}

    before, after = seen[2]
    raw = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text)
        assert ("[EMAIL]" in r.text) == bool(crf.emails(raw[r.doc_id])) and not crf.base_spans(r.text)

    before, after = seen[3]
    plan = {r.doc_id: r for r in mixing.mixture(before).collect()}
    words = after.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r.doc_id: r.n for r in words.collect()} == {d: r.taken for d, r in plan.items() if r.taken}

    before, after = seen[4]
    assert after.agg(F.countDistinct("doc_id")).first()[0] == before.select("doc_id").distinct().count()
    total, pieces = after.agg(F.sum("length"), F.max("sequence_id")).first()
    assert pieces == (total - 1) // 1024


def test_packed_sequences_hold_their_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four " * 2000)], "doc_id long, text string")
    for r in corpus_pipeline.packed(spark, docs, SF).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_near_copies_above_four_fifths_go(spark):
    assert neardup.sketch_limit(0.85) == 26
    words = [f"w{k}" for k in range(200)]
    copy = [f"x{k}" if k in (20, 60, 100, 140) else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "other words stand here alone")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]


def test_near_dedup_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text), (5, "a b c d e f"), (5, text + " x"), (9, "A b c d e f"), (7, "g h"), (7, "g h"), (None, text), (None, text), (8, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id int, text string, text_sha256 string")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, text), (5, "a b c d e f"), (7, "g h"), (None, text), (None, text), (8, None), (8, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0
