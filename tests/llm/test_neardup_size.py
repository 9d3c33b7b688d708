"""What near-dedup moves: texts stay where they lie, open pairs follow the rare shingles, regions keep their texts together."""

import random

import pytest

import corpus_pipeline
from presslens.llm import neardup
from presslens.llm.components import saved
from tests.llm.test_corpus import copies, slow_components


def alike(groups, size, words=100, own=30):
    """Texts of a group share a passage and have ``own`` words of their own, too many for a link."""
    return [
        (g * size + k, g * size + k, " ".join([f"p{g}x{i}" for i in range(words)] + [f"u{g}x{k}x{i}" for i in range(own)]))
        for g in range(groups) for k in range(size)
    ]


def test_shingles_a_sample_does_not_see_are_no_open_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE_ROWS", 10)
    texts = spark.createDataFrame(alike(30, 6), "id long, component long, text string")
    assert neardup.open_pairs(neardup._prefixes(texts, 85), 85).count() == 0


def test_slots_count_no_less_than_the_texts(spark):
    rows = [(k, k, " ".join(f"w{i}" for i in range(k % 5, 30))) for k in range(400)] + [(400, 400, None), (401, 401, "")]
    texts = spark.createDataFrame(rows, "id long, component long, text string").repartition(5)
    slots = neardup._slots(texts)
    last = neardup.Shingler().sets(neardup.pa.array([" ".join(f"w{i}" for i in range(4, 30))]))
    found = slots[next(last) >> neardup.np.uint64(64 - (len(slots).bit_length() - 1))]
    assert (found == 255).all() and (slots > 0).sum() <= 26
    assert not neardup._slots(texts.limit(0)).any()


@pytest.mark.parametrize("rows", [4, 1024])
def test_a_text_goes_to_the_blocks_of_its_region_only(spark, monkeypatch, rows):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    pairs = [(10 * r + i, 10 * r + j) for r in range(20) for i in range(3) for j in range(i)] + [(1000 + i, 1001 + i) for i in range(30)]
    df = saved(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long"), "pairs")
    found = {r.id: r for r in neardup._regions(df).collect()}
    assert set(found) == {x for p in pairs for x in p}
    assert all((found[a].blocks, found[a].region) == (found[b].blocks, found[b].region) for a, b in pairs)
    assert {found[10 * r].blocks for r in range(20)} == {1}
    large = [found[1000 + i] for i in range(31)]
    assert {r.blocks for r in large} == {-(-31 // rows)} and all(0 <= r.block < r.blocks for r in large)
    assert len({r.region for r in found.values() if r.blocks == 1}) <= -(-len(found) // rows)


@pytest.mark.parametrize("ids", [7, 1_000_000])
def test_components_do_not_depend_on_slices_and_blocks(spark, monkeypatch, ids):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", ids)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    rows = copies(2, 1, 150, 300, 6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_components(rows)


def test_rows_are_gathered_and_left_out_in_slices(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 7)
    rows = spark.createDataFrame([(i // 2 if i else None, f"t{i}") for i in range(100)], "id long, text string")
    asked = saved(spark.createDataFrame([(i, i * i) for i in range(0, 60, 3)], "id long, square long"), "asked")
    got = sorted((r.id, r.text, r.square) for r in neardup.gathered(rows, asked, "gathered").collect())
    assert got == sorted((i // 2, f"t{i}", (i // 2) ** 2) for i in range(1, 100) if i // 2 % 3 == 0)
    left = sorted(r.text for r in neardup.without(rows, asked.select("id")).collect())
    assert left == sorted(f"t{i}" for i in range(100) if i == 0 or i // 2 % 3)


def test_near_dedup_moves_no_text_where_ids_are_unique(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(60)] for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(base[i % 20])) for i in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = corpus_pipeline.near_dedup(spark, docs, "")
        plan = left._jdf.queryExecution().optimizedPlan().toString() + left._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert sorted(r.doc_id for r in left.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
