import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from presslens.llm import wavelet
from presslens.llm.queries import QUERIES, tokenizer_definition
from presslens.llm.wordids import WordIds

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "\n\t ", "It's O'Neil's; they'll say 'tis... I'd", "İstanbul ΣΑΣ ǅ ﬁne", "été, cafés!", "a1b2 3.14 $5% x--y",
    "<|endoftext|> a<|startoftext|>b <|endoftext|>", "한국어 문장, 日本語。 ไทย", " wide blank　here\x1cthere\x85", "≮ ≠ ́lone", "word.́ x‍y 👩‍💻",
    "punct!!! (brackets) [a] {b}|c \"q\"-", "A" * 300 + "," + " aB" * 50,
]


def plain_ids(texts, path=WORDS):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def cut_up(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_texts_are_the_tokenizers(name):
    encoder = WordIds(tokenizer_definition(public_tokenizers.path(name)))
    assert encoder.by_word == name.startswith("word")
    for _ in range(2):  # the second time words are known
        got = encoder.flat(pa.array(ODD))
        assert cut_up(*got) == plain_ids(ODD, public_tokenizers.path(name))
    assert [len(x) for x in encoder.flat(pa.array([], pa.string()))] == [0, 0]


def test_ids_of_random_texts_are_the_tokenizers():
    rng = random.Random(3)
    alphabet = "abcdeABC  \n\t.,!?'s't\"-#1290éÉñ̈İßﬀǆ한中  $€_"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    assert cut_up(*WordIds(tokenizer_definition(WORDS)).flat(pa.array(texts))) == plain_ids(texts)


def test_words_are_met_and_kept_without_a_call_each(monkeypatch):
    monkeypatch.setattr("presslens.llm.wordids.CACHED_BYTES", 20)
    encoder = WordIds(tokenizer_definition(WORDS))
    texts = [f"{w}, {w * 9}. {w}!" for w in ("".join(random.Random(i).choices("abcdé", k=9)) for i in range(3000))]
    assert cut_up(*encoder.flat(pa.array(texts))) == plain_ids(texts)
    known = [w.replace("!", ".") for w in (t.split()[-1] for t in texts)]
    calls = []
    sys.setprofile(lambda _, event, __: calls.append(event) if event in ("call", "c_call") else None)
    got = encoder.flat(pa.array(known))
    sys.setprofile(None)
    assert cut_up(*got) == plain_ids(known) and len(calls) < len(known)
    assert max(map(len, encoder.known.to_pylist())) <= 20


def test_rank_select_and_access_equal_a_plain_list(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    rng = np.random.default_rng(5)
    for n, levels in ((0, 3), (1, 1), (64, 4), (1000, 5), (777, 17)):
        ids = (rng.integers(0, 2**levels, n) // rng.integers(1, 4, n)).astype("<u4" if levels > 16 else "<u2")
        held = wavelet.Shard(wavelet.build(ids, levels))
        assert held.ids().tolist() == ids.tolist()
        assert [held.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for token in [*np.unique(ids)[:20].tolist(), 2**levels - 1, 2**levels]:
            places = np.flatnonzero(ids == token)
            assert held.occurrences(token).tolist() == places.tolist() and held.count(token) == len(places)
            low, high = n // 3, n - n // 5
            assert held.count(token, low, high) == np.count_nonzero(ids[low:high] == token)
            assert held.occurrences(token, low, high).tolist() == [p for p in places if low <= p < high]
            assert [held.select(token, k) for k in range(len(places))][:5] == places[:5].tolist()
    for call in (lambda: held.access(-1), lambda: held.access(n), lambda: held.select(2**levels, 0)):
        with pytest.raises(IndexError):
            call()


def brute(rows):
    """Rows (doc_id, text) in id order, nulls first; starts follow from the order."""
    listed, start = [], 0
    for (doc, text), ids in zip(rows, plain_ids([t for _, t in rows])):
        ids = [*ids, 1]
        listed.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return listed


def test_documents_come_back_from_many_shards(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma-ray", "it's", "42"], k=rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "no id"), (7, "again seven"), (9, rows[9][1]), (401, None), (402, "long " * 30000)] + [(403 + i, t) for i, t in enumerate(ODD)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k0 int, token string").repartition(5)
    definition, path = tokenizer_definition(WORDS), str(tmp_path / "s")
    before = wavelet.write_shards(docs, definition, path, shard=500)
    assert len(list((tmp_path / "s").iterdir())) > 8
    got = wavelet.read_documents(spark, path, before, with_ids=True).collect()
    want = brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted([(r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got]) == sorted((d or -1, n, c) for d, n, c in want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)

    alpha = Tokenizer.from_file(WORDS).encode("alpha").ids[0]
    places = {(r.doc_id, r.place) for r in wavelet.token_places(spark, path, [alpha]).collect()}
    assert places == {(r.doc_id, i) for r in got for i, x in enumerate(np.frombuffer(r.ids, "<u4")) if x == alpha}
    totals = {r.token: r.n for r in wavelet.token_totals(spark, path, [alpha, 1, 49000]).collect()}
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert totals == {t: int((flat == t).sum()) for t in (alpha, 1, 49000)}


def test_query_over_whole_table_equals_plain_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    ids = [np.array([*x, 1], "<u4") for x in plain_ids([r.text for r in docs])]
    starts = np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    got = {tuple(r) for r in QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(r.doc_id, s, len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(docs, starts, ids)}


def test_no_documents_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    out = wavelet.stored_documents(docs, tokenizer_definition(WORDS))
    assert out.count() == 0 and dict(out.dtypes)["doc_id"] == "int"


def test_files_that_are_something_else_are_refused(tmp_path):
    (tmp_path / "x.wavelet").write_bytes(b"something else")
    with pytest.raises(ValueError):
        wavelet.Shard(wavelet.read_file(f"file:{tmp_path}/x.wavelet"))
