from pyspark.sql import functions as F

from presslens.operators import lookup, sequences, vocabulary


def tokens_of(spark, *texts):
    rows = [(i, t.split()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "article_id bigint, tokens array<string>")


def as_dict(vocab):
    return {r.token: r.id for r in vocab.collect()}


def test_vocabulary_goldens(spark):
    df = tokens_of(spark, "b b a a c d d d")
    assert as_dict(vocabulary.frequency_vocabulary(df, "tokens")) == {"<pad>": 0, "<unk>": 1, "d": 2, "a": 3, "b": 4}
    assert as_dict(vocabulary.capped_vocabulary(df, "article_id", "tokens")) == {"<OOV>": 1, "d": 2, "b": 3, "a": 4, "c": 5}


def test_padding(one):
    def arr(*xs):
        return F.array(*[F.lit(x).cast("bigint") for x in xs])

    assert one(sequences.pad_right(arr(7, 8), 3)) == [7, 8, 0]
    assert one(sequences.keep_head(arr(5, 6, 7, 8), 3)) == [5, 6, 7]
    assert one(sequences.keep_tail(arr(5, 6, 7, 8), 3)) == [6, 7, 8]
    assert one(sequences.keep_tail(arr(5), 3)) == [5]


def test_numericalize_with_empty_and_unknown(spark):
    df = tokens_of(spark, "d d a zz", "", "b b a d a c")
    vocab = vocabulary.frequency_vocabulary(df, "tokens")
    ids = as_dict(vocab)
    head = {r.article_id: r.ids for r in sequences.numericalize(df, "article_id", "tokens", vocab, 3).collect()}
    assert head == {0: [ids["d"], ids["d"], ids["a"]], 1: [0, 0, 0], 2: [ids["b"], ids["b"], ids["a"]]}
    tail = {r.article_id: r.ids for r in sequences.numericalize(df, "article_id", "tokens", vocab, 2, truncate="tail").collect()}
    assert tail[0] == [ids["a"], 1] and tail[2] == [ids["a"], 1]
    capped = {r.article_id: r.ids for r in sequences.numericalize(df, "article_id", "tokens", vocab, 3, num_words=3).collect()}
    assert set(capped[0]) <= {1, 2}


def longest_first(t, c, budget):
    while t + c > budget:
        if t > c:
            t -= 1
        else:
            c -= 1
    return t, c


def test_pair_lengths(spark):
    df = spark.createDataFrame([(t, c) for t in range(0, 40, 3) for c in range(0, 40)], "t int, c int")
    a, b = sequences.pair_lengths(F.col("t"), F.col("c"), 21)
    for r in df.select("t", "c", a.alias("a"), b.alias("b")).collect():
        assert (r.a, r.b) == longest_first(r.t, r.c, 21)
    a, b = sequences.pair_lengths(F.col("t"), F.col("c"), 253)
    goldens = [(10, 100, 10, 100), (10, 400, 10, 243), (300, 300, 127, 126), (300, 50, 203, 50)]
    got = spark.createDataFrame([g[:2] for g in goldens], "t int, c int").select("t", "c", a, b).collect()
    assert [tuple(r) for r in got] == goldens


def test_pair_sequences(spark):
    df = spark.createDataFrame([(1, ["a", "a"], ["b", "b", "b"]), (2, [], [])], "article_id bigint, t array<string>, c array<string>")
    special = (vocabulary.PAD, vocabulary.UNKNOWN, vocabulary.CLS, vocabulary.SEP)
    vocab = vocabulary.frequency_vocabulary(tokens_of(spark, "a a b b b"), "tokens", specials=special)
    rows = {r.article_id: r for r in sequences.pair_sequences(df, "article_id", "t", "c", vocab, 9).collect()}
    assert rows[1].ids == [2, 5, 5, 3, 4, 4, 4, 3, 0]
    assert rows[1].mask == [1] * 8 + [0]
    assert rows[1].segments == [0] * 4 + [1] * 4 + [0]
    assert rows[2].ids == [2, 3, 3] + [0] * 6 and rows[2].segments == [0, 0, 1] + [0] * 6


def test_lookup_is_the_same_for_hot_and_cold_keys(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("token"))
    more = [(9000 + i, "x" * 200) for i in range(3)] + [(9100 + i, None) for i in range(5)]
    rows = rows.unionAll(spark.createDataFrame(more, "id bigint, token string"))
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), ("x" * 200, 4), ("never", 5)], "token string, v int")
    want_inner = sorted(map(tuple, rows.join(table, "token").collect()))
    want_left = sorted(map(tuple, rows.join(table, "token", "left").collect()), key=repr)
    for limit, size in ((1, 0), (2, 0), (20_000, 0), (20_000, 10**6)):
        monkeypatch.setattr(lookup, "HOT_KEYS", limit)
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", size)
        assert sorted(map(tuple, lookup.lookup(rows, "token", table, 4).collect())) == want_inner
        kept = lookup.lookup(rows, "token", table, 4, keep_missing=True)
        assert sorted(map(tuple, kept.collect()), key=repr) == want_left


def test_hot_keys_come_from_the_rows_whatever_their_length(spark, monkeypatch):
    """A key that the table lacks and a long one are hot by their share of the rows."""
    monkeypatch.setattr(lookup, "HOT_KEYS", 5)
    long = "y" * 300
    keys = ["unseen"] * 40 + [long] * 30 + [f"k{i}" for i in range(30)] + [None] * 50
    rows = spark.createDataFrame(list(enumerate(keys)), "id bigint, token string")
    hot = {r[0] for r in lookup.hot_keys(rows, "token").collect()}
    assert "unseen" in hot and len(hot) == 2 and all(len(k) <= 65 for k in hot)


def test_embedding_matrix(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("a", 2)], "token string, id bigint")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("<pad>", [9.0, 9.0])], "token string, vec array<float>")
    got = {r.id: r.vec for r in vocabulary.embedding_matrix(vocab, vectors, 2).collect()}
    assert got == {0: [0.0, 0.0], 1: [0.0, 0.0], 2: [1.0, 2.0]}
    noisy = vocabulary.embedding_matrix(vocab, vectors, 2, random_missing=True, pad_zero=False)
    got = {r.id: r.vec for r in noisy.collect()}
    assert got[0] == [9.0, 9.0] and got[1] != [0.0, 0.0]
