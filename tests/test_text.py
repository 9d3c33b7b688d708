import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from presslens.functions.text import (
    ANY_SPACE, STOP_SUBSTRINGS, basic_clean, clean_text, join_text, space_tokens, term_words, with_bigrams, word_tokens,
)


def test_clean_text_goldens(one):
    assert one(clean_text(F.lit(None))) == ""
    assert one(clean_text(F.lit("<b>연합뉴스</b> 기자 A! 취재기자단 café"))) == "  A 취재단 caf"


def test_clean_text_whole_words(one):
    assert one(clean_text(F.lit("기자 취재기자단 오늘 x"), whole_word=True)) == "취재기자단 x"


def test_basic_clean_and_join(one):
    assert one(basic_clean(F.lit(None))) == ""
    assert one(basic_clean(F.lit("\t a b \n"))) == "a b"
    assert one(join_text(F.lit(None), F.lit("b\n"))) == "b"
    assert one(join_text(F.lit("a"), F.lit("b"))) == "a b"


def test_ends_are_trimmed_without_a_pattern_and_foreign_runs_go_in_one(spark, one):
    blanks = [c for c in map(chr, range(0x3100)) if re.fullmatch(ANY_SPACE, c)]
    assert one(basic_clean(F.lit("".join(blanks) + "a\u2003b\u200b" + "".join(blanks)))) == "a\u2003b\u200b"
    assert one(clean_text(F.lit("a\uabff가힣\ud7a4😀\t!z\uffff"))) == "a 가힣 z"
    df = spark.createDataFrame([("a",)], "t string")
    plans = [df.select(f(F.col("t")).alias("t"))._jdf.queryExecution().optimizedPlan().toString() for f in (basic_clean, clean_text)]
    assert [p.count("regexp_replace") for p in plans] == [0, 2]


def test_tokenizer_goldens(one):
    assert one(space_tokens(F.lit(" Ab  c "))) == ["Ab", "c"]
    assert one(word_tokens(F.lit("The U.S. in 2024abc _x 한국"))) == ["the", "in", "abc", "한국"]
    assert one(with_bigrams(term_words(F.lit("A bc de 12")))) == ["bc", "de", "12", "bc de", "de 12"]


@pytest.mark.parametrize("text", [None, "", "x", "ab"])
def test_bigrams_of_short_texts(one, text):
    assert one(with_bigrams(term_words(F.lit(text).cast("string")))) == (["ab"] if text == "ab" else [])


def is_kept(c):
    return "가" <= c <= "힣" or c.isascii() and c.isalnum()


def expected_clean(text):
    """One scan: a closed tag that isn't empty, and every other character, is a gap; runs of gaps are one blank."""
    out, gap, i = [], False, 0
    while i < len(text):
        close = text.find(">", i) if text[i] == "<" else -1
        if is_kept(text[i]):
            out += [" "] * (gap and bool(out)) + [text[i]]
            gap = False
        else:
            gap = True
            i = close if close > i + 1 else i
        i += 1
    found = "".join(out)
    for stop in STOP_SUBSTRINGS:
        found = "".join(found.split(stop))
    return found


def test_clean_text_more_goldens(one):
    assert one(clean_text(F.lit("a<>b"))) == "a b"
    assert one(clean_text(F.lit("a<b c"))) == "a b c"
    assert one(clean_text(F.lit("뉴기자스 1<br>2"))) == " 1 2"


def test_wide_blanks_are_space(one):
    assert one(basic_clean(F.lit("\u3000a\u00a0b\u3000"))) == "a\u00a0b"
    assert one(space_tokens(F.lit("a\u3000b\u00a0c"))) == ["a", "b", "c"]


alphabet = st.sampled_from(list("ab<>/ \t\n.é기자사진뉴스연합오늘0_"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet, max_size=30), min_size=20, max_size=40))
def test_cleaning_and_tokens_match_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = df.select(
        "s", clean_text(F.col("s")).alias("c"), space_tokens(F.col("s")).alias("t"), word_tokens(F.col("s")).alias("w")
    ).collect()
    for r in rows:
        assert r.c == expected_clean(r.s)
        assert r.t == r.s.split()
        runs = re.findall(r"(?:(?!\d)\w)+", r.s.lower())
        assert r.w == [x for x in runs if 2 <= len(x) <= 50 and not x.startswith("_")]
