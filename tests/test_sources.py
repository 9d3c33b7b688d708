import pytest
from pyspark.sql import functions as F

from presslens.sources.articles import cleaned_articles, normalise_headers
from presslens.sources.articles import ARTICLE_SCHEMA
from presslens.sources.csv import detect_encodings, load_articles, read_csv, read_csv_detected
from presslens.sources.sinks import load_or_train, write_csv, write_metrics

BODY = 'title,content,label\n"속보, ""사진""","본문\n둘째",1\n'
WANT = ('속보, "사진"', "본문\n둘째", "1")


@pytest.mark.parametrize("codec, name", [("utf-8-sig", "utf-8"), ("utf-8", "utf-8"), ("euc-kr", "euc-kr"), ("cp949", "cp949")])
def test_named_encodings(spark, tmp_path, codec, name):
    path = tmp_path / "a.csv"
    path.write_bytes(BODY.encode(codec))
    assert [tuple(r) for r in read_csv(spark, str(path), name).collect()] == [WANT]


def test_detection(spark, tmp_path):
    files = {
        "bom.csv": BODY.encode("utf-8-sig"), "euc.csv": BODY.encode("euc-kr"), "wide.csv": BODY.replace("속보", "햏").encode("cp949"),
        "bad.csv": BODY.encode("utf-8") + b'"\xff\xff","\x80",0\n', "plain.csv": b"title,content,label\na,b,0\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: r.encoding for r in detect_encodings(spark, str(tmp_path)).collect()}
    assert found == {"bom.csv": "utf-8-sig", "euc.csv": "euc-kr", "wide.csv": "cp949", "bad.csv": "lossy", "plain.csv": "utf-8-sig"}
    rows = read_csv_detected(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    assert {(r.title, r.content) for r in rows if r.encoding == "euc-kr"} == {WANT[:2]}
    assert {r.title for r in rows if r.encoding == "cp949"} == {'햏, "사진"'}
    assert "��" in {r.title for r in rows if r.encoding == "lossy"}


def test_missing_strings_and_headers(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text(" 뉴스제목,본문 ,가짜뉴스여부\nNaN,<p>오늘 날씨</p>,\n", encoding="utf-8")
    df = normalise_headers(read_csv(spark, str(path)))
    assert tuple(df.first()) == (None, "<p>오늘 날씨</p>", None)
    assert cleaned_articles(df).select("title", "content", "text", "label").first() == ("", " 날씨", "날씨", 0)


def test_written_csv_comes_back(spark, tmp_path):
    rows = [(" a ", 'q"q', "line\nbreak, comma"), ("b\\", "", None)]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"), na_strings=()).fillna("")
    assert {tuple(r) for r in back.collect()} == {(a, b, c or "") for a, b, c in rows}


def test_metrics_json(spark, tmp_path):
    write_metrics(spark.createDataFrame([(0.5, 0.25)], "`Accuracy` double, `ROC-AUC` double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["ROC-AUC"] == 0.25


def test_load_or_train_scores_equally(spark, tmp_path):
    from presslens.plans import classify

    df = spark.range(60).select(F.col("id").alias("article_id"), (F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 2 * 2 - 1).cast("double"), F.lit(1.0)).alias("v"))
    dense = classify.dense_features(df, "v")
    path = str(tmp_path / "model")
    first = load_or_train(path, lambda: classify.dense_pipeline().fit(dense))
    again = load_or_train(path, lambda: pytest.fail("trained twice"))
    a, b = (classify.score(m, dense, "article_id").orderBy("article_id").collect() for m in (first, again))
    assert a == b and all(0 <= r.prob <= 1 and r.pred == r.article_id % 2 for r in a)


def test_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("label,본문,article_id,Title \n1,body,7,hello\nx,,8,\n", encoding="utf-8")
    rows = read_csv(spark, str(path), schema=ARTICLE_SCHEMA).orderBy("article_id").collect()
    assert [tuple(r) for r in rows] == [(7, "hello", "body", 1), (8, None, None, None)]
    (tmp_path / "b.csv").write_text("title,content,label\nhello,body text,1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="article_id"):
        read_csv(spark, str(tmp_path / "b.csv"), schema=ARTICLE_SCHEMA)


def test_articles_from_mixed_files_without_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,content,label\nhello,body,1\nhello,body,1\nhello,body,0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("label,content,title\n0,other,x\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes("뉴스제목,본문\n속보,내용\n".encode("cp949"))
    (tmp_path / "d.csv").write_text("title,content,label\n속보,utf16,1\n", encoding="utf-16")
    first, again = (load_articles(spark, str(tmp_path)).orderBy("article_id").collect() for _ in range(2))
    assert first == again and len({r.article_id for r in first}) == 6
    assert sorted((r.title, r.content, r.label if r.label is not None else -1) for r in first) == sorted(
        [("hello", "body", 1)] * 2 + [("hello", "body", 0), ("x", "other", 0), ("속보", "내용", -1), ("속보", "utf16", 1)]
    )


def test_headline_study_reads_plain_files(spark, tmp_path):
    from presslens.plans.missions import headline_study

    rows = [f"{'river boat' if i % 2 else 'vote law'} {i},{'river boat fish' if i % 4 < 2 else 'vote law seat'} {i},{int(i % 2 == (i % 4 >= 2))}" for i in range(80)]
    (tmp_path / "a.csv").write_text("\n".join(["title,content,label", *rows]) + "\n", encoding="utf-8")
    articles = load_articles(spark, str(tmp_path))
    study = headline_study(articles, articles.drop("label"), regs=(0.01,), width=64)
    assert study.scored.count() == 80
