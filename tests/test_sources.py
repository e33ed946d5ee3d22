"""Layouts, dictionaries and sinks; the lexicon fixture."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import lexicon as LX
from lexloom.sources import layouts as L


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_layouts(spark, tmp_path):
    bad = lines(spark, "1\t4\t\thello there", "x\t0\t\ttext", "2\t0", "", None, "3\t\t\t")
    assert [tuple(r) for r in L.parse_layout(bad, "tsv01").collect()] == [(1, 4, "", "hello there"), (3, None, "", "")]
    L.write_layout(L.parse_layout(bad, "tsv01"), "tsv01", f"{tmp_path}/out")
    back = L.read_layout(spark, "tsv01", f"{tmp_path}/out")
    assert back.filter("id = 1 and text = 'hello there'").count() == 1


def test_labels(spark):
    df = spark.createDataFrame([("positive", None), ("negative", "9"), ("neutral", "1"), ("neutral", "1.0"), ("neutral", "x"), ("odd", "1"), (None, None)], "e string, p string")
    got = [tuple(r) for r in df.select(L.label_of(F.col("e")), L.label_of(F.col("e"), F.col("p")), L.label_of(F.col("e"), otherwise=None)).collect()]
    assert got == [(1, 1, 1), (0, 0, 0), (0, 1, None), (0, 1, None), (0, None, None), (0, 0, None), (0, 0, None)]


def test_dictionaries(spark):
    assert [tuple(r) for r in L.slang_table(lines(spark, "u-you", "idk-do not  know", "bad", None)).collect()] == [("u", "you"), ("idk", "do not know")]
    assert {tuple(r) for r in L.antonym_table(lines(spark, "good,bad", "x")).collect()} == {("good", "bad"), ("bad", "good")}
    assert [tuple(r) for r in L.hashtag_sentiment(lines(spark, "#a\t1.5", "#b\t-2", "#c\t0", "d\t1", "#e")).collect()] == [("#a", 1), ("#b", -1)]
    assert [tuple(r) for r in L.synonym_table(lines(spark, "A\tB\tc", "x")).collect()] == [("a", ["b", "c"])]
    with pytest.raises(ValueError):
        L.small_map(spark.range(5).select("id", F.col("id").alias("v")), "id", "v", most=3)


def test_lexicon(spark):
    syn = spark.createDataFrame([("a", "1", 0.5, 0.0, "good#1 fine#2"), ("a", "2", 0.25, 0.0, "good#2"), ("# c", None, None, None, None), ("a", "2", 0.25, 0.0, "good#2")], "pos_tag string, synset_id string, pos_score double, neg_score double, terms string")
    lx = LX.load_lexicon(syn)
    assert {(r.lemma, r.pos): r.score for r in lx.collect()} == {("good", "a"): 0.625, ("fine", "a"): 0.25}
    docs = spark.createDataFrame([(1, "good NOT_fine x"), (2, ""), (3, None), (4, "zzz")], "id long, t string")
    s = {r.id: r.score for r in LX.score(docs, "id", "t", lx, LX.tags_from_lexicon(lx)).collect()}
    assert s == {1: pytest.approx((0.625 - 0.25) / 2), 2: 0.0, 3: 0.0, 4: 0.0}


def test_series_sink(spark, tmp_path):
    L.write_series(spark.createDataFrame([("a", 1, 1), ("b", 2, -1)], "entity string, ts long, sentiment int"), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2


def test_labelled_rows_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "d", "o", "neutral", "p", "a b", "a_b", 1), (2, None, "o", "positive", "p", "c", None, 0)], "id long, created_at string, opaque string, emotion string, opaque2 string, unigrams string, bigrams string, pred int")
    L.write_labeled(rows, f"{tmp_path}/r1")
    back = L.read_layout(spark, "short_labeled", f"{tmp_path}/r1")
    got = {r.id: r.l for r in back.select("id", L.label_of(F.col("emotion"), F.col("pseudo_label")).alias("l")).collect()}
    assert got == {1: 1, 2: 1}  # a neutral row has its pseudo-label, another its emotion's
    assert L.read_layout(spark, "short", f"{tmp_path}/r1").count() == 2
    L.write_predictions(spark.createDataFrame([("1,x,y", 1), (None, 0), ("a(b),c", 1)], "value string, pred int"), f"{tmp_path}/p")
    assert {tuple(r) for r in L.read_predictions(spark, f"{tmp_path}/p").collect()} == {("1,x,y", 1), ("", 0), ("a(b),c", 1)}


def test_augmentation_folders(spark, tmp_path):
    for k in (1, 12):
        lines(spark, f"(0.0,text {k}, more)", "bad", "(x,y)").coalesce(1).write.text(f"{tmp_path}/aug/iter{k}")
    assert {tuple(r) for r in L.read_augmented(spark, f"{tmp_path}/aug/*").collect()} == {(0, "text 1, more", 1), (0, "text 12, more", 12)}


def test_term_list(spark):
    assert {r.word for r in L.term_list(lines(spark, "the", " and ", "", None, "the")).collect()} == {"the", "and"}


def test_sentence_tagger(spark):
    lx = spark.createDataFrame([("run", "n", 0.5), ("run", "v", -0.25), ("good", "a", 1.0)], "lemma string, pos string, score double")
    tag = LX.sentence_tagger(lambda ws: ["NN" if w == "run" and i and ws[i - 1] == "a" else "VB" if w == "run" else "JJ" if w == "good" else None for i, w in enumerate(ws)])
    d = spark.createDataFrame([(1, "a run"), (2, "run"), (3, "NOT_good run x"), (4, ""), (5, None)], "id long, t string")
    got = {r.id: r.score for r in LX.score(d, "id", "t", lx, None, tagger=tag).collect()}
    assert got == {1: 0.5, 2: -0.25, 3: pytest.approx(-0.625), 4: 0.0, 5: 0.0}
