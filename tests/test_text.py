"""Micro-fixtures of the text chain, and its behaviour on odd input."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions import dates as D
from lexloom.functions import text as X
from lexloom.functions.stem import stem, stem_one
from lexloom.operators import dictionaries as DI

SLANG = {"u": "you", "gr8": "great"}
VERBS, STOP, ANT = ["like", "go"], ["the", "and"], [("good", "bad"), ("happy", "sad")]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in df.select("i", make(F.col("s"))).orderBy("i").collect()]


def test_chain(spark):
    cases = [
        ("Sooooo gooood!!! :) #Happy", 1, 0, "positive", "god happy"),
        ("I don't like it :( http://t.co/x", 0, 1, "negative", "NOT_like"),
        ("@bob not very good day :/", 0, 1, "negative", "bad day"),
        ("the café is nice", 0, 0, "neutral", "caf nice"),
        ("LOL :c) and :(", 1, 2, "semi_negative", "lol"),
        (":) (: :(", 2, 1, "semi_positive", ""),
        (":) ok :(", 1, 1, "unknown", ""),
        ("u are GR8 ^_^ :D", 0, 0, "neutral", "you are great"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    marked, cleaned = X.preprocess(F.col("s"), SLANG, VERBS, ANT, STOP)
    df = df.select("i", marked.alias("m"), cleaned.alias("c")).select("i", F.size(X.happy(F.col("m"))).alias("h"), F.size(X.sad(F.col("m"))).alias("s"), "c")
    got = [(r.h, r.s, r.e, r.c) for r in df.withColumn("e", X.emotion(F.col("h"), F.col("s"))).orderBy("i").collect()]
    assert got == [c[1:] for c in cases]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (lambda c: X.negate_verbs(c, ["like", "go"]), [("i don't like it", "i NOT_like  it"), ("i can't see", "i canot see"), ("knot go", "NOT_go "), ("nor go", "NOT_go "), ("don't", "don't")]),
        (lambda c: X.negate_adjectives(c, ANT), [("not good", "bad "), ("not very good", "bad  "), ("not very odd", "not  odd"), ("is not a bad day", "is good   day"), ("neither happy", "sad "), ("not so", "not so")]),
        (X.squeeze_repeats, [("aaaa ooo oo eeee bbb bb zzzz xxx uuu yy", "a o oo e bb bb zz xxx u y")]),
        (lambda c: F.array_join(X.bigrams(X.tokens(c)), " "), [("a b c", "a_b b_c"), ("a", ""), ("", "")]),
        (X.drop_mentions, [("hi @bob x＠y there", "hi there")]),
        (X.clear_text, [("go http://a.b/c #tag. yes_no htt://x y", "go tag  yes no y")]),
        (lambda c: X.remove_stopwords(c, STOP), [("the cat and the cat", "cat cat")]),
    ],
)
def test_functions(spark, make, cases):
    assert column(spark, [c[0] for c in cases], make) == [c[1] for c in cases]


def test_negators_are_refused():
    with pytest.raises(ValueError):
        X.negate_verbs(F.lit("x"), ["cannot"])


def test_null_empty_and_long(spark):
    long = "don't like the so not good " * 20_000
    for make in (X.normalize_ws, X.clear_text, X.drop_mentions, X.squeeze_repeats, X.negate_verbs, X.negate_adjectives, X.strip_non_ascii, X.letters_only, X.drop_short_words, X.remove_stopwords, lambda c: X.slang_replace(c, SLANG)):
        null, empty, big = column(spark, [None, "", long], make)
        assert null is None and empty == "" and len(big) > 1000


def test_idempotent(spark):
    texts = ["aaa  bb ccc ddd", " the and  cat ", "sooo   good"]
    for make in (X.normalize_ws, X.squeeze_repeats, X.remove_stopwords):
        once = column(spark, texts, make)
        assert column(spark, once, make) == once


def test_dates(spark):
    got = column(spark, ["Thu Jan 01 00:00:00 +0000 2015", "Xxx Dec 31 23:00:00 -0200 2015", "Mon Feb 30 00:00:00 +0000 2015", "", None], lambda c: D.epoch_ms(c))
    assert got == [1420070400000, 1451610000000, None, None, None]
    assert column(spark, ["Thu Jan 01 00:00:00 +0000 2015"], D.month0) == [0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert column(spark, ["Thu Jan 01 00:00:00 +0000 2015"], D.month0) == [0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stem():
    assert [stem_one(w) for w in ["running", "NOT_liked", "ponies", "relational", "is"]] == ["run", "NOT_like", "poni", "relat", "is"]


# Published stems of the Snowball English vocabulary.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
    consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
    consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
    conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
    constables constabl constance constanc constancy constanc constant constant knackeries knackeri knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
    kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit
    knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot
    knots knot news news dying die skies sky inning inning proceed proceed ties tie cries cri gas gas this this gaps gap kiwis kiwi by by say say cry cri generously generous""".split()


def test_stems_as_published():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))
    assert [stem(w) for w in ("", "a", "is", "'tis", "dog's", "dogs'", "12", "été")] == ["", "a", "is", "tis", "dog", "dog", "12", "été"]


def test_commas(spark):
    assert column(spark, ["a,b,,c", "", None], X.commas_to_blanks) == ["a b  c", "", None]


def test_dictionaries_as_columns(spark):
    texts = ["u like the gr8 good day", "not good and not cannot", "nothing here", "", None, "u like the gr8 good day"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, s string, own string")
    of = lambda table, w, v, make: [r[1] for r in DI.with_entries(df.drop("own"), "s", table, w, v, "own").select("i", make(F.col("s"), F.col("own"))).orderBy("i").collect()]
    slang = spark.createDataFrame([("u", "you"), ("u", "yu"), ("gr8", "great"), (None, "x")], "w string, v string")
    assert of(slang, "w", "v", X.slang_replace) == column(spark, texts, lambda c: X.slang_replace(c, {"u": "you", "gr8": "great"}))
    assert of(slang.filter("false"), "w", "v", X.slang_replace) == texts
    ants = spark.createDataFrame([("good", "bad"), ("bad", "good"), ("cannot", "can")], "w string, v string")
    assert of(ants, "w", "v", X.negate_adjectives) == column(spark, texts, lambda c: X.negate_adjectives(c, [("good", "bad")]))
    words = spark.createDataFrame([("like",), ("cannot",), ("the",)], "w string")
    assert of(words, "w", None, X.negate_verbs) == column(spark, texts, lambda c: X.negate_verbs(c, ["like", "the"]))
    assert of(words, "w", None, X.remove_stopwords) == column(spark, texts, lambda c: X.remove_stopwords(c, ["like", "cannot", "the"]))


def test_fixed_lists():
    assert len(K.HAPPY) == 20 and len(K.SAD) == 12
