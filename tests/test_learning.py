"""Naive Bayes, self- and co-training, balance, time and metrics on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from lexloom.operators import balance as BAL
from lexloom.operators import bayes as B
from lexloom.operators import cotrain as CT
from lexloom.operators import evaluate as E
from lexloom.operators import selftrain as ST
from lexloom.operators import temporal as T
from lexloom.plans import data as P

SCHEMA = "id long, label int, tokens array<string>"


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(1, 1, ["good", "good", "day"]), (2, 0, ["bad", "day"]), (3, 1, ["nice"]), (4, None, ["good"])], SCHEMA)


def test_parameters(spark, tiny):
    p = {(r.token, r.label): r.theta for r in B.parameters(B.train(tiny, "tokens")).collect()}
    assert p[None, 0] == pytest.approx(math.log(2 / 5)) and p[None, 1] == pytest.approx(math.log(3 / 5))
    assert p["good", 0] == pytest.approx(-14.220977, abs=1e-6) and p["good", 1] == pytest.approx(-13.122366, abs=1e-6)
    q = spark.createDataFrame([(9, None, ["unseen", "good"]), (10, None, []), (11, None, None)], SCHEMA)
    s = {r.id: r for r in B.score(q, B.train(tiny, "tokens"), "tokens", "id").collect()}
    assert s[9].raw0 == pytest.approx(-29.358246, abs=1e-5) and s[9].raw1 == pytest.approx(-27.854171, abs=1e-5)
    assert s[9].p1 == pytest.approx(0.818181, abs=1e-6) and s[9].pred == 1
    assert s[10].p1 == pytest.approx(0.6) and s[11].p1 == pytest.approx(0.6)


def test_against_library(spark, data):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer

    train, _, test = P.roles(spark, data)
    train, test = train.select("id", "uni", "label").cache(), test.select("id", "uni").cache()
    cv = CountVectorizer(inputCol="uni", outputCol="features").fit(train)
    v = len(cv.vocabulary)
    known = F.array(*[F.lit(w) for w in cv.vocabulary])
    test = test.withColumn("uni", F.filter("uni", lambda t: F.array_contains(known, t)))
    ml = NaiveBayes(smoothing=1.0).fit(cv.transform(train)).transform(cv.transform(test))
    ours = B.score(test, B.train(train, "uni"), "uni", "id", v=v)
    j = ml.select("id", F.col("probability")).join(ours.select("id", "p1"), "id").collect()
    assert j and max(abs(r.probability[1] - r.p1) for r in j) < 1e-6


def test_models_add(spark, tiny):
    a, b = tiny.filter("id < 2"), tiny.filter("id >= 2")
    x = B.add(B.train(a, "tokens"), B.train(b, "tokens"))
    y = B.train(tiny, "tokens")
    assert sorted(x.cond.collect()) == sorted(y.cond.select("token", "n0", "n1").collect()) and x.prior.first() == y.prior.first()


def test_rounds_partition_the_pool(spark, data):
    train, pool, _ = P.roles(spark, data)
    r = ST.round_(train, pool, "uni")
    a = E.split_audit(r).first()
    assert a.n_pool == pool.count() and a.n_missing == 0 and a.n_high + a.n_low == a.n_pool
    _, done = ST.loop(train, pool, "uni", rounds=3)
    ids = [x.id for x in done.collect()]
    assert len(ids) == len(set(ids)) <= a.n_pool
    m, none = ST.loop(train, pool.filter("false"), "uni", rounds=2)
    assert none.count() == 0 and m.cond.count() > 0


def test_co_training(spark, data):
    train, pool, _ = P.roles(spark, data)
    _, _, both = CT.exchange(train, pool)
    assert both.count() == pool.count()
    _, _, done = CT.loop(train, pool, steps=2)
    assert done.groupBy("view", "id").count().filter("count > 1").count() == 0


def test_balance(spark):
    df = spark.createDataFrame([(i, 1 if i < 341 else 0, ["a", "b", "c", "d", "e"]) for i in range(399)], SCHEMA).withColumnRenamed("tokens", "uni")
    z = BAL.imbalance(df).first()
    assert (z.p, z.n, z.augment) == (341, 58, True) and z.distance == pytest.approx(0.709273, abs=1e-6)
    assert {r.label: r["count"] for r in BAL.undersample(df).groupBy("label").count().collect()} == {0: 58, 1: 58}
    assert BAL.oversample(df).filter("label = 0").agg(F.max("copy")).first()[0] <= 12
    b = BAL.blankout(df, ["a"]).groupBy("copy").agg(F.count("*"), F.max(F.size("uni"))).orderBy("copy").collect()
    assert [tuple(x) for x in b] == [(k, 58, 4) for k in range(1, 6)]
    s = BAL.synonyms(df, {"a": ["x", "y"]})
    assert s.count() == 58 * 5 and s.filter("array_contains(uni, 'a')").count() == 0
    empty = df.filter("label = 1")
    for f in (BAL.undersample, BAL.oversample, BAL.resample_both):
        assert f(empty).filter("label = 0").count() == 0


def test_smallest_hashes_is_exact(spark):
    df = spark.range(5000).withColumn("label", F.lit(1))
    for n in (0, 1, 777, 5000, 9999):
        got = {r.id for r in BAL.smallest_hashes(df, "id", F.lit(n)).collect()}
        want = {r.id for r in df.orderBy(F.md5(F.col("id").cast("string"))).limit(n).collect()}
        assert got == want


def test_windows(spark):
    w = {k: {(r.period): (r.lo, r.hi) for r in T.periods(spark, k).collect()} for k in ("single", "cumulative", "sliding")}
    assert w["single"][4] == (4, 4) and w["cumulative"][4] == (0, 4) and w["sliding"][4] == (2, 4)
    assert len(w["single"]) == 11 and len(w["sliding"]) == 9
    tr = spark.createDataFrame([(1, 0, 1, ["a"]), (2, 0, 0, ["b"])], "id long, month int, label int, uni array<string>")
    te = spark.createDataFrame([(3, 1, 1, ["a"])], "id long, month int, label int, uni array<string>")
    got = {r.period: (r.n_test, r.accuracy) for r in T.evaluate(tr, te, T.periods(spark, "single")).collect()}
    assert got[0] == (1, 1.0) and got[5] == (0, None)


@pytest.mark.parametrize(("rows", "prc"), [([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], 0.638889), ([(0, 1), (0, 0), (0, 0)], 0.333333), ([(1, 1), (1, 0)], 0.5)])
def test_metrics(spark, rows, prc):
    df = spark.createDataFrame(rows, "pred int, label int")
    assert E.au_prc(df).first()[0] == pytest.approx(prc, abs=1e-6)
    if len(rows) == 6:
        assert E.weighted_f1(df).first()[0] == pytest.approx(0.666667, abs=1e-6)


def test_metrics_without_rows(spark):
    df = spark.createDataFrame([], "pred int, label int")
    assert E.accuracy(df).first().accuracy is None and E.au_prc(df).first()[0] is None and E.confusion(df).count() == 0


def test_augmentation_and_its_gate(spark):
    rows = [(i, 1 if i < 300 else 0, ["kettle", "b", "c", "d", "e"]) for i in range(350)]
    df = spark.createDataFrame(rows, "id long, label int, uni array<string>")
    syn = spark.createDataFrame([("kettle", ["pot", "urn"]), (None, ["x"]), ("b", [])], "word string, neighbours array<string>")
    lem = spark.createDataFrame([("b",), ("c",), ("d",), ("e",), (None,)], "lemma string")
    n = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    b = BAL.augment(df, "blankout", lem)
    assert n(b) == {1: 300, 0: 300} and b.filter("copy > 0 and array_contains(uni, 'kettle')").count() == 0  # the only word that is no lemma goes
    e = BAL.augment(df, "embeddings", table=syn)
    assert n(e) == {1: 300, 0: 300} and {r.w for r in e.filter("copy > 0").selectExpr("uni[0] AS w").distinct().collect()} == {"pot", "urn"}
    s = n(BAL.augment(df, "sampling"))
    assert 110 < s[1] < 190 and abs(s[0] - s[1]) < 50
    even = df.filter("id >= 240")
    for how in ("blankout", "embeddings", "sampling"):
        got = BAL.augment(even, how, lem, syn)
        assert n(got) == {1: 60, 0: 50} and got.filter("copy > 0").count() == 0
        assert BAL.augment(df.filter("false"), how, lem, syn).count() == 0
    with pytest.raises(ValueError):
        BAL.augment(df, "other")


def test_accuracy_by_step(spark, data):
    train, pool, test = P.roles(spark, data)
    got = {(r.step, r.view): r.n for r in CT.accuracy_by_step(train, pool, test, 0.75).collect()}
    assert got and set(got.values()) == {test.count()} and {v for _, v in got} == {0, 1}
    assert CT.accuracy_by_step(train, pool.filter("false"), test, 0.75).count() == 0
