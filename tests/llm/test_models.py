"""Problems 6, 7, 9 and 10: held-out accuracy, brute force and odd input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import langid, mixing, subjects, toxic


@pytest.fixture(scope="module")
def model(spark, data):
    return langid.train(spark.read.parquet(f"{data}/lang_sample.parquet"))


def test_language_held_out(spark, data):
    rows = sorted((r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_sample.parquet").collect())
    langs = tuple(sorted({x for x, _ in rows}))
    train = [r for i, r in enumerate(rows) if i % 4]
    m = langid.fit([(x, langid.words(t)) for x, t in train], langs)
    test = [r for i, r in enumerate(rows) if i % 4 == 0]
    right = sum(langid.analyse(t, m)[0] == x for x, t in test)
    assert right / len(test) > 0.95


def test_mixed_text(model):
    en, de = "the jury adjourned the binding verdict in front of everyone this morning", "das Orchester und das Schlagzeug haben uns gestern Abend sprachlos gemacht"
    lang, conf, segs, props = langid.analyse(f"{en}. {de}", model)
    assert [s[0] for s in segs] == ["en", "de"] and set(props) == {"en", "de"} and 0 < conf <= 1
    assert [s[0] for s in langid.analyse(f"{en} la siesta and left us with the bill", model)[2]] == ["en"]
    assert langid.analyse(None, model) == (None, 0.0, [], {}) and langid.analyse("#tag @user http://x.y 12", model)[0] is None
    cyr = en.replace("e", "е").replace("o", "о")
    assert langid.analyse(cyr, model)[0] == "en"


def test_labels(spark, model):
    en = "the jury adjourned the binding verdict in front of everyone"
    rows = [(1, en, "en-GB"), (2, en, None), (3, en, "und"), (4, en, "nl"), (5, None, None), (6, "", "en"), (7, en, " EN ")]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    r = langid.relabelled(langid.detect(d, model, carry=("label",)), "label")
    assert {x.doc_id for x in r.collect()} == {2, 3, 4}


def brute_segments(s):
    """Maximal scoring segments by their recursive definition."""
    best = max(((sum(s[a:b]), a - b, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 1e-12:
        return []
    _, _, a, b = best
    # the shortest of equal ones
    cand = [(x, y) for x in range(len(s)) for y in range(x + 1, len(s) + 1) if abs(sum(s[x:y]) - best[0]) < 1e-9]
    a, b = min(cand, key=lambda t: t[1] - t[0])
    return brute_segments(s[:a]) + [(best[0], a, b)] + [(v, x + b, y + b) for v, x, y in brute_segments(s[b:])]


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-2.3, -1.1, -0.4, 0.7, 1.9, 3.1]) + rng.random() / 10 for _ in range(rng.randrange(0, 14))]
        got, want = sorted(toxic.segments(s), key=lambda t: t[1]), brute_segments(s)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert all(math.isclose(x[0], y[0]) for x, y in zip(got, want))
    assert len(toxic.segments([1.0, -2.0] * 100_000)) == 100_000  # linear time


def test_tokens():
    assert toxic.tokens("You $tup1d  f o o l!! looool @bob http://x #tag") == ["you", "stupid", "fool", "</s>", "lol", "<user>", "<link>", "#tag"]
    assert toxic.tokens(None) == []


def test_toxic_model(spark):
    rng = random.Random(4)
    plain_ = [f"the {a} {b} was {c} today" for a in ("red", "old", "tiny", "loud") for b in ("kettle", "door", "lamp", "boat") for c in ("fine", "lost", "wet", "gone")]
    bad = ["you are a total fool and nobody likes you", "get lost fool nobody likes you", "what a fool you are go away"]
    rows, labels = [], []
    for i in range(400):
        t = ". ".join(rng.choice(plain_) for _ in range(3))
        is_bad = i % 8 == 0
        if is_bad:
            t += ". " + rng.choice(bad)
        elif i % 8 == 1:
            t += ". he called me a fool and i reported it"
        rows.append((i, t, "s1" if i % 2 else None))
        if i % 2 == 0 or i % 8 == 1:
            labels.append((i, "a", "abusive" if is_bad else "none"))
    rows += [(900, None, None), (901, "", "s2")]
    labels += [(901, "a", None), (None, "a", "abusive"), (5000, "b", "hateful")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = toxic.train(d, spark.createDataFrame(labels, "doc_id long, annotator string, category string"))
    s = toxic.scan(d, m, carry=("source",))
    law = toxic.calibrate(s, m)
    s = toxic.significance(s, law).cache()
    for r in s.filter("size(nets) > 0").collect():
        assert r.log_p == pytest.approx(toxic.log_p(r.nets, r.n_tokens, law.rate[r.category], law.k[r.category]), rel=1e-6, abs=1e-9)
    got = {r.doc_id for r in toxic.flagged(s, law).filter("category = 'abusive'").collect()}
    want = {i for i in range(400) if i % 8 == 0}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / max(1, len(got)) > 0.8
    assert s.count() == 3 * len(rows) and s.filter("doc_id >= 900 and score > 0").count() == 0
    assert toxic.rates(s, law).filter("source is null").count() == 3
    hist = {-5: 80, 10: 20}
    x = toxic.decay(hist)
    assert sum(c / 100 * math.exp(x * k / toxic.BINS) for k, c in hist.items()) == pytest.approx(1)
    none = toxic.train(d, spark.createDataFrame([], "doc_id long, annotator string, category string"))
    assert toxic.flagged(s, toxic.calibrate(s, none)).count() == 0


def brute_fill(rows, total):
    """Level by bisection: sum min(level * weight, size * cap) = total over the sources that can be used."""
    live = [r for r in rows if r[1] > 0 and r[2] > 0 and r[3] > 0]
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, n * c) for _, w, n, c in live) < total else (lo, mid)
    return {r[0]: (min(hi * r[1], r[2] * r[3]) / r[2] if r in live else 0.0) for r in rows}


def test_water_filling(spark):
    rng = random.Random(5)
    for k in range(12):
        rows = [(s, rng.choice([0.0, rng.random(), rng.random()]), rng.randrange(0, 1000), float(rng.randrange(0, 5))) for s in "abcdefgh"]
        total = None if k % 3 else rng.randrange(1, 4000)
        df = spark.createDataFrame(rows, "source string, target_share double, n_size long, max_repeat double")
        got = {r.source: r for r in mixing.fill(df, total).collect()}
        live = [r for r in rows if r[1] > 0 and r[2] > 0 and r[3] > 0]
        want = brute_fill(rows, sum(r[2] for r in live) if total is None else total)
        assert all(got[s].repeat == pytest.approx(want[s], abs=1e-6) for s in want)
        assert all(not r.clamped or r.repeat == r.max_repeat for r in got.values())


def test_mix(spark):
    rows = [(i, f"text number {i} " * (1 + i % 3), [" A", "b", "B ", None, "zzz"][i % 5]) for i in range(2000)] + [(5000, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.7, 3), ("b", 0.2, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeat int")
    chosen, shares = mixing.mix(d, t)
    s = {r.source: r for r in shares.collect()}
    assert s["a"].reached_share == pytest.approx(0.7 / 0.9, abs=0.03) and s["none"].n_tokens_used == 0
    assert chosen.filter("source = 'b' and copies > 1").count() == 0 and chosen.agg(F.max("copies")).first()[0] <= 3
    assert sorted(chosen.collect()) == sorted(mixing.mix(d, t)[0].collect())
    assert (s[None].n_docs, s["zzz"].n_docs, s[None].reached_share, s["zzz"].n_tokens_used) == (400, 400, 0, 0) and s[None].n_tokens_source > 0
    assert sum(r.n_docs for r in s.values()) == 2001  # no document is missing from the report
    assert mixing.mix(d.filter("false"), t)[0].count() == 0 == mixing.mix(d, t.filter("false"))[0].count()


def test_topic_mapping():
    assoc = {"jury": {"law": 0.8, "none": 0.1, "sport": 0.1}, "bench": {"law": 0.5, "none": 0.1, "sport": 0.4}, "kettle": {"law": 0.1, "none": 0.8, "sport": 0.1}}
    base = {"law": 0.2, "sport": 0.2, "none": 0.6}
    assert subjects.map_topic([("jury", 0.6), ("bench", 0.4)], assoc, base) == "law"
    assert subjects.map_topic([("kettle", 0.9), ("bench", 0.1)], assoc, base) is None and subjects.map_topic([], assoc, base) is None


def test_subjects(spark, model, data):
    rng = random.Random(6)
    words = {
        "law": "jury judge verdict lawsuit tribunal appeal barrister plaintiff subpoena witness courtroom bail custody solicitor".split(),
        "sport": "striker goal referee league penalty coach midfielder sprint marathon overtime goalkeeper relay stadium tackle".split(),
        "none": "kettle lamp sofa garden puddle hoodie mirror blanket sandwich toaster window balcony umbrella doorbell".split(),
    }
    rows, labels = [], []
    for i in range(600):
        s = rng.choice(list(words))
        rows.append((i, ". ".join(f"the {a} and the {b} and one {c} again today" for a, b, c in [rng.sample(words[s], 3) for _ in range(2)])))
        labels.append((i, s))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    y = spark.createDataFrame([x for x in labels if x[0] % 4 == 0] + [(None, "law"), (1, None)], "doc_id long, subject string")
    a = spark.createDataFrame([("law", "texts about jury, judge and the like"), ("sport", "texts about striker, goal and the like")], "subject string, description string")
    got, topics = subjects.assign(d, y, a, spark.read.parquet(f"{data}/lang_sample.parquet"))
    got = {(r.doc_id, r.subject) for r in got.collect()}
    want = {(i, s) for i, s in labels if s != "none"}
    assert len(got & want) / len(want) > 0.85 and len(got & want) / max(1, len(got)) > 0.85
    none, _ = subjects.assign(d.filter("false"), y, a, spark.read.parquet(f"{data}/lang_sample.parquet"))
    assert none.count() == 0
    assert subjects.sentences(None, model) == [] and subjects.sentences("", model) == []


def test_subjects_of_many_copies(spark, data):
    rng = random.Random(6)
    words = {
        "law": "jury judge verdict lawsuit tribunal appeal barrister plaintiff subpoena witness courtroom bail custody solicitor".split(),
        "sport": "striker goal referee league penalty coach midfielder sprint marathon overtime goalkeeper relay stadium tackle".split(),
        "none": "kettle lamp sofa garden puddle hoodie mirror blanket sandwich toaster window balcony umbrella doorbell".split(),
    }
    rows, labels = [], []
    for i in range(400):
        s = rng.choice(list(words))
        rows.append((i, ". ".join(f"the {a} and the {b} and one {c} again today" for a, b, c in [rng.sample(words[s], 3) for _ in range(2)])))
        labels.append((i, s))
    copied = "the jury and the judge and one verdict again today. the witness and the barrister and one lawsuit again today"
    rows += [(i, copied) for i in range(1000, 1250)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([x for x in labels if x[0] % 4 == 0], "doc_id long, subject string")
    a = spark.createDataFrame([("law", "texts about jury, judge and the like"), ("sport", "texts about striker, goal and the like")], "subject string, description string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, y, a, spark.read.parquet(f"{data}/lang_sample.parquet"))[0].collect()}
    assert {(i, "law") for i in range(1000, 1250)} <= got and not {(i, "sport") for i in range(1000, 1250)} & got


def test_topic_of_a_frequent_subject():
    assoc = {"jury": {"law": 0.7, "chess": 0.2, "none": 0.1}, "pawn": {"law": 0.1, "chess": 0.8, "none": 0.1}}
    base = {"law": 1 / 3, "chess": 0.08, "none": 0.587}
    assert subjects.map_topic([("jury", 1.0)], assoc, base) == "law"  # chess has the larger lift but a mean of 0.2
    assert subjects.map_topic([("pawn", 1.0)], assoc, base) == "chess"
    even = {"gambit": {"law": 0.54, "chess": 0.46, "none": 0.0}}
    assert subjects.map_topic([("gambit", 1.0)], even, base) == "law"  # the subject with most weight
    assert subjects.map_topic([("jury", 1.0)], {"jury": {"law": 0.3, "chess": 0.3, "none": 0.4}}, base) is None


def test_short_passages_in_long_texts(spark, data):
    rows = sorted((r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_sample.parquet").collect())
    langs = tuple(sorted({x for x, _ in rows}))
    m = langid.fit([(x, langid.words(t)) for i, (x, t) in enumerate(rows) if i % 4], langs)
    held = {x: [langid.words(t) for i, (y, t) in enumerate(rows) if y == x and i % 4 == 0] for x in langs}
    rng = random.Random(1)

    def text(lang, n):
        w = []
        while len(w) < n:
            w += rng.choice(held[lang])
        return w[:n]

    for n in (30, 100, 300):
        hits = 0
        for i in range(60):
            a, b = rng.sample(langs, 2)
            w, at = text(a, n), rng.randrange(5, n - 5)
            assert {s[0] for s in langid.analyse(" ".join(w), m)[2]} == {a}
            mixed = w[:at] + text(b, 4 + i % 3) + w[at:]
            hits += [s[0] for s in langid.analyse(" ".join(mixed), m)[2]] == [a, b, a]
        assert hits >= 40, (n, hits)


def test_every_passage_is_judged(spark):
    insult, report = {"fool": 4.0, "moron": 5.0}, {"reported": -6.0}
    m = toxic.Model({c: insult if c == "abusive" else {} for c in toxic.CATEGORIES}, {c: report if c == "abusive" else {} for c in toxic.CATEGORIES}, {}, {c: 2.0 for c in toxic.CATEGORIES})
    plain_ = "the red kettle was fine today"
    texts = [f"he reported moron here. {plain_}. you fool", f"he reported moron here. {plain_}", "you fool. " + plain_, "you fool. " + plain_ + ". you fool", plain_]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    law = toxic.Law({c: 2.0 for c in toxic.CATEGORIES}, {c: 0.1 for c in toxic.CATEGORIES}, {c: -4.0 for c in toxic.CATEGORIES})
    s = toxic.significance(toxic.scan(d, m), law).filter("category = 'abusive'").cache()
    r = {x.doc_id: x for x in s.collect()}
    assert {x.doc_id for x in toxic.flagged(s, law).collect()} == {0, 2, 3}  # the highest passage of 0 is a report, its insult stands lower
    assert r[0].passage == "fool" and r[1].net < 0 and len(r[3].nets) == 2
    one = 1 - math.exp(-0.1 * r[3].n_tokens * math.exp(-2 * r[3].net))
    assert 0 < r[3].p_value < one and r[2].p_value < 0.05 and r[4].p_value == 1


def test_calibration_decides():
    """Of two texts with one sum, the longer is less significant; a level between them parts them."""
    short, long_ = (toxic.log_p([5.0], n, 1.0, 0.01) for n in (10, 1000))
    assert short < -6 < long_ and toxic.log_p([5.0, 4.8], 10, 1.0, 0.01) < short
    assert toxic.log_p([], 10, 1.0, 0.01) == 0.0 == toxic.log_p([5.0], 0, 1.0, 0.01)
