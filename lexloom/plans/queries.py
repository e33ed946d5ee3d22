"""The registered queries of the core operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions import dates as D
from lexloom.functions import stem as S
from lexloom.functions import text as X
from lexloom.operators import balance as BAL
from lexloom.operators import bayes as B
from lexloom.operators import corpus as C
from lexloom.operators import cotrain as CT
from lexloom.operators import dictionaries as DI
from lexloom.operators import evaluate as E
from lexloom.operators import lexicon as LX
from lexloom.operators import selftrain as ST
from lexloom.operators import temporal as T
from lexloom.plans import data as P
from lexloom.sources import layouts as L
from lexloom.streaming import prequential as PQ

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TAU, LOW = 0.75, 3


def q(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


# ---- corpus -------------------------------------------------------------------------------


@q
def json_basic_stats(spark, d):
    return C.basic_stats(P.table(spark, d, "raw_tweet").select("line"))


@q
def extract_english(spark, d):
    return C.english_records(P.table(spark, d, "raw_tweet").select("line"))


@q
def dedup_by_id(spark, d):
    return C.first_per_key(extract_english(spark, d), "tweet_id", ["screen_name", "created_at", "followers", "friends", "retweets", "favourites", "text"])


@q
def hashtag_join(spark, d):
    return C.with_hashtags(P.table(spark, d, "raw_tweet").select("line_no", "line")).select("line_no", "hashtags")


@q
def fuse_labeled(spark, d):
    long = P.table(spark, d, "tweet_long").select("id", L.label_of(F.col("emotion"), otherwise=None).alias("label"), F.lit("emotion").alias("origin"))
    g = P.table(spark, d, "tweet_gold").select("id", L.label01(F.col("label")).alias("label"), F.lit("gold").alias("origin"))
    return L.fuse(long, g).filter("label is not null").groupBy("origin", "label").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def _long(spark, d):
    return P.table(spark, d, "tweet_long")


@q
def crop_sentiment(spark, d):
    return C.crop(_long(spark, d), ["positive", "negative"]).select("id", "created_at", "hashtags", "text", "retweet_flag", "emotion", "emoticons", "unigrams")


@q
def crop_neutral(spark, d):
    return C.crop(_long(spark, d), ["neutral"]).select("id", "created_at", "hashtags", "text", "retweet_flag", "emotion", "unigrams")


@q
def crop_no_retweet(spark, d):
    return C.crop(_long(spark, d), ["positive", "negative"], True).select("id", "emotion", "unigrams")


@q
def remove_low_freq(spark, d):
    return C.remove_low_freq(P.docs(spark, d), "id", "unigrams", LOW)


@q
def min_tokens(spark, d):
    return C.min_tokens(_long(spark, d), X.tokens(F.col("unigrams"))).select("id", "unigrams")


@q
def entity_mentions(spark, d):
    return C.entity_mentions(_long(spark, d), "text", K.ENTITIES, ["id", "created_at", "unigrams"])


@q
def word_count(spark, d):
    _, cleaned = X.preprocess(F.col("text"), P.slang_map(spark, d), counting_only=True)
    return C.word_count(_long(spark, d), cleaned)


@q
def pos_neg_dictionary(spark, d):
    return C.pos_neg_dictionary(_long(spark, d))


# ---- text ---------------------------------------------------------------------------------


def _text(name, make):
    def f(spark, d):
        return _long(spark, d).select("id", make(spark, d).alias("out"))

    f.__name__ = name
    q(f)


for _name, _make in {
    "normalize_ws": lambda s, d: X.normalize_ws(F.col("text")),
    "slang_replace": lambda s, d: X.slang_replace(F.lower(F.col("text")), P.slang_map(s, d)),
    "clear_text": lambda s, d: X.clear_text(F.col("text")),
    "drop_mentions": lambda s, d: X.drop_mentions(F.col("text")),
    "squeeze_repeats": lambda s, d: X.squeeze_repeats(F.lower(F.col("text"))),
    "negate_verbs": lambda s, d: X.negate_verbs(F.lower(F.col("text"))),
    "negate_adjectives": lambda s, d: X.negate_adjectives(F.lower(F.col("text"))),
    "strip_non_ascii": lambda s, d: X.strip_non_ascii(F.col("text")),
    "drop_short_words": lambda s, d: X.drop_short_words(X.strip_non_ascii(F.col("text"))),
    "letters_only": lambda s, d: X.letters_only(F.col("text")),
    "remove_stopwords": lambda s, d: X.remove_stopwords(F.lower(F.col("text"))),
    "bigrams": lambda s, d: F.array_join(X.bigrams(X.tokens(F.col("unigrams"))), " "),
}.items():
    _text(_name, _make)


def _lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def _joined(name, table, word, value, make, lower=True):
    """The same functions with dictionaries that are joined, read as the lines of their files."""

    def f(spark, d):
        t = _long(spark, d).select("id", (F.lower("text") if lower else F.col("text")).alias("text"))
        return DI.with_entries(t, "text", table(spark, d), word, value, "own").select("id", make(F.col("text"), F.col("own")).alias("out"))

    f.__name__ = name
    q(f)


_joined("slang_replace_joined", lambda s, d: P.table(s, d, "slang").withColumn("replacement", F.regexp_replace("replacement", "  +", " ")), "term", "replacement", X.slang_replace)
_joined("remove_stopwords_joined", lambda s, d: L.term_list(_lines(s, K.STOPWORDS)), "word", None, X.remove_stopwords)
_joined("negate_verbs_joined", lambda s, d: L.term_list(_lines(s, K.VERBS)), "word", None, X.negate_verbs)
_joined("negate_adjectives_joined", lambda s, d: L.antonym_table(_lines(s, [f"{a},{b}" for a, b in K.ANTONYMS])), "word", "antonym", X.negate_adjectives)
_text("commas_to_blanks", lambda s, d: X.commas_to_blanks(F.col("text")))


@q
def emoticon_counts_long(spark, d):
    t = F.col("text")
    return _long(spark, d).select("id", F.size(X.happy(t, K.HAPPY_LONG)).alias("n_happy"), F.size(X.sad(t, K.SAD_LONG)).alias("n_sad"))


@q
def emoticon_counts(spark, d):
    t = F.col("text")
    return _long(spark, d).select("id", F.size(X.happy(t)).alias("n_happy"), F.size(X.sad(t)).alias("n_sad"), F.array_join(X.happy(t), " ").alias("happy"), F.array_join(X.sad(t), " ").alias("sad"))


@q
def emotion_label(spark, d):
    t = F.col("text")
    return _long(spark, d).select("id", X.emotion(F.size(X.happy(t)), F.size(X.sad(t))).alias("emotion"))


@q
def preprocess_text(spark, d):
    """The chain over EXTRACT-like rows (id, text): one row per id, emotions positive, negative, neutral only."""
    marked, cleaned = X.preprocess(F.col("text"), P.slang_map(spark, d))
    rows = _long(spark, d).select("id", "text", marked.alias("m"), cleaned.alias("cleaned"))
    rows = rows.select("id", F.size(X.happy(F.col("m"))).alias("h"), F.size(X.sad(F.col("m"))).alias("s"), "cleaned").select("id", X.emotion(F.col("h"), F.col("s")).alias("emotion"), "cleaned")
    return C.first_per_key(rows.filter(F.col("emotion").isin("positive", "negative", "neutral")), "id", ["emotion", "cleaned"])


@q
def stem_tokens(spark, d):
    return _long(spark, d).select("id", F.array_join(S.stem_tokens(X.tokens(F.col("unigrams"))), " ").alias("out"))


@q
def event_windows(spark, d):
    """Tumbling one-day counts; the same function runs on a stream."""
    return PQ.windowed_counts(P.table(spark, d, "events"), "ts", "event_type", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# ---- lexicon ------------------------------------------------------------------------------


def _lexicon(spark, d):
    lx = LX.load_lexicon(P.table(spark, d, "sentiwordnet"))
    return lx, LX.tags_from_lexicon(lx)


@q
def lexicon_load(spark, d):
    return _lexicon(spark, d)[0].select("lemma", "pos", r6("score"))


@q
def pos_class(spark, d):
    lx, tags = _lexicon(spark, d)
    return tags.select("word", "tag", LX.pos_class(F.col("tag")).alias("pos"))


def _scored(spark, d, contextual=False):
    lx, tags = _lexicon(spark, d)
    return LX.score(P.docs(spark, d), "id", "unigrams", lx, tags, ["emotion", "created_at"], contextual)


@q
def lexicon_score(spark, d):
    return _scored(spark, d).select("id", r6("score"))


@q
def lexicon_score_in_context(spark, d):
    lx, tags = _lexicon(spark, d)
    return LX.score(P.docs(spark, d).withColumn("text", F.lower("text")), "id", "text", lx, tags, [], True).select("id", r6("score"))


@q
def lexicon_confusion(spark, d):
    s = _scored(spark, d)
    k = LX.confusion_key(LX.sign(F.col("score")), F.col("emotion"))
    return s.select(k.alias("category")).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@q
def lexicon_agree(spark, d):
    return _scored(spark, d).filter(LX.agrees(LX.sign(F.col("score")), F.col("emotion"))).select("id", "emotion", r6("score"))


@q
def lexicon_agree_stemmed(spark, d):
    """The agreement rows with their text stemmed (no SQL: the stemmer is tested against published stems)."""
    lx, tags = _lexicon(spark, d)
    s = LX.score(P.docs(spark, d), "id", "unigrams", lx, tags, ["unigrams", "emotion"])
    return s.filter(LX.agrees(LX.sign(F.col("score")), F.col("emotion"))).select("id", "emotion", r6("score"), F.array_join(S.stem_tokens(X.tokens(F.col("unigrams"))), " ").alias("stemmed"))


@q
def entity_sentiment_ts(spark, d):
    lx, tags = _lexicon(spark, d)
    s = LX.score(P.docs(spark, d), "id", "unigrams", lx, tags, ["unigrams", "emotion", "created_at"])
    s = s.withColumn("ms", D.epoch_ms(F.col("created_at")))
    return LX.entity_series(s, "unigrams", "ms", K.ENTITIES)


# ---- features and classifier --------------------------------------------------------------


def _freq(view):
    def f(spark, d):
        return P.docs(spark, d).select("id", F.explode(view).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))

    return f


Q["term_freq"], Q["bigram_freq"] = _freq("uni"), _freq("bi")


@q
def nb_train(spark, d):
    return B.parameters(B.train(P.roles(spark, d)[0], "uni")).select("token", "label", r6("theta"))


def _posterior(spark, d, tok="uni", v=B.UNI):
    train, _, test = P.roles(spark, d)
    return B.score(test, B.train(train, tok), tok, "id", ("label",), v)


@q
def nb_predict(spark, d):
    return _posterior(spark, d).select("id", "label", "pred")


@q
def nb_posterior(spark, d):
    return _posterior(spark, d).select("id", r6("raw0"), r6("raw1"), r6("p1"))


@q
def nb_hashed_agreement(spark, d):
    """The hashed pipeline against the relational model on the test rows (no SQL: hashing is the library's own)."""
    train, _, test = P.roles(spark, d)
    hashed = B.fit_hashed(train.select("uni", "label"), "uni").transform(test.select("id", "uni")).select("id", F.col("prediction").cast("int").alias("hashed"))
    return hashed.join(_posterior(spark, d).select("id", "pred"), "id").agg(F.count("*").alias("n"), F.count_if(F.col("hashed") == F.col("pred")).alias("n_agree"))


@q
def nb_label_counts(spark, d):
    train, pool, _ = P.roles(spark, d)
    return B.score(pool, B.train(train, "uni"), "uni", "id").groupBy("pred").agg(F.count("*").alias("n"))


@q
def nb_random_baseline(spark, d):
    train, pool, test = P.roles(spark, d)
    m = ST.growth(ST.coin_labels(train), pool, "uni")
    return E.accuracy(B.score(test, m, "uni", "id", ("label",))).select("n", r6("accuracy"))


# ---- self-training ------------------------------------------------------------------------


@q
def self_train_round(spark, d):
    train, pool, _ = P.roles(spark, d)
    return ST.round_(train, pool, "uni", tau=TAU).select("id", r6("p1"), "pred", "is_high")


@q
def self_train_loop(spark, d):
    train, pool, _ = P.roles(spark, d, once=True)
    return ST.loop(train, pool, "uni", tau=TAU)[1].select("id", "label", r6("p1"), "round")


@q
def self_train_growth(spark, d):
    train, pool, test = P.roles(spark, d, once=True)
    return B.score(test, ST.growth(train, pool, "uni"), "uni", "id", ("label",)).select("id", "label", "pred", r6("p1"))


@q
def self_train_transductive(spark, d):
    """The pool is the test set itself: label counts before and after retraining."""
    train, _, test = P.roles(spark, d, once=True)
    m = B.train(train, "uni")
    before = B.score(test, m, "uni", "id").select("id", F.col("pred").alias("before"))
    after = B.score(test, ST.growth(train, test.drop("label"), "uni"), "uni", "id").select("id", F.col("pred").alias("after"))
    return before.join(after, "id").groupBy("before", "after").agg(F.count("*").alias("n"))


@q
def label_counts(spark, d):
    return E.label_counts(P.docs(spark, d))


@q
def validate_pseudo_labels(spark, d):
    """Accuracy on gold of the model of the training set and the confident pool rows."""
    train, pool, test = P.roles(spark, d)
    high = ST.round_(train, pool, "uni", tau=TAU).filter("is_high").select("id", F.col("pred").alias("label"))
    fused = L.fuse(train, pool.drop("label").join(high, "id"))
    return E.accuracy(B.score(test, B.train(fused, "uni"), "uni", "id", ("label",))).select("n", r6("accuracy"))


@q
def sample_per_class(spark, d):
    train, pool, _ = P.roles(spark, d)
    s = B.score(pool, B.train(train, "uni"), "uni", "id").select("id", "pred")
    return C.sample_per_class(s, "pred", ["id"], 100).select("id", "pred", "rn")


@q
def split_audit(spark, d):
    return E.split_audit(Q["self_train_round"](spark, d))


# ---- co-training --------------------------------------------------------------------------


@q
def co_train_round(spark, d):
    train, pool, _ = P.roles(spark, d, once=True)
    return CT.round_(train, train, pool, pool, TAU).select("view", "id", r6("p1"), "pred", "is_high")


@q
def co_train_loop(spark, d):
    train, pool, _ = P.roles(spark, d, once=True)
    return CT.loop(train, pool, TAU)[2]


@q
def co_train_accuracy(spark, d):
    train, pool, test = P.roles(spark, d, once=True)
    return CT.accuracy_by_step(train, pool, test, TAU).select("step", "view", "n", r6("accuracy"))


@q
def co_train_growth(spark, d):
    train, pool, test = P.roles(spark, d, once=True)
    m0, m1, _ = CT.exchange(train, pool)
    a = B.score(test, m0, "uni", "id", ("label",)).select("id", "label", F.col("pred").alias("uni_pred"))
    b = B.score(test, m1, "bi", "id", v=B.BI).select("id", F.col("pred").alias("bi_pred"))
    return a.join(b, "id")


@q
def co_train_label_counts(spark, d):
    train, pool, _ = P.roles(spark, d, once=True)
    return CT.exchange(train, pool)[2].groupBy("uni_label", "bi_label").agg(F.count("*").alias("n"))


@q
def co_train_holdout(spark, d):
    train, pool, test = P.roles(spark, d, once=True)
    return B.score(test, CT.holdout(train, pool), "uni", "id", ("label",)).select("id", "label", "pred", r6("p1"))


# ---- balance ------------------------------------------------------------------------------


def _train(spark, d):
    return P.roles(spark, d)[0].select("id", "label", "uni")


@q
def imbalance_distance(spark, d):
    return BAL.imbalance(_train(spark, d)).select("p", "n", r6("distance"), "augment")


@q
def undersample(spark, d):
    return BAL.undersample(_train(spark, d).select("id", "label"))


@q
def oversample(spark, d):
    return BAL.oversample(_train(spark, d).select("id", "label"))


@q
def resample_both(spark, d):
    return BAL.resample_both(_train(spark, d).select("id", "label"))


def _lemmas(spark, d):
    return LX.sentiment_lemmas(LX.load_lexicon(P.table(spark, d, "sentiwordnet")))


def _synonyms(spark):
    return L.synonym_table(_lines(spark, ["\t".join([w, *ns]) for w, ns in K.SYNONYMS.items()]))


@q
def blankout(spark, d):
    return BAL.blankout(_train(spark, d), _lemmas(spark, d)).select("id", "copy", F.array_join("uni", " ").alias("unigrams"))


@q
def synonym_augment(spark, d):
    return BAL.synonyms(_train(spark, d), _synonyms(spark)).select("id", "copy", F.array_join("uni", " ").alias("unigrams"))


def _balanced(name, how, prepare=lambda train: train):
    """Augment, then one round of self-training; the gate lets a balanced set pass unchanged."""

    def f(spark, d):
        train, pool, _ = P.roles(spark, d)
        train = prepare(train.select("id", "label", "uni"))
        fused = BAL.augment(train, how, _lemmas(spark, d), _synonyms(spark)).drop("copy")
        return ST.round_(fused, pool, "uni", tau=TAU).select("id", r6("p1"), "pred", "is_high")

    f.__name__ = name
    q(f)


_balanced("balanced_self_train", "blankout")
_balanced("balanced_self_train_embeddings", "embeddings")
_balanced("balanced_self_train_sampling", "sampling")
_balanced("balanced_self_train_pass_through", "blankout", BAL.undersample)


# ---- time ---------------------------------------------------------------------------------
# Test relation: hold-out (the gold set), prequential (the training stream), or both streams together.
TEMPORAL = {
    "temporal_single": ("single", "holdout"), "temporal_cumulative": ("cumulative", "holdout"), "temporal_sliding": ("sliding", "holdout"), "temporal_holdout": ("cumulative", "holdout"),
    "temporal_prequential": ("cumulative", "prequential"), "temporal_prequential_single": ("single", "prequential"), "temporal_prequential_sliding": ("sliding", "prequential"), "temporal_prequential_union": ("cumulative", "union"),
}
TEMPORAL_LU = {
    "temporal_self_train": ("cumulative", "holdout"), "temporal_self_train_single": ("single", "holdout"), "temporal_self_train_sliding": ("sliding", "holdout"),
    "temporal_self_train_prequential": ("single", "prequential"), "temporal_self_train_prequential_cumulative": ("cumulative", "prequential"), "temporal_self_train_prequential_sliding": ("sliding", "prequential"),
}
TEMPORAL_CO = {
    "temporal_co_train": ("sliding", "holdout"), "temporal_co_train_single": ("single", "holdout"), "temporal_co_train_cumulative": ("cumulative", "holdout"),
    "temporal_co_train_prequential": ("single", "prequential"), "temporal_co_train_prequential_cumulative": ("cumulative", "union"), "temporal_co_train_prequential_sliding": ("sliding", "prequential"),
    "temporal_co_train_sliding_single_pool": ("sliding/single", "prequential"),
}


def _temporal(name, kind, protocol, make):
    def f(spark, d):
        train, pool, test = P.roles(spark, d, once=True)
        if protocol == "union":
            train = train.unionByName(test)
        kind_, _, pool_kind = kind.partition("/")
        ps = T.periods(spark, kind_)
        return make(train, pool, test if protocol == "holdout" else train, ps, T.periods(spark, pool_kind) if pool_kind else None)

    f.__name__ = name
    q(f)


def _acc(df):
    return df.select("period", "n_test", r6("accuracy"))


for _n, (_k, _p) in TEMPORAL.items():
    _temporal(_n, _k, _p, lambda tr, po, te, ps, pp: _acc(T.evaluate(tr, te, ps)))
for _n, (_k, _p) in TEMPORAL_LU.items():
    _temporal(_n, _k, _p, lambda tr, po, te, ps, pp: _acc(T.self_train(tr, po, te, ps, pool_ps=pp)))
for _n, (_k, _p) in TEMPORAL_CO.items():
    _temporal(_n, _k, _p, lambda tr, po, te, ps, pp: T.co_train(tr, po, te, ps, pool_ps=pp).select("period", "n_test", r6("uni_accuracy"), r6("bi_accuracy")))


# ---- evaluation ---------------------------------------------------------------------------


@q
def predict_export(spark, d):
    return Q["nb_predict"](spark, d).select("id", F.col("label").alias("gold"), "pred")


@q
def accuracy(spark, d):
    return E.accuracy(Q["nb_predict"](spark, d)).select("n", r6("accuracy"))


@q
def confusion_matrix(spark, d):
    return E.confusion(Q["nb_predict"](spark, d))


@q
def f1_by_label(spark, d):
    return E.f1_by_label(Q["nb_predict"](spark, d)).select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@q
def weighted_f1(spark, d):
    return E.weighted_f1(Q["nb_predict"](spark, d)).select(r6("weighted_f1"))


@q
def au_prc(spark, d):
    return E.au_prc(Q["nb_predict"](spark, d)).select(r6("au_prc"))


@q
def co_validate(spark, d):
    """Confusion of both views after a confident exchange: each is trained on gold and the other's HIGH rows."""
    train, pool, test = P.roles(spark, d, once=True)
    high = CT.round_(train, train, pool, pool, TAU).filter("is_high")
    out = []
    for view, tok, v in ((0, "uni", B.UNI), (1, "bi", B.BI)):
        lab = pool.select("id", tok).join(high.filter(F.col("view") == 1 - view).select("id", F.col("pred").alias("label")), "id")
        m = B.add(B.train(train, tok), B.train(lab, tok))
        out.append(E.confusion(B.score(test, m, tok, "id", ("label",), v)).withColumn("view", F.lit("unigrams" if view == 0 else "bigrams")))
    return out[0].unionByName(out[1])
