"""Subject area of each document (problem 10): topic models mapped to subjects.

Documents are cut into sentences, and each sentence gets its language by the
n-gram likelihoods of ``langid``. Per language a latent Dirichlet topic model is
fitted on the distinct texts with Spark's distributed online optimiser, so copies
neither weigh on the topics nor on what is counted as frequent; the subjects are
joined back to every copy. The top terms
of each topic are inspected: every term votes for the subjects it goes with in
the hand-labelled documents and in the subject descriptions, and a topic is
mapped to the subject with most weight if that is clear, else to none. Sentences
are then inferred on their own, the proportions of a subject's topics are added
up, and a document gets the subjects that hold enough of one of its sentences;
both thresholds are those that agree best with the labels, a language's own ones and, with the weight
of ``PRIOR`` of them, those of all languages.

The tokens are written once, a folder per language, so that each fit and each inference reads its own
language only. All rules are the same at every size: a language of any size gets a model of
``TOPICS`` topics a subject, but no more than one for ``DOCS_PER_TOPIC`` texts, fitted in ``ROUNDS`` rounds over
``BATCH`` texts or ``PASSES / ROUNDS`` of all, whichever is more, so each text is drawn ``PASSES`` times on average
or more. A model has the ``MAX_VOCAB`` most frequent terms of a language; the others stand in fewer
documents than these and are no evidence.

NULL and empty texts have no subject, nor have those of a language without a word in ``LEAST_DF``
documents. Hashtags, mentions and links are no evidence.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm import langid
from lexloom.session import cut, shared_dir

MAX_VOCAB, TOP_TERMS, LEAST_DF = 20_000, 40, 3
TOPICS, DOCS_PER_TOPIC, PARALLEL = 5, 2, 3
ROUNDS, BATCH, PASSES = 40, 2_000, 3
TASK = 4_000  #: least texts in a task of a fit
FILE_ROWS = 2_500  #: most rows of a file of words, so that inference, which costs much more than reading, is spread over the cores
PRIOR = 40.0  #: labels that the thresholds of all languages weigh in those of one
CLEAR = 0.45  #: least mean association of a topic's terms with its subject
SUPPORT, PURE = 6, 0.45  #: a word seen in SUPPORT labelled documents must go with one subject (or none) in this share of them
_END = re.compile(r"(?<=[.!?…])[\s]+|\n+| - | / ")


def sentences(text: str | None, m: langid.Model) -> list[dict]:
    """(lang, words) of each sentence; a sentence under four words has the language of the text."""
    if not text:
        return []
    parts = [w for w in (langid.words(p) for p in _END.split(text)) if w]
    if not parts:
        return []
    whole = m.langs[int(m.matrix([w for p in parts for w in p]).sum(axis=0).argmax())]
    out = []
    for p in parts:
        ll = m.matrix(p).sum(axis=0)
        out.append({"lang": m.langs[int(ll.argmax())] if len(p) >= langid.LEAST_WORDS else whole, "words": p})
    return out


def with_sentences(docs: DataFrame, m: langid.Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    @F.pandas_udf("array<struct<lang:string,words:array<string>>>")
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentences(t, m))

    return docs.select(key, *carry, udf(F.col(text)).alias("sents"))


def by_language(sents: DataFrame, key: str) -> DataFrame:
    """(key, copies, sents: words of each sentence, lang), a row per text and language, written once in a folder per language."""
    spark = sents.sparkSession
    path = f"{shared_dir(spark)}/topic-words-{uuid.uuid4().hex}"
    d = sents.select(key, "copies", "sents", F.explode(F.array_distinct("sents.lang")).alias("lang"))
    own = F.transform(F.filter("sents", lambda s: s["lang"] == F.col("lang")), lambda s: s["words"])
    d.select(key, "copies", own.alias("sents"), "lang").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("lang").parquet(path)
    schema = f"{key} {sents.schema[key].dataType.simpleString()}, copies long, sents array<array<string>>, lang string"
    return spark.read.schema(schema).parquet(path)


@dataclass
class Topics:
    lang: str
    vocab: list[str]
    model: LDAModel
    subject: list[str | None]  #: of each topic
    terms: list[list[str]]  #: top terms of each topic


def label_counts(words: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(lang, word, subject, n): labelled documents with the word, a document with several subjects shared among them."""
    y = labels.filter("subject is not null").select(key, F.lower(F.trim("subject")).alias("subject")).distinct()
    y = y.join(y.groupBy(key).agg(F.count("*").alias("m")), key).select(key, "subject", (1 / F.col("m")).alias("w"))
    d = words.join(y, key).select("lang", "subject", "w", F.explode(F.array_distinct(F.flatten("sents"))).alias("word"))
    return d.groupBy("lang", "word", "subject").agg(F.sum("w").alias("n"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(lang, word, df, texts) of the words used for topics, those that are not rare; ``words`` has a row per distinct text and language and its ``copies``.

    df and texts count distinct texts. What LEAST_DF asks is asked of all documents, so merging copies loses no word.
    """
    t = words.select("lang", "copies", F.array_distinct(F.flatten("sents")).alias("w"))
    n = t.groupBy("lang").agg(F.count("*").alias("texts"))
    df = t.select("lang", "copies", F.explode("w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("df"), F.sum("copies").alias("in_docs"))
    fit_ = df.filter((F.col("in_docs") >= LEAST_DF) & (F.length("word") > 1)).drop("in_docs").join(F.broadcast(n), "lang")  # n: a row per language
    # the rank limit is applied before the shuffle
    return fit_.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("df"), "word"))).filter(F.col("r") <= MAX_VOCAB).drop("r")


def association(counts: dict[tuple[str, str], float], totals: dict[str, float], described: dict[str, set[str]], words: list[str]) -> dict[str, dict[str, float]]:
    """P(subject | word) for each word, smoothed towards the subjects' shares; description words count like a few labelled documents."""
    n = sum(totals.values()) or 1.0
    subjects = sorted(set(totals) | set(described))
    base = {s: (totals.get(s, 0.0) + 1.0) / (n + len(subjects)) for s in subjects}
    out = {}
    for w in words:
        c = {s: counts.get((w, s), 0.0) + (3.0 if w in described.get(s, ()) else 0.0) for s in subjects}
        z = sum(c.values())
        out[w] = {s: (c[s] + 0.5 * base[s]) / (z + 0.5) for s in subjects}
    return out


def map_topic(terms: list[tuple[str, float]], assoc: dict[str, dict[str, float]], base: dict[str, float], evidence: float = 1e9, clear: float = 1.6) -> str | None:
    """Subject of a topic from its top terms (term, weight): the largest mean association of those that are clear.

    The mean must reach CLEAR and ``clear`` times the subject's share; the less the labels know of the terms (``evidence``: labelled documents summed over them), the
    more they pull every mean to the subjects' shares, so down to a quarter less is asked.
    """
    z = sum(w for _, w in terms) or 1.0
    mean: dict[str, float] = defaultdict(float)
    for t, w in terms:
        for s, p in assoc[t].items():
            mean[s] += w / z * p
    if not mean:
        return None
    least = max(CLEAR * (1 - 0.25 * 100 / (100 + evidence)), mean.get("none", 0.0))
    return max((s for s, v in mean.items() if s != "none" and v >= least and v / base[s] >= clear), key=lambda s: mean[s], default=None)


def fit(words: DataFrame, labels: DataFrame, areas: DataFrame, seed: int = 11, key: str = "doc_id") -> list[Topics]:
    """A topic model for each language of ``words`` (see ``by_language``), its topics mapped to the subjects of ``areas``."""
    names = {r.subject.strip().lower(): set(re.findall(r"\w+", (r.description or "").lower())) for r in areas.filter("subject is not null").collect()}  # the list of subjects, which a model has topics for
    usual = set.intersection(*names.values()) if len(names) > 1 else set()
    described = {s: d - usual for s, d in names.items()}
    vocab = defaultdict(list)
    n_texts: dict[str, int] = {}
    terms = cut(vocabulary(words))
    v = terms.orderBy("lang", F.desc("df"), "word").toArrow().to_pydict()  # at most MAX_VOCAB rows a language
    for lang, word, texts in zip(v["lang"], v["word"], v["texts"]):
        n_texts[lang] = texts
        vocab[lang].append(word)
    counts: dict[str, dict[tuple[str, str], float]] = defaultdict(dict)
    v = label_counts(words, labels, key).join(terms.select("lang", "word"), ["lang", "word"], "left_semi").toArrow().to_pydict()  # at most a row per term and subject
    for lang, word, subject, x in zip(v["lang"], v["word"], v["subject"], v["n"]):
        counts[lang][word, subject] = x
    totals = {r.subject: float(r.n) for r in labels.filter("subject is not null").groupBy(F.lower(F.trim("subject")).alias("subject")).agg(F.count("*").alias("n")).collect()}
    subjects = sorted(set(totals) | set(names))
    n = sum(totals.values())
    base = {s: (totals.get(s, 0.0) + 1.0) / (n + len(subjects)) for s in subjects}

    def one(lang: str) -> Topics:
        assoc = association(counts[lang], totals, described, vocab[lang])
        support: dict[str, float] = defaultdict(float)
        for (w, _), c in counts[lang].items():
            support[w] += c
        # words that go with every subject alike say nothing: template words, function words
        known_ = [w for w in vocab[lang] if support[w] < SUPPORT or max(assoc[w].values()) >= PURE] or vocab[lang]
        k = max(2, min(TOPICS * max(1, len(names)), n_texts[lang] // DOCS_PER_TOPIC))
        cv = CountVectorizerModel.from_vocabulary(known_, inputCol="w", outputCol="v")
        x = cv.transform(words.filter(F.col("lang") == lang).select(F.flatten("sents").alias("w"))).select("v").coalesce(max(1, n_texts[lang] // TASK)).persist()  # each round is a job of its own
        rate = min(1.0, max(PASSES / ROUNDS, BATCH / n_texts[lang]))
        lda = LDA(k=k, maxIter=ROUNDS, optimizer="online", subsamplingRate=rate, featuresCol="v", docConcentration=[0.05] * k, topicConcentration=0.02, learningOffset=16.0, seed=seed)
        m = lda.fit(x)
        x.unpersist()
        tops = [[(known_[i], w) for i, w in zip(r.termIndices, r.termWeights)] for r in m.describeTopics(TOP_TERMS).orderBy("topic").collect()]
        known = {w: support[w] + 3.0 * any(w in d for d in described.values()) for w in known_}
        votes = [[(w, x * known[w] / (known[w] + 1.0)) for w, x in t] for t in tops]  # a term the labels hardly know hardly votes
        return Topics(lang, known_, m, [map_topic(t, assoc, base, sum(known[w] for w, _ in t)) for t in votes], [[w for w, _ in t[:15]] for t in tops])

    with ThreadPoolExecutor(PARALLEL) as pool:  # the fits are many short jobs, which leave cores idle one after the other
        return list(pool.map(one, sorted(vocab)))


def infer(words: DataFrame, topics: list[Topics], key: str = "doc_id") -> DataFrame:
    """(key, sent_no, lang, n_words, subject, share): share of a sentence's mixture that a subject's topics hold."""
    parts = []
    rows = words.select(key, "lang", F.posexplode("sents").alias("sent_no", "w"))
    for t in topics:
        names = sorted({s for s in t.subject if s})
        if not names:
            continue
        cv = CountVectorizerModel.from_vocabulary(t.vocab, inputCol="w", outputCol="features")
        t.model.setFeaturesCol("features")
        d = t.model.transform(cv.transform(rows.filter(F.col("lang") == t.lang))).select(key, "sent_no", vector_to_array("topicDistribution").alias("p"), F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("n_words"))
        shares = F.array(*[F.struct(F.lit(s).alias("subject"), sum((F.get("p", F.lit(i)) for i, x in enumerate(t.subject) if x == s), F.lit(0.0)).alias("share")) for s in names])
        parts.append(d.filter("n_words > 0").select(key, "sent_no", F.lit(t.lang).alias("lang"), "n_words", F.inline(F.filter(shares, lambda x: x["share"] > 0.2))))
    if not parts:
        return rows.select(key, "sent_no", "lang", F.lit(0.0).alias("n_words"), F.lit("").alias("subject"), F.lit(0.0).alias("share")).filter("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GRID = [(a, b) for a in (0.25, 0.35, 0.45, 0.55, 0.65) for b in (0.3, 0.45, 0.6, 0.8, 1.0, 1.5, 2.0, 2.5, 3.0)]
LEVELS = sorted({a for a, _ in GRID})


def choose(scored: DataFrame, words: DataFrame, labels: DataFrame, key: str = "doc_id") -> dict[str, tuple[float, float]]:
    """(least share, least words) of each language with the best F1 against the labels of the documents that use it.

    One pass of conditional counts over all labelled documents. To a language's counts those of all
    languages are added with the weight of PRIOR labels; ``""`` has the thresholds for all of them.
    """
    y = labels.filter("subject is not null").select(key, F.lower(F.trim("subject")).alias("subject")).distinct().filter("subject <> 'none'")
    seen = labels.filter("subject is not null").select(key).distinct()
    e = scored.join(seen, key, "left_semi").groupBy(key, "lang", "subject").agg(*[F.max(F.when(F.col("share") >= a, F.col("share") * F.col("n_words"))).alias(f"e{i}") for i, a in enumerate(LEVELS)])
    j = e.join(y.withColumn("yes", F.lit(True)), [key, "subject"], "left")
    aggs = [f(F.col(f"e{LEVELS.index(a)}") >= b).alias(f"{n}{i}") for i, (a, b) in enumerate(GRID) for n, f in (("g", F.count_if), ("t", lambda c: F.count_if(c & F.col("yes"))))]
    rows = {r.lang: r for r in j.groupBy("lang").agg(*aggs).collect()}
    total = {r.lang: r.n for r in words.select(key, "lang").join(y, key).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(set(rows) | set(total))
    got = {x: [rows[x][f"g{i}"] if x in rows else 0 for i in range(len(GRID))] for x in langs}
    true = {x: [rows[x][f"t{i}"] if x in rows else 0 for i in range(len(GRID))] for x in langs}
    everywhere = max(1, sum(total.values()))

    def top(x: str | None) -> tuple[float, float]:
        w = PRIOR / everywhere if x else 1.0
        f1 = []
        for i in range(len(GRID)):
            g, t, n = (w * sum(c[z][i] for z in langs) + (c[x][i] if x else 0) for c in (got, true, {z: [total.get(z, 0)] * len(GRID) for z in langs}))
            f1.append(2 * t / max(1e-9, g + n))
        return GRID[max(range(len(GRID)), key=lambda i: (f1[i], -i))]

    return {"": top(None)} | {x: top(x) for x in langs}


def assign(docs: DataFrame, labels: DataFrame, areas: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Topics]]:
    """(key, subject, share, n_words) of every document's subjects, and the models."""
    m = langid.train(samples)
    tid = F.unhex(F.md5(text))
    ids = docs.filter(F.col(text).isNotNull()).select(key, tid.alias("__t"))
    texts = docs.filter(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("copies")).withColumn("__t", tid)
    words = by_language(with_sentences(texts, m, "__t", text, ("copies",)), "__t")
    labels = cut(labels.filter("subject is not null").join(ids, key).select("__t", F.lower(F.trim("subject")).alias("subject")).distinct())
    topics = fit(words, labels, areas, key="__t")
    scored = cut(infer(words, topics, "__t"))
    at = choose(scored, words, labels, "__t")
    pick = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in at.items() for x in (k, v[i])]), F.col("lang")), F.lit(at[""][i]))
    hit = scored.filter((F.col("share") >= pick(0)) & (F.col("share") * F.col("n_words") >= pick(1)))
    found = hit.groupBy("__t", "subject").agg(F.max("share").alias("share"), F.sum("n_words").alias("n_words"))
    return ids.distinct().join(found, "__t").select(key, "subject", "share", "n_words"), topics


def composition(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """Per subject the number of documents and their share of all documents."""
    n = docs.agg(F.count("*")).scalar()
    return assigned.groupBy("subject").agg(F.count("*").alias("n_docs")).withColumn("share", F.try_divide("n_docs", n))
