"""Abusive, hateful or sexual content (problem 7): maximum-scoring segments of token log-odds.

Fit, on a bounded sample of the labelled documents: for each category, log-odds
of n-grams between positive and other documents, with a Dirichlet prior whose
shares are the n-gram's frequencies in all documents; each value is pulled to 0
by its standard error. As a label belongs to a whole document and the offence to
a passage, the fit alternates: find the best segment of each positive document,
take these segments (weighted by how clearly they stand out) as the positive
side, and fit again. A second set of log-odds compares the surroundings of
segments found in positive and in other documents, so reporting or harmless uses
of the same words lose.

Scan, over all documents and whole texts: one linear pass gives all maximal
scoring segments (Ruzzo and Tompa, 1999), each judged with its own surroundings. The sums are calibrated by an extreme
value law (Karlin and Altschul, 1990): the decay rate solves sum p(s) exp(rate s) = 1
over the histogram of token scores of all documents, and the factor comes from the
number of ordinary documents whose best segment reaches a sum. The p-value of a document is that of the sum
statistic (Karlin and Altschul, 1993) of all its significant segments, so length and number of passages count. A
document is reported if its p-value is under a level: that which agrees best with the
labelled texts, scored with weights fitted on other folds.

NULL and empty texts score 0. Rows with NULL category are no vote.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.pii import plain
from lexloom.session import cut

CATEGORIES = ("abusive", "hateful", "sexual")
SAMPLE = 20_000  #: most labelled documents used for the fit
DRIFT, BREAK, REACH = 0.6, 2.0, 6
FOLDS, SUPPORT, GATE, BINS = 5, 2, 1.0, 5
_TOKEN = re.compile(r"https?://\S+|[#@]\w+|[^\W_][\w'*$@!]*[\w*]|[$*\w]\w[\w*$@]*|\w|[.!?\n]+|[^\x00-\x7f\w\s]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")  # l e t t e r s
_LONG = re.compile(r"([^\W\d_])\1{2,}")  # looong
_LEET = str.maketrans("$@1034578", "sai" + "oeastb")
STOP = "</s>"
ALPHA = 0.05  #: a segment counts if it is as rare as this by itself


def tokens(text: str | None, masked: dict[str, str] | None = None) -> list[str]:
    """Lower-case tokens; links and mentions become classes, sentence ends ``</s>``, masked spellings are undone."""
    if not text:
        return []
    out = []
    low = _SPACED.sub(lambda m: re.sub(r"[\W_]", "", m[0]), plain(text)[0].lower())
    for t in _TOKEN.findall(_LONG.sub(r"\1", low)):
        if t[0] in ".!?\n":
            if out and out[-1] != STOP:
                out.append(STOP)
        elif t.startswith("http"):
            out.append("<link>")
        elif t[0] == "@":
            out.append("<user>")
        elif t[0] == "#" or t.isalpha():
            out.append(t)
        elif t.isdigit():
            out.append("<num>")
        else:
            t = t.strip("!'*" if "*" not in t[1:-1] else "!'")
            m = t.translate(_LEET) if any(c.isalpha() for c in t) and re.search(r"[$@\d]", t) and not re.fullmatch(r"\d+\w{1,2}", t) else t
            if "*" in m:
                m = (masked or {}).get(m, "<masked>")
            out.append(m)
    return out


def grams(toks: Sequence[str], i: int) -> list[str]:
    """The n-grams that end at position i, within a sentence."""
    out = [toks[i]]
    if i > 0 and STOP not in (toks[i], toks[i - 1]):
        out.append(f"{toks[i - 1]} {toks[i]}")
        if i > 1 and toks[i - 2] != STOP:
            out.append(f"{toks[i - 2]} {toks[i - 1]} {toks[i]}")
    return out


_SHARE = (1.0, 0.7, 0.5)


def token_scores(toks: Sequence[str], w: dict[str, float]) -> list[float]:
    """A token's log-odds: those of the n-grams that end there, less a drift, so that ordinary text sums to less than 0."""
    out = []
    for i, t in enumerate(toks):
        if t == STOP:
            out.append(-BREAK)
            continue
        out.append(sum(s * w.get(g, 0.0) for s, g in zip(_SHARE, grams(toks, i))) - DRIFT)
    return out


def segments(scores: Iterable[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in linear time."""
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    link: list[int] = []  # the nearest earlier segment with a smaller left sum
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, a = before, i
        j = len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = link[j]
            if j < 0 or rights[j] >= total:
                break
            left, a = lefts[j], spans[j][0]
            del lefts[j:], rights[j:], spans[j:], link[j:]
            j = len(lefts) - 1
        lefts.append(left)
        rights.append(total)
        spans.append((a, i + 1))
        link.append(j)
    return [(r - x, a, b) for x, r, (a, b) in zip(lefts, rights, spans)]


def best(toks: Sequence[str], w: dict[str, float]) -> tuple[float, int, int]:
    return max(segments(token_scores(toks, w)), default=(0.0, 0, 0))


def log_odds(pos: Counter, neg: Counter, n_pos: float, n_neg: float, prior: dict[str, float], strength: float, cut: float = 1.0) -> dict[str, float]:
    """Log-odds with a Dirichlet prior, each moved towards 0 by ``cut`` standard errors."""
    out = {}
    for g in set(pos) | set(neg):
        a = strength * max(prior.get(g, 0.0), 1e-4)
        y, z = pos[g] + a, neg[g] + a
        d = math.log(y / (n_pos + strength - y + 1e-9)) - math.log(z / (n_neg + strength - z + 1e-9)) if y < n_pos + strength and z < n_neg + strength else 0.0
        size = abs(d) - cut * math.sqrt(1 / (y + 0.05) + 1 / (z + 0.05))
        if size > 0.05:
            out[g] = math.copysign(min(size, 6.0), d)
    return out


@dataclass
class Model:
    weights: dict[str, dict[str, float]]  #: category: n-gram: log-odds
    around: dict[str, dict[str, float]]  #: category: n-gram: log-odds of surroundings
    masked: dict[str, str]
    least: dict[str, float]  #: category: sum of segment and surroundings under which text is ordinary, for the calibration
    points: dict[str, list[tuple[list[float], int, bool, float]]] = field(default_factory=dict)  #: category: of labelled texts the held-out sums, tokens, verdict, number they stand for
    positives: dict[str, float] = field(default_factory=dict)  #: category: number of labelled documents with that verdict


def window(toks: Sequence[str], a: int, b: int) -> tuple[int, int]:
    """The segment with up to REACH tokens on both sides, within its sentence."""
    lo, hi = a, b
    while lo > 0 and a - lo < REACH and toks[lo - 1] != STOP:
        lo -= 1
    while hi < len(toks) and hi - b < REACH and toks[hi] != STOP:
        hi += 1
    return lo, hi


def features(toks: Sequence[str], lo: int, hi: int) -> set[str]:
    return {g for i in range(lo, hi) if toks[i] != STOP for g in grams(toks, i) if len(g.split(" ")) <= i - lo + 1}


def context(toks: Sequence[str], a: int, b: int, around: dict[str, float]) -> float:
    lo, hi = window(toks, a, b)
    return sum(around.get(g, 0.0) / (1 + g.count(" ")) for g in features(toks, lo, hi))


def _supported(pos: Counter, seen: Counter) -> Counter:
    """Positive counts of n-grams that at least SUPPORT different positive texts hold."""
    return Counter({g: v for g, v in pos.items() if seen[g] >= SUPPORT})


def judged(toks: Sequence[str], w: dict[str, float], around: dict[str, float]) -> list[tuple[float, int, int, float]]:
    """(score, start, end, sum with the surroundings) of every maximal segment that reaches GATE."""
    return [(x, a, e, x + context(toks, a, e, around)) for x, a, e in segments(token_scores(toks, w)) if x >= GATE]


def fit_one(docs: list[tuple[str, ...]], y: list[float], wt: list[float], prior: dict[str, float], rounds: int, strength: float) -> tuple:
    """(weights, around, least, points, positives) of one category; ``y`` is the share of votes for it."""
    pos_i = [i for i, v in enumerate(y) if v > 0]
    neg_i = [i for i, v in enumerate(y) if v < 0.5]
    if not pos_i:
        return {}, {}, math.inf, [], 0.0
    fold = {i: n % FOLDS for n, i in enumerate(pos_i)}
    wanted = {g for i in pos_i for g in features(docs[i], 0, len(docs[i]))}
    neg: Counter = Counter()
    n_neg = sum((1 - y[i]) * wt[i] for i in neg_i)
    for i in neg_i:
        for g in features(docs[i], 0, len(docs[i])) & wanted:
            neg[g] += (1 - y[i]) * wt[i]
    part: dict[int, tuple[set[str], float]] = {i: (features(docs[i], 0, len(docs[i])), y[i] ** 2) for i in pos_i}

    def weigh(skip: int | None) -> dict[str, float]:
        pos, seen, n = Counter(), Counter(), 0.0
        for i, (f, k) in part.items():
            if k > 0.02 and fold[i] != skip:
                n += k
                for g in f:
                    pos[g] += k
                    seen[g] += 1
        pos = _supported(pos, seen)
        return log_odds(pos, Counter({g: neg[g] for g in pos}), n, n_neg, prior, strength)

    for _ in range(rounds):
        by_fold = {k: weigh(k) for k in range(FOLDS)}
        usual = sorted(best(docs[i], by_fold[n % FOLDS])[0] for n, i in enumerate(neg_i))
        level = max(1.0, usual[int(0.99 * (len(usual) - 1))] if usual else 1.0)
        for i in pos_i:
            s, a, b = best(docs[i], by_fold[fold[i]])
            k = y[i] / (1 + math.exp(-min(30.0, max(-30.0, (s - level) / 0.5))))
            part[i] = (features(docs[i], max(0, a - 2), min(len(docs[i]), b + 2)), k)
    w, by_fold = weigh(None), {k: weigh(k) for k in range(FOLDS)}
    # what stands around the best segments of positive and of other texts
    cand = []
    for i, d in enumerate(docs):
        s, a, b = best(d, by_fold[fold[i]] if i in fold else w)
        if s >= GATE:
            cand.append((i, s, a, b, features(d, *window(d, a, b))))

    def surroundings(skip: int | None) -> dict[str, float]:
        p2, q2, seen, n_p, n_q = Counter(), Counter(), Counter(), 0.0, 0.0
        for i, _, _, _, f in cand:
            if i % FOLDS == skip:
                continue
            n_p, n_q = n_p + y[i], n_q + (1 - y[i]) * wt[i]
            for g in f:
                p2[g] += y[i]
                q2[g] += (1 - y[i]) * wt[i]
                seen[g] += 1
        if not (n_p and n_q):
            return {}
        share = {g: n / (n_p + n_q) for g, n in seen.items()}
        return log_odds(_supported(p2, seen), _supported(q2, seen), n_p, n_q, share, 2.0, 0.5)

    around, held = surroundings(None), {k: surroundings(k) for k in range(FOLDS)}
    total = sum(x for v, x in zip(y, wt) if v >= 0.5)
    points = [([x[3] for x in judged(docs[i], by_fold[fold[i]] if i in fold else w, held[i % FOLDS])], len(docs[i]), y[i] >= 0.5, wt[i]) for i, *_ in cand]
    least = -best_level([(-max(n), v, x) for n, _, v, x in points], total)
    return w, around, max(0.0, least), points, total


def best_level(pts: list[tuple[float, bool, float]], total: float) -> float:
    """The level of (value, verdict, weight) at or under which the F1 against the verdicts is best; -inf if none helps."""
    pts = sorted(pts)
    top, at, tp, n = -1.0, -math.inf, 0.0, 0.0
    for k, (s, v, x) in enumerate(pts):
        tp, n = tp + v * x, n + x
        f1 = 2 * tp / (n + total)
        if f1 > top + 0.005 and s < 0:
            nxt = min(0.0, pts[k + 1][0]) if k + 1 < len(pts) else 0.0
            top, at = f1, (s + nxt) / 2
    return at


def fit(rows: list[tuple[str, dict[str, float], float]], prior: dict[str, float], rounds: int = 3, strength: float = 20.0, spark: SparkSession | None = None) -> Model:
    """``rows``: text, per category the share of its annotators who chose it, and how many labelled documents it stands for.
    ``prior``: share of documents with an n-gram. With ``spark`` each category is fitted in a task of its own.

    Equal texts count once, with their mean votes. Passages of positive texts are found with weights fitted on the
    other folds, so a wrongly labelled text cannot make its own words look offensive.
    """
    merged: dict[tuple[str, ...], list[dict[str, float]]] = defaultdict(list)
    stands: dict[tuple[str, ...], float] = {}
    for t, v, n in rows:
        d = tuple(tokens(t))
        merged[d].append(v)
        stands[d] = min(n, stands.get(d, n))
    docs = sorted(merged)
    wt = [stands[d] for d in docs]
    vote = {c: [sum(v.get(c, 0.0) for v in merged[d]) / len(merged[d]) for d in docs] for c in CATEGORIES}
    if spark is None:
        got = {c: fit_one(docs, vote[c], wt, prior, rounds, strength) for c in CATEGORIES}
    else:
        given = spark.sparkContext.broadcast((docs, vote, wt, prior))  # the bounded sample

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                docs_, vote_, wt_, prior_ = given.value
                yield pd.DataFrame({"c": b["c"], "m": [pickle.dumps(fit_one(docs_, vote_[c], wt_, prior_, rounds, strength)) for c in b["c"]]})

        each = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "i int, c string").repartitionByRange(len(CATEGORIES), "i")
        got = {r.c: pickle.loads(r.m) for r in each.mapInPandas(task, "c string, m binary").collect()}  # a model per category
        given.unpersist()
    weights = {c: got[c][0] for c in CATEGORIES}
    masked: dict[str, str] = {}
    for w in weights.values():
        for g, v in sorted(w.items(), key=lambda x: x[1]):
            if v > 1 and " " not in g and g.isalpha() and len(g) > 2:
                for i in range(len(g)):
                    masked[g[:i] + "*" + g[i + 1 :]] = g
                    for j in range(i + 1, len(g)):
                        masked[g[:i] + "*" + g[i + 1 : j] + "*" + g[j + 1 :]] = g
    return Model(weights, {c: got[c][1] for c in CATEGORIES}, masked, {c: got[c][2] for c in CATEGORIES}, {c: got[c][3] for c in CATEGORIES}, {c: got[c][4] for c in CATEGORIES})


def votes(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the share of its votes for each category; one vote per annotator and document counts."""
    v = labels.filter(F.col("category").isNotNull() & F.col(key).isNotNull()).groupBy(key, "annotator").agg(F.max("category").alias("category"))
    return v.groupBy(key).agg(F.count("*").alias("n"), *[(F.count_if(F.col("category") == c) / F.count("*")).alias(c) for c in CATEGORIES])


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> list[tuple[str, dict[str, float], float]]:
    """Labelled documents on the driver, at most ``most``: those with a vote for any category first, then by hash.

    Each comes with the number of labelled documents of its kind that it stands for.
    """
    any_ = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])) > 0
    v = cut(votes(labels, key).withColumn("any", any_).join(docs.filter(F.col(text).isNotNull()).select(key), key, "left_semi"))
    n = {r["any"]: r["count"] for r in v.groupBy("any").count().collect()}
    some = min(most, n.get(True, 0))
    rest = min(most - some, n.get(False, 0))
    stands = {True: n.get(True, 0) / max(1, some), False: n.get(False, 0) / max(1, rest)}
    ids = v.orderBy(F.col("any").desc(), F.xxhash64(key), key).limit(most)
    rows = docs.select(key, F.col(text).alias("__t")).filter(F.col("__t").isNotNull()).join(ids, key).select("__t", "any", *CATEGORIES).collect()
    return sorted(((r[0], {c: float(r[c]) for c in CATEGORIES if r[c]}, stands[r["any"]]) for r in rows), key=lambda x: (x[0], sorted(x[1].items())))


def corpus_shares(docs: DataFrame, wanted: set[str], text: str = "text") -> dict[str, float]:
    """Share of all documents that hold each of the wanted n-grams (those of the labelled sample), counted in the tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                toks = tokens(t)
                c[""] += 1
                c.update(g for g in features(toks, 0, len(toks)) if g in wanted)
        yield pd.DataFrame(list(c.items()), columns=["g", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # at most the wanted ones
    n = {r.g: r.n for r in rows}
    total = max(1, n.pop("", 1))
    return {g: x / total for g, x in n.items()}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, key, text, most)
    c: Counter = Counter()
    for d in {tuple(tokens(t)) for t, _, _ in rows}:
        c.update(features(d, 0, len(d)))
    wanted = {g for g, n in c.items() if n >= SUPPORT}  # no other n-gram can get a weight
    return fit(rows, corpus_shares(docs, wanted, text), spark=docs.sparkSession)


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry..., category, n_tokens, score, net (with its surroundings), nets, n_segments, passage, hist.

    Each maximal segment is judged with its own surroundings: ``nets`` has the sums, from the highest, of those that reach
    GATE. score, net and passage are of the highest of these, else of the best
    segment. hist counts the document's tokens by score, in steps of 1 / BINS, outside the best segment.
    """
    schema = docs.select(key, *carry).schema.simpleString()[7:-1] + ",category string,n_tokens int,score double,net double,nets array<double>,n_segments int,passage string,hist map<int,int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = defaultdict(list)
            for t in b["__t"]:
                toks = tokens(t, model.masked)
                for c in CATEGORIES:
                    scores = token_scores(toks, model.weights[c])
                    segs = segments(scores)
                    top = max(segs, default=(0.0, 0, 0))
                    around = model.around[c]
                    nets = sorted(((x + context(toks, a, e, around), x, a, e) for x, a, e in segs if x >= GATE), reverse=True)
                    net, s, lo, hi = nets[0] if nets else (top[0] + context(toks, *top[1:], around) if top[0] > 0 else 0.0, *top)
                    out["category"].append(c)
                    out["n_tokens"].append(len(toks))
                    out["score"].append(s)
                    out["net"].append(net)
                    out["nets"].append([x[0] for x in nets])
                    out["n_segments"].append(len(segs))
                    out["passage"].append(" ".join(toks[lo:hi]))
                    out["hist"].append(dict(Counter(round(x * BINS) for x in scores[: top[1]] + scores[top[2] :])))
            rep = b[[key, *carry]].loc[b.index.repeat(len(CATEGORIES))].reset_index(drop=True)
            yield rep.assign(**out)

    return docs.select(key, *carry, F.col(text).alias("__t")).mapInPandas(run, schema)


@dataclass
class Law:
    """Extreme value law of the best segment of n tokens: P(sum >= s) = 1 - exp(-k n exp(-rate s)); ``level`` is the fitted ln p."""

    rate: dict[str, float] = field(default_factory=dict)
    k: dict[str, float] = field(default_factory=dict)
    level: dict[str, float] = field(default_factory=dict)


def log_p(nets: Sequence[float], n: int, rate: float, k: float) -> float:
    """ln of the p-value of a text of n tokens with these sums; ``significance`` is the same as a Column."""
    e = sorted((rate * s - math.log(k * n) for s in nets if s > 0), reverse=True) if n else []
    if not e:
        return 0.0
    out = _log_single(e[0])
    t = 0.0
    for r, x in enumerate((x for x in e if _log_single(x) <= math.log(ALPHA)), 1):
        t += x
        if r > 1:
            out = min(out, -t + (r - 1) * math.log(max(t, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2))
    return out


def _log_single(x: float) -> float:
    """ln(1 - exp(-exp(-x)))"""
    return -x if x > 15 else math.log(-math.expm1(-math.exp(min(50.0, -x))))


def decay(hist: dict[int, int]) -> float:
    """The positive root of sum p(s) exp(rate s) = 1; 5 if no score is positive, and small if the mean score is not negative."""
    n = sum(hist.values())
    if not n or max(hist) <= 0:
        return 5.0
    if sum(s * c for s, c in hist.items()) >= 0:
        return 1e-3
    total = lambda x: sum(c / n * math.exp(min(600.0, x * s / BINS)) for s, c in hist.items())
    lo, hi = 1e-6, 1.0
    while total(hi) < 1 and hi < 50:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1 else (lo, mid)
    return min(5.0, hi)


def calibrate(scored: DataFrame, model: Model) -> Law:
    """The law of each category from all documents, and the level of ln p that agrees best with the held-out labelled texts.

    The histogram has one row per step of the score, the rest one row per category.
    """
    law = Law({c: 5.0 for c in CATEGORIES}, {c: 0.1 for c in CATEGORIES})
    hists: dict[str, dict[int, int]] = defaultdict(dict)
    for r in scored.select("category", F.explode("hist").alias("s", "n")).groupBy("category", "s").agg(F.sum("n").alias("n")).collect():
        hists[r.category][r.s] = r.n
    pick = F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c, float(min(model.least[c], 1e9)))]), F.col("category"))
    usual = scored.filter(F.col("net") < pick)
    mid = {r.category: r.m for r in usual.filter("net > 0").groupBy("category").agg(F.percentile_approx("net", 0.9, 1000).alias("m")).collect()}
    at = F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c, float(mid.get(c, 1.0)))]), F.col("category"))
    for r in usual.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("net") >= at).alias("over"), F.avg("n_tokens").alias("t")).collect():
        c = r.category
        law.rate[c] = decay(hists.get(c, {}))
        share = min(0.999, max(r.over, 0.5) / r.n)
        law.k[c] = -math.log(1 - share) * math.exp(min(500.0, law.rate[c] * mid.get(c, 1.0))) / max(1.0, r.t or 1.0)
    for c in CATEGORIES:
        pts = [(log_p(nets, n, law.rate[c], law.k[c]), v, x) for nets, n, v, x in model.points.get(c, [])]
        law.level[c] = min(math.log(ALPHA), best_level(pts, model.positives.get(c, 0.0)))
    return law


def significance(scored: DataFrame, law: Law) -> DataFrame:
    """Adds ``log_p`` and ``p_value``: how likely ordinary text of that length has a segment with such a sum, or several that together are as rare.

    For the r highest segments, each significant (ALPHA) by itself, the chance that the sum of rate * sum - ln(k n) reaches T
    is about exp(-T) T^(r-1) / (r! (r-1)!); the least of these over r counts, doubled for each further segment as r is chosen.
    """
    pick = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("category"))
    single = lambda x: F.when(x > 15, -x).otherwise(F.log(-F.expm1(-F.exp(F.least(F.lit(50.0), -x)))))
    s = scored.withColumn("__e", F.transform(F.filter("nets", lambda s: s > 0), lambda s: pick(law.rate) * s - F.log(pick(law.k) * F.col("n_tokens"))))
    one = F.when((F.size("__e") > 0) & (F.col("n_tokens") > 0), single(F.get("__e", F.lit(0)))).otherwise(0.0)
    t = F.filter("__e", lambda x: single(x) <= math.log(ALPHA))
    start = F.struct(F.lit(0).alias("r"), F.lit(0.0).alias("t"), F.lit(0.0).alias("f"), F.lit(0.0).alias("p"))

    def add(a: Column, x: Column) -> Column:
        r, total = a["r"] + 1, a["t"] + x
        f = a["f"] + F.log(r.cast("double")) + F.log(F.greatest(r - 1, F.lit(1)).cast("double"))  # ln(r! (r-1)!)
        p = -total + (r - 1) * F.log(F.greatest(total, F.lit(1e-9))) - f + (r - 1) * math.log(2)
        return F.struct(r.alias("r"), total.alias("t"), f.alias("f"), F.when(r > 1, F.least(a["p"], p)).otherwise(F.lit(0.0)).alias("p"))

    return s.withColumn("log_p", F.least(one, F.aggregate(t, start, add, lambda a: a["p"]))).withColumn("p_value", F.exp("log_p")).drop("__e")


def flagged(scored: DataFrame, law: Law) -> DataFrame:
    """Rows (document, category) whose passages together are rarer in ordinary text than the fitted level, at most ALPHA."""
    pick = F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c, float(max(law.level.get(c, -math.inf), -1e18)))]), F.col("category"))
    return scored.filter((F.size("nets") > 0) & (F.col("log_p") <= pick))


def rates(scored: DataFrame, law: Law, source: str = "source") -> DataFrame:
    """Per source and category the number of documents and the share flagged."""
    f = flagged(scored, law).groupBy(source, "category").agg(F.count("*").alias("n_flagged"))
    n = scored.groupBy(source, "category").agg(F.count("*").alias("n_docs"))
    j = n.join(f.withColumnRenamed(source, "__s").withColumnRenamed("category", "__c"), F.col(source).eqNullSafe(F.col("__s")) & (F.col("category") == F.col("__c")), "left")
    return j.select(source, "category", "n_docs", F.coalesce("n_flagged", F.lit(0)).alias("n_flagged")).withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
