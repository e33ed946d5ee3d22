"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from lexloom.functions import constants as K

V0, V1, TAU, LOW = 1_500_000, 3_500_000, 0.75, 3
MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def mapping(d: dict[str, str]) -> str:
    return f"MAP({arr(d)}, {arr(d.values())})"


def toks(c: str) -> str:
    return f"[t for t in string_split({c}, ' ') if t <> '']"


LONG_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("created_at", "hashtags", "text", "retweet_flag", "emotion", "emoticons", "unigrams", "opaque", "bigrams"))
DOCS = f"""
d0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {LONG_ORDER}) AS rn FROM tweet_long WHERE id IS NOT NULL),
docs AS (SELECT id, created_at, CAST(list_position({MONTHS}, substr(created_at, 5, 3)) - 1 AS INTEGER) AS month, hashtags, text, retweet_flag, emotion, unigrams,
  {toks("coalesce(unigrams, '')")} AS uni, {toks("coalesce(bigrams, '')")} AS bi,
  CAST(CASE emotion WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS INTEGER) AS label FROM d0 WHERE rn = 1)"""
CORPUS = (
    DOCS
    + """,
g0 AS (SELECT id, CAST(CASE label WHEN 4 THEN 1 WHEN 0 THEN 0 END AS INTEGER) AS label, opaque, text FROM tweet_gold WHERE id IS NOT NULL),
gold AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY label NULLS FIRST, opaque NULLS FIRST, text NULLS FIRST) AS rn FROM g0) WHERE rn = 1),
corpus AS (SELECT d.id, d.month, d.uni, d.bi, coalesce(g.label, d.label) AS label,
  CASE WHEN g.label IS NOT NULL THEN 'test' WHEN d.label IS NOT NULL THEN 'train' ELSE 'pool' END AS role FROM docs d LEFT JOIN gold g USING (id)),
train AS (SELECT * EXCLUDE (role) FROM corpus WHERE role = 'train'),
pool AS (SELECT * EXCLUDE (role) FROM corpus WHERE role = 'pool'),
test AS (SELECT * EXCLUDE (role) FROM corpus WHERE role = 'test')"""
)


def train(m: str, rel: str, tok: str, by: str = "") -> str:
    """CTEs of a model ``m``: counts by token, and one row of totals (per value of ``by``)."""
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return f""",
{m}_cond AS (SELECT {b}token, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM (SELECT {b}label, unnest({tok}) AS token FROM {rel} WHERE label IN (0, 1)) GROUP BY ALL),
{m}_prior AS (SELECT {b}count(*) FILTER (label = 0) AS d0, count(*) FILTER (label = 1) AS d1, coalesce(sum(len({tok})) FILTER (label = 0), 0) AS t0, coalesce(sum(len({tok})) FILTER (label = 1), 0) AS t1 FROM {rel} WHERE label IN (0, 1){g})"""


def score(o: str, m: str, rel: str, tok: str, v: int, by: str = "", carry: str = "") -> str:
    b = f"{by}, " if by else ""
    c = f"{carry}, " if carry else ""
    on = f"o.token = c.token{f' AND o.{by} = c.{by}' if by else ''}"
    theta = lambda k: f"sum(CASE WHEN o.token IS NULL THEN 0 ELSE ln(coalesce(c.n{k}, 0) + 1.0) - ln(p.t{k} + {v}.0) END)"
    raw = lambda k: f"max(ln(p.d{k} + 1.0) - ln(p.d0 + p.d1 + 2.0)) + {theta(k)}"
    ob, oc = (f"o.{by}, " if by else ""), (f"o.{carry}, " if carry else "")
    return f""",
{o}_occ AS (SELECT id, {b}{c}unnest(CASE WHEN len({tok}) = 0 THEN [NULL] ELSE {tok} END) AS token FROM {rel}),
{o}_raw AS (SELECT o.id, {ob}{oc}{raw(0)} AS raw0, {raw(1)} AS raw1 FROM {o}_occ o LEFT JOIN {m}_cond c ON {on} JOIN {m}_prior p ON {f'o.{by} = p.{by}' if by else 'true'} GROUP BY ALL),
{o} AS (SELECT *, 1 / (1 + exp(raw0 - raw1)) AS p1, CAST(CASE WHEN raw1 > raw0 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM {o}_raw)"""


def relabel(o: str, scored: str, rel: str, by: str = "", where: str = "true") -> str:
    """Rows of ``rel`` with the predicted label."""
    return f""",
{o} AS (SELECT r.* EXCLUDE (label), x.pred AS label FROM {rel} r JOIN {scored} x USING (id{', ' + by if by else ''}) WHERE {where})"""


def union(o: str, *rels: str) -> str:
    return f""",
{o} AS ({' UNION ALL BY NAME '.join(f'SELECT * FROM {r}' for r in rels)})"""


def out(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


CONF = "greatest(p1, 1 - p1)"
HALF = lambda *p: f"substr(md5(concat_ws('|', {', '.join(p)})), 1, 1) < '8'"


# ---- text ---------------------------------------------------------------------------------
def x_ws(c):
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def x_clear(c):
    c = f"regexp_replace({c}, 'https?://\\S+\\s?', '', 'g')"
    c = f"regexp_replace({c}, 'http?://\\S+\\s?', '', 'g')"
    return f"trim(translate(replace({c}, '#', ''), '.!?_', '    '))"


def x_mentions(c):
    return f"coalesce(array_to_string([t for t in string_split({c}, ' ') if NOT (contains(t, '@') OR contains(t, '＠'))], ' '), '')"


def x_squeeze(c):
    for ch in "auijy":
        c = f"regexp_replace({c}, '{ch}{ch}+', '{ch}', 'g')"
    for ch in "oe":
        c = f"regexp_replace({c}, '{ch}{ch}{ch}+', '{ch}', 'g')"
    for ch in "bcdfghklmnpqrstvwz":
        c = f"regexp_replace({c}, '{ch}{ch}{ch}+', '{ch}{ch}', 'g')"
    return c


def x_slang(c):
    return f"array_to_string([coalesce(m[t], t) for t in string_split({c}, ' ')], ' ')"


def x_ascii(c):
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')"


def x_letters(c):
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{Z}}_]', ' ', 'g')"


def x_short(c):
    return f"regexp_replace({c}, '\\b[\\w'']{{1,2}}\\b', '', 'g')"


def x_stop(c):
    return f"coalesce(array_to_string([t for t in string_split({c}, ' ') if NOT list_contains({arr(K.STOPWORDS)}, t)], ' '), '')"


NEG = lambda t: f"coalesce(ends_with({t}, 'n''t') OR ends_with({t}, 'not') OR {t} IN ('nor', 'neither'), false)"


def x_verbs(a):
    vs = arr(K.VERBS)
    return f"""array_to_string([CASE
      WHEN {NEG(f'{a}[i]')} AND i < len({a}) THEN CASE WHEN list_contains({vs}, {a}[i + 1]) THEN 'NOT_' || {a}[i + 1] ELSE replace({a}[i], 'n''t', 'not') END
      WHEN i > 1 AND {NEG(f'{a}[i - 1]')} AND list_contains({vs}, {a}[i]) THEN ''
      ELSE {a}[i] END FOR i IN range(1, len({a}) + 1)], ' ')"""


def x_adjectives(a):
    m: dict[str, str] = {}
    for x, y in K.ANTONYMS:
        m[x], m[y] = y, x
    am, keys, skip = mapping(m), arr(m), arr(K.INTENSIFIERS)
    far = lambda i: f"({i} + 2 <= len({a}) AND list_contains({skip}, {a}[{i} + 1]))"
    return f"""array_to_string([CASE
      WHEN {NEG(f'{a}[i]')} THEN coalesce({am}[CASE WHEN {far('i')} THEN {a}[i + 2] ELSE {a}[i + 1] END], {a}[i])
      WHEN i > 1 AND {NEG(f'{a}[i - 1]')} AND {far('(i - 1)')} THEN ''
      WHEN i > 1 AND {NEG(f'{a}[i - 1]')} AND list_contains({keys}, {a}[i]) THEN ''
      WHEN i > 2 AND {NEG(f'{a}[i - 2]')} AND {far('(i - 2)')} AND list_contains({keys}, {a}[i]) THEN ''
      ELSE {a}[i] END FOR i IN range(1, len({a}) + 1)], ' ')"""


SLANG = "sl AS (SELECT MAP(list(term ORDER BY term), list(replacement ORDER BY term)) AS m FROM (SELECT term, max(regexp_replace(replacement, '  +', ' ', 'g')) AS replacement FROM slang WHERE term IS NOT NULL AND replacement IS NOT NULL GROUP BY term))"
HITS = lambda xs, c: f"[e for e in {arr(sorted(xs))} if contains({c}, e)]"
EMOTION = "CASE WHEN h = 0 AND s = 0 THEN 'neutral' WHEN s = 0 THEN 'positive' WHEN h = 0 THEN 'negative' WHEN h > s THEN 'semi_positive' WHEN s > h THEN 'semi_negative' ELSE 'unknown' END"


def chain(counting_only: bool) -> str:
    first = "text" if counting_only else x_slang("lower(text)")
    last = "s8" if counting_only else x_ws(x_stop("s8"))
    return f"""{SLANG},
c1 AS (SELECT id, m, {first} AS s1 FROM tweet_long, sl),
c2 AS (SELECT id, m, {x_ws(x_squeeze(x_mentions(x_clear('s1'))))} AS s2 FROM c1),
c3 AS (SELECT id, {x_ws(x_slang('s2'))} AS s3 FROM c2),
c4 AS (SELECT id, s3, string_split(s3, ' ') AS a FROM c3),
c5 AS (SELECT id, s3, string_split({x_ws(x_verbs('a'))}, ' ') AS a FROM c4),
c6 AS (SELECT id, s3, {x_ws(x_adjectives('a'))} AS s6 FROM c5),
c8 AS (SELECT id, s3, {x_ws(x_short(x_letters(x_ascii('s6'))))} AS s8 FROM c6),
c9 AS (SELECT id, s3 AS marked, {last} AS cleaned FROM c8)"""


def text_query(expr: str, slang: bool = False) -> str:
    return f"WITH {SLANG} SELECT id, {expr} AS out FROM tweet_long, sl" if slang else f"SELECT id, {expr} AS out FROM tweet_long"


# ---- JSON ---------------------------------------------------------------------------------
JSON = """
j0 AS (SELECT line_no, CASE WHEN json_valid(line) THEN line END AS j FROM raw_tweet),
j1 AS (SELECT line_no, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM j0)"""
TAGS = """CASE json_type(j, '$.entities.hashtags')
  WHEN 'ARRAY' THEN [coalesce(json_extract_string(x, '$.text'), 'null') FOR x IN CAST(json_extract(j, '$.entities.hashtags') AS JSON[])]
  WHEN 'OBJECT' THEN CASE WHEN json_extract_string(j, '$.entities.hashtags.text') IS NULL THEN [] ELSE [json_extract_string(j, '$.entities.hashtags.text')] END
  ELSE [] END"""
ENGLISH = (
    JSON
    + """,
r AS (SELECT CASE WHEN json_type(j, '$.retweeted_status') IS NOT NULL THEN json_extract(j, '$.retweeted_status') ELSE j END AS j FROM j1
  WHERE j IS NOT NULL AND json_type(j, '$.delete') IS NULL AND json_extract_string(j, '$.lang') = 'en'),
f AS (SELECT trim(json_extract_string(j, '$.id_str')) AS tweet_id, json_extract_string(j, '$.user.screen_name') AS screen_name, json_extract_string(j, '$.created_at') AS created_at,
  try_cast(json_extract_string(j, '$.user.followers_count') AS BIGINT) AS followers, try_cast(json_extract_string(j, '$.user.friends_count') AS BIGINT) AS friends,
  try_cast(json_extract_string(j, '$.retweet_count') AS BIGINT) AS retweets, try_cast(json_extract_string(j, '$.favorite_count') AS BIGINT) AS favourites,
  """
    + x_ws("json_extract_string(j, '$.text')")
    + """ AS text FROM r WHERE json_extract_string(j, '$.lang') = 'en'),
e AS (SELECT * FROM f WHERE tweet_id <> '' AND screen_name IS NOT NULL AND created_at IS NOT NULL AND followers IS NOT NULL AND friends IS NOT NULL AND retweets IS NOT NULL AND favourites IS NOT NULL AND text IS NOT NULL)"""
)

# ---- lexicon ------------------------------------------------------------------------------
LEX = """
lx0 AS (SELECT pos_tag AS pos, synset_id, pos_score - neg_score AS s, unnest(string_split(terms, ' ')) AS term FROM sentiwordnet WHERE NOT starts_with(pos_tag, '#') AND terms IS NOT NULL),
lx1 AS (SELECT split_part(term, '#', 1) AS lemma, pos, try_cast(split_part(term, '#', 2) AS INTEGER) AS rank, synset_id, s FROM lx0),
lx2 AS (SELECT lemma, pos, rank, arg_max(s, synset_id) AS s FROM lx1 WHERE rank > 0 AND s IS NOT NULL GROUP BY ALL),
lexicon AS (SELECT lemma, pos, sum(s / rank) AS score FROM lx2 GROUP BY ALL),
tags AS (SELECT lemma AS word, min(CASE pos WHEN 'a' THEN 'JJ' WHEN 'n' THEN 'NN' WHEN 'r' THEN 'RB' WHEN 'v' THEN 'VB' END) AS tag FROM lexicon GROUP BY ALL)"""
POS = "CASE " + " ".join(f"WHEN tag IN ({', '.join(s(t) for t in ts)}) THEN '{c}'" for c, ts in K.POS_CLASSES.items()) + " END"


def lex_score(text: str, contextual: bool = False) -> str:
    tag = "CASE WHEN prev IN ('the', 'a', 'an', 'this', 'that') AND starts_with(tag, 'VB') THEN 'NN' WHEN prev = 'to' AND starts_with(tag, 'NN') THEN 'VB' ELSE tag END" if contextual else "tag"
    return f"""{DOCS},{LEX},
w0 AS (SELECT id, {toks(text)} AS ws FROM docs),
w1 AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
w2 AS (SELECT id, regexp_replace(w, '^NOT_', '') AS word, starts_with(w, 'NOT_') AS neg, regexp_replace(lag(w) OVER (PARTITION BY id ORDER BY i), '^NOT_', '') AS prev FROM w1),
w3 AS (SELECT id, neg, word, {tag} AS tag FROM w2 JOIN tags USING (word)),
w4 AS (SELECT id, CASE WHEN neg THEN -score ELSE score END AS sc FROM w3 JOIN lexicon l ON l.lemma = word AND l.pos = {POS}),
scored AS (SELECT d.id, d.emotion, d.created_at, d.unigrams, coalesce(avg(sc), 0) AS score FROM docs d LEFT JOIN w4 USING (id) GROUP BY ALL)"""


AGREES = "(score > 0 AND emotion = 'positive' OR score < 0 AND emotion = 'negative')"

# ---- balance ------------------------------------------------------------------------------
SIZES = "z AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM train)"
BLANK = (
    LEX
    + f""",
lem AS (SELECT DISTINCT lemma FROM lexicon WHERE score <> 0),
{SIZES},
k0 AS (SELECT id, uni, unnest(generate_series(1, greatest(CAST(ceil(p / n) AS BIGINT) - 1, 0))) AS copy FROM train, z WHERE label = 0 AND n > 0 AND len(uni) >= 5),
k1 AS (SELECT id, copy, unnest(uni) AS t, generate_subscripts(uni, 1) AS i FROM k0),
k2 AS (SELECT id, copy, arg_min(i, md5(concat_ws('|', id, copy, i - 1))) AS hit FROM k1 WHERE NOT regexp_matches(t, '^(NOT_|not_)|(dont|havent|cant|cannot|arent|aint)$') AND t NOT IN (SELECT lemma FROM lem) GROUP BY ALL),
blank AS (SELECT id, copy, [lower(uni[i]) FOR i IN range(1, len(uni) + 1) IF i <> hit] AS uni FROM k0 JOIN k2 USING (id, copy))"""
)
_SYN_KEYS = arr(sorted(K.SYNONYMS))
_SYN = "CASE w " + " ".join(f"WHEN {s(w)} THEN {arr(ns)}" for w, ns in sorted(K.SYNONYMS.items())) + " END"

SYN = SIZES + f""",
k0 AS (SELECT id, uni, unnest(generate_series(1, greatest(CAST(ceil(p / n) AS BIGINT) - 1, 0))) AS copy FROM train, z WHERE label = 0 AND n > 0 AND list_has_any(uni, {_SYN_KEYS})),
k1 AS (SELECT id, copy, unnest(uni) AS w, generate_subscripts(uni, 1) AS i FROM k0),
k2 AS (SELECT id, copy, i, w, {_SYN} AS ns, CAST('0x' || substr(md5(concat_ws('|', id, copy, i - 1)), 1, 4) AS INTEGER) AS hv FROM k1)"""
_SYN_WORD = "lower(coalesce(ns[hv % len(ns) + 1], w))"


def balanced(ctes: str, kept: str = "true") -> str:
    """One round on the originals (those ``kept`` if augmentation is needed) and, if it is needed, ``extra``."""
    c = CORPUS + "," + ctes + f""",
gate AS (SELECT abs(p - n) / (p + n) > 0.2 AS need FROM z),
fused AS (SELECT id, label, uni FROM train, gate WHERE NOT need OR {kept} UNION ALL SELECT id, label, uni FROM extra, gate WHERE need)"""
    return out(c + train("m", "fused", "uni") + score("e", "m", "pool", "uni", V0), f"SELECT id, {SPLIT} FROM e")


# ---- time ---------------------------------------------------------------------------------
WINDOWS = {"single": ("0", "period = month"), "cumulative": ("0", "month <= period"), "sliding": ("2", "month BETWEEN period - 2 AND period")}


def periods(kind: str, protocol: str) -> str:
    kind, _, pool_kind = kind.partition("/")
    start, hit = WINDOWS[kind]
    stream = "train UNION ALL BY NAME SELECT * FROM test" if protocol == "union" else "train"
    return CORPUS + f""",
ps AS (SELECT CAST(unnest(generate_series({start}, 10)) AS INTEGER) AS period), stream AS (SELECT * FROM {stream}),
wtrain AS (SELECT t.*, period FROM stream t, ps WHERE {hit}), wpool AS (SELECT t.*, period FROM pool t, ps WHERE {WINDOWS[pool_kind or kind][1]}),
wtest AS (SELECT *, month - 1 AS period FROM {'test' if protocol == 'holdout' else 'stream'})"""


def temporal(kind: str, protocol: str, lu: bool) -> str:
    c = periods(kind, protocol)
    c += train("m", "wtrain", "uni", "period")
    m = "m"
    if lu:
        c += score("s", "m", "wpool", "uni", V0, "period") + relabel("lab", "s", "wpool", "period") + union("mixed", "wtrain", "lab") + train("m2", "mixed", "uni", "period")
        m = "m2"
    c += score("e", m, "wtest", "uni", V0, "period", "label")
    return out(c, "SELECT period, count(label) AS n_test, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM ps LEFT JOIN e USING (period) GROUP BY ALL")


def temporal_co(kind: str, protocol: str) -> str:
    c = periods(kind, protocol)
    for view, other, v in (("uni", "bi", V0), ("bi", "uni", V1)):
        c += train(f"m_{view}", "wtrain", view, "period") + score(f"s_{view}", f"m_{view}", "wpool", view, v, "period") + relabel(f"l_{view}", f"s_{view}", "wpool", "period")
    for view, other, v in (("uni", "bi", V0), ("bi", "uni", V1)):
        c += union(f"b_{view}", "wtrain", f"l_{other}") + train(f"n_{view}", f"b_{view}", view, "period") + score(f"e_{view}", f"n_{view}", "wtest", view, v, "period", "label")
        c += f""",
a_{view} AS (SELECT period, count(label) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS acc FROM ps LEFT JOIN e_{view} USING (period) GROUP BY ALL)"""
    return out(c, "SELECT period, u.n AS n_test, u.acc AS uni_accuracy, b.acc AS bi_accuracy FROM a_uni u JOIN a_bi b USING (period)")


# ---- loops --------------------------------------------------------------------------------
def self_loop(rounds: int) -> str:
    c, tr, po, got = CORPUS, "train", "pool", []
    for k in range(1, rounds + 1):
        c += train(f"m{k}", tr, "uni") + score(f"s{k}", f"m{k}", po, "uni", V0)
        c += f", h{k} AS (SELECT id, pred AS label, p1, {k} AS round FROM s{k} WHERE {CONF} > {TAU})"
        c += f", lab{k} AS (SELECT r.* EXCLUDE (label), h.label FROM {po} r JOIN h{k} h USING (id))" + union(f"tr{k}", tr, f"lab{k}")
        c += f", po{k} AS (SELECT * FROM {po} WHERE id NOT IN (SELECT id FROM h{k}))"
        tr, po = f"tr{k}", f"po{k}"
        got.append(f"SELECT id, label, round(p1, 6) AS p1, round FROM h{k}")
    return out(c, " UNION ALL ".join(got))


def co_loop(steps: int) -> str:
    c, got = CORPUS, []
    tr, po = {"uni": "train", "bi": "train"}, {"uni": "pool", "bi": "pool"}
    for k in range(1, steps + 1):
        for i, (view, v) in enumerate((("uni", V0), ("bi", V1))):
            c += train(f"m{view}{k}", tr[view], view) + score(f"s{view}{k}", f"m{view}{k}", po[view], view, v)
            c += f", h{view}{k} AS (SELECT id, pred AS label FROM s{view}{k} WHERE {CONF} >= {TAU}), lab{view}{k} AS (SELECT r.* EXCLUDE (label), h.label FROM {po[view]} r JOIN h{view}{k} h USING (id))"
            c += f", po{view}{k} AS (SELECT * FROM {po[view]} WHERE id NOT IN (SELECT id FROM h{view}{k}))"
            got.append(f"SELECT {i} AS view, id, label, {k} AS step FROM h{view}{k}")
        c += union(f"truni{k}", tr["uni"], f"labbi{k}") + union(f"trbi{k}", tr["bi"], f"labuni{k}")
        tr, po = {x: f"tr{x}{k}" for x in tr}, {x: f"po{x}{k}" for x in po}
    return out(c, " UNION ALL ".join(got))


def co_accuracy(steps: int) -> str:
    """The loop's training sets after each step, scored on the test rows; steps after the last that labelled anything are left out."""
    c = co_loop(steps).rsplit("\nSELECT 0 AS view, id, label, 1 AS step", 1)[0].removeprefix("WITH ").rstrip()
    got = []
    for k in range(1, steps + 1):
        for i, (view, v) in enumerate((("uni", V0), ("bi", V1))):
            c += train(f"t{view}{k}", f"tr{view}{k}", view) + score(f"e{view}{k}", f"t{view}{k}", "test", view, v, carry="label")
            got.append(f"SELECT {k} AS step, {i} AS view, count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM e{view}{k} WHERE EXISTS (SELECT 1 FROM huni{k}) OR EXISTS (SELECT 1 FROM hbi{k}) HAVING count(*) > 0")
    return out(c, " UNION ALL ".join(got))


def growth(pool: str, mid: str = "") -> str:
    return CORPUS + mid + train("m", "train", "uni") + score("s", "m", pool, "uni", V0) + relabel("lab", "s", pool) + union("mixed", "train", "lab") + train("m2", "mixed", "uni")


def exchange() -> str:
    c = CORPUS
    for view, v in (("uni", V0), ("bi", V1)):
        c += train(f"m{view}", "train", view) + score(f"s{view}", f"m{view}", "pool", view, v) + relabel(f"l{view}", f"s{view}", "pool")
    return c


PREDICT = CORPUS + train("m", "train", "uni") + score("e", "m", "test", "uni", V0, carry="label")
ROUND = CORPUS + train("m", "train", "uni") + score("e", "m", "pool", "uni", V0)
SPLIT = f"round(p1, 6) AS p1, pred, {CONF} >= {TAU} AS is_high"
COUNTS = "SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (pred = 1) AS pp, count(*) FILTER (label = 1) AS p, count(*) AS n FROM e"
F1 = """f0 AS (SELECT l AS label, count(*) FILTER (label = l AND pred = l) AS tp, count(*) FILTER (label = l) AS support, count(*) FILTER (pred = l) AS predicted FROM e, (VALUES (0), (1)) v(l) GROUP BY l),
f1 AS (SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc, support FROM f0),
f2 AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f FROM f1)"""


def _co_round() -> str:
    c = CORPUS
    for view, v in (("uni", V0), ("bi", V1)):
        c += train(f"m{view}", "train", view) + score(f"s{view}", f"m{view}", "pool", view, v)
    return c


def _co_validate() -> str:
    c = _co_round()
    for view in ("uni", "bi"):
        c += relabel(f"l{view}", f"s{view}", "pool", where=f"{CONF} >= {TAU}")
    for view, other, v in (("uni", "bi", V0), ("bi", "uni", V1)):
        c += union(f"b{view}", "train", f"l{other}") + train(f"n{view}", f"b{view}", view) + score(f"e{view}", f"n{view}", "test", view, v, carry="label")
    return out(c, "SELECT label, pred, count(*) AS n, 'unigrams' AS view FROM euni GROUP BY label, pred UNION ALL SELECT label, pred, count(*) AS n, 'bigrams' AS view FROM ebi GROUP BY label, pred")


def _holdout() -> str:
    c = CORPUS + train("mb", "train", "bi") + score("sb", "mb", "pool", "bi", V1) + relabel("lab", "sb", "pool") + union("mixed", "train", "lab") + train("m2", "mixed", "uni")
    return out(c + score("e", "m2", "test", "uni", V0, carry="label"), "SELECT id, label, pred, round(p1, 6) AS p1 FROM e")


def _growth_co() -> str:
    c = exchange()
    for view, other, v in (("uni", "bi", V0), ("bi", "uni", V1)):
        c += union(f"b{view}", "train", f"l{other}") + train(f"n{view}", f"b{view}", view) + score(f"e{view}", f"n{view}", "test", view, v, carry="label")
    return out(c, "SELECT u.id, u.label, u.pred AS uni_pred, b.pred AS bi_pred FROM euni u JOIN ebi b USING (id)")


OVER = f"""SELECT id, label, 0 AS copy FROM train WHERE label = 1 UNION ALL
SELECT id, label, CAST(copy AS INTEGER) FROM (SELECT id, label, unnest(generate_series(1, CAST(ceil(p / (n // 2)) AS BIGINT))) AS copy FROM train, z WHERE label = 0 AND n >= 2) WHERE {HALF('id', 'copy')}"""
BOTH = f"""SELECT id, label, 0 AS copy FROM train WHERE label = 1 AND {HALF('id', "'p'")} UNION ALL
SELECT id, label, 0 FROM train, z WHERE label = 0 AND p // 2 < n UNION ALL
SELECT id, label, CAST(copy AS INTEGER) FROM (SELECT id, label, unnest(generate_series(1, CAST(ceil((p // 2 - n) / (n // 2)) AS BIGINT))) AS copy FROM train, z WHERE label = 0 AND n >= 2 AND p // 2 > n) WHERE {HALF('id', 'copy')}"""
RANDOM = f", coin AS (SELECT * REPLACE (CASE WHEN {HALF('id', chr(39) + 'coin' + chr(39))} THEN 0 ELSE 1 END AS label) FROM train)"


def sql() -> dict[str, str]:
    e = {
        "json_basic_stats": out(JSON + """,
k AS (SELECT CASE WHEN j IS NULL THEN 'Unable_to_parse' WHEN json_type(j, '$.delete') IS NOT NULL THEN 'Deleted' WHEN json_extract_string(j, '$.lang') IS NULL THEN 'NullPointerException'
  WHEN json_extract_string(j, '$.lang') = 'en' AND json_extract_string(j, '$.text') IS NULL THEN 'NullPointerException' ELSE json_extract_string(j, '$.lang') END AS category FROM j1)""",
            "SELECT category, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'Total_Rows', count(*) FROM k"),
        "extract_english": out(ENGLISH, "SELECT * FROM e"),
        "dedup_by_id": out(ENGLISH, "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY screen_name, created_at, followers, friends, retweets, favourites, text) AS rn FROM e) WHERE rn = 1"),
        "hashtag_join": out(JSON, f"SELECT line_no, CASE WHEN len(h) = 0 THEN 'null' ELSE array_to_string(h, '-') END AS hashtags FROM (SELECT line_no, {TAGS} AS h FROM j1 WHERE j IS NOT NULL AND json_type(j, '$.delete') IS NULL)"),
        "fuse_labeled": "SELECT origin, label, count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT id, 'emotion' AS origin, CAST(CASE emotion WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS INTEGER) AS label FROM tweet_long UNION ALL SELECT id, 'gold', CASE label WHEN 4 THEN 1 WHEN 0 THEN 0 END FROM tweet_gold) WHERE label IS NOT NULL GROUP BY ALL",
        "crop_sentiment": "SELECT id, created_at, hashtags, text, retweet_flag, emotion, emoticons, unigrams FROM tweet_long WHERE emotion IN ('positive', 'negative')",
        "crop_neutral": "SELECT id, created_at, hashtags, text, retweet_flag, emotion, unigrams FROM tweet_long WHERE emotion = 'neutral'",
        "crop_no_retweet": "SELECT id, emotion, unigrams FROM tweet_long WHERE emotion IN ('positive', 'negative') AND retweet_flag = 0",
        "remove_low_freq": out(DOCS + f""",
t AS (SELECT id, unnest({toks('lower(unigrams)')}) AS word, generate_subscripts({toks('lower(unigrams)')}, 1) AS i FROM docs),
k AS (SELECT word FROM t GROUP BY word HAVING count(*) >= {LOW})""", "SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM t SEMI JOIN k USING (word) GROUP BY id HAVING count(*) >= 4"),
        "min_tokens": f"SELECT id, unigrams FROM tweet_long WHERE len({toks('unigrams')}) >= 4",
        "entity_mentions": f"SELECT id, created_at, unigrams, entity FROM (SELECT id, created_at, unigrams, unnest({toks('lower(text)')}) AS entity FROM tweet_long) WHERE entity IN ({', '.join(s(x) for x in K.ENTITIES)})",
        "word_count": out(chain(True), f"SELECT word, count(*) AS n FROM (SELECT unnest({toks('cleaned')}) AS word FROM c9) GROUP BY word"),
        "pos_neg_dictionary": f"SELECT word, count(*) FILTER (emotion = 'positive') AS n_positive, -count(*) FILTER (emotion = 'negative') AS n_negative FROM (SELECT emotion, hashtags, unnest({toks('unigrams')}) AS word FROM tweet_long WHERE emotion IN ('positive', 'negative')) WHERE NOT list_contains(string_split(coalesce(hashtags, 'null'), '-'), word) GROUP BY word",
        "normalize_ws": text_query(x_ws("text")),
        "slang_replace": text_query(x_slang("lower(text)"), True),
        "clear_text": text_query(x_clear("text")),
        "drop_mentions": text_query(x_mentions("text")),
        "squeeze_repeats": text_query(x_squeeze("lower(text)")),
        "negate_verbs": f"SELECT id, {x_verbs('a')} AS out FROM (SELECT id, string_split(lower(text), ' ') AS a FROM tweet_long)",
        "negate_adjectives": f"SELECT id, {x_adjectives('a')} AS out FROM (SELECT id, string_split(lower(text), ' ') AS a FROM tweet_long)",
        "strip_non_ascii": text_query(x_ascii("text")),
        "drop_short_words": text_query(x_short(x_ascii("text"))),
        "letters_only": text_query(x_letters("text")),
        "remove_stopwords": text_query(x_stop("lower(text)")),
        "bigrams": f"SELECT id, coalesce(array_to_string([a[i] || '_' || a[i + 1] FOR i IN range(1, len(a))], ' '), '') AS out FROM (SELECT id, {toks('unigrams')} AS a FROM tweet_long)",
        "emoticon_counts": f"SELECT id, CAST(len(h) AS INTEGER) AS n_happy, CAST(len(s) AS INTEGER) AS n_sad, coalesce(array_to_string(h, ' '), '') AS happy, coalesce(array_to_string(s, ' '), '') AS sad FROM (SELECT id, {HITS(K.HAPPY, 'text')} AS h, {HITS(K.SAD, 'text')} AS s FROM tweet_long)",
        "emotion_label": f"SELECT id, {EMOTION} AS emotion FROM (SELECT id, len({HITS(K.HAPPY, 'text')}) AS h, len({HITS(K.SAD, 'text')}) AS s FROM tweet_long)",
        "preprocess_text": out(chain(False) + f""",
e0 AS (SELECT id, len({HITS(K.HAPPY, 'marked')}) AS h, len({HITS(K.SAD, 'marked')}) AS s, cleaned FROM c9),
e1 AS (SELECT id, {EMOTION} AS emotion, cleaned FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY emotion, cleaned) AS rn FROM e1 WHERE emotion IN ('positive', 'negative', 'neutral'))""", "SELECT id, emotion, cleaned FROM e2 WHERE rn = 1"),
        "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
        "lexicon_load": out(LEX, "SELECT lemma, pos, round(score, 6) AS score FROM lexicon"),
        "pos_class": out(LEX, f"SELECT word, tag, {POS} AS pos FROM tags"),
        "lexicon_score": out(lex_score("coalesce(unigrams, '')"), "SELECT id, round(score, 6) AS score FROM scored"),
        "lexicon_score_in_context": out(lex_score("lower(coalesce(text, ''))", True), "SELECT id, round(score, 6) AS score FROM scored"),
        "lexicon_confusion": out(lex_score("coalesce(unigrams, '')") + """,
k AS (SELECT CASE WHEN score = 0 THEN 'Neutral-' || emotion WHEN score > 0 AND emotion = 'positive' THEN 'True_Positive' WHEN score > 0 AND emotion = 'negative' THEN 'False_Negative'
  WHEN score < 0 AND emotion = 'negative' THEN 'True_Negative' WHEN score < 0 AND emotion = 'positive' THEN 'False_Positive' END AS category FROM scored)""", "SELECT category, count(*) AS n FROM k WHERE category IS NOT NULL GROUP BY category"),
        "lexicon_agree": out(lex_score("coalesce(unigrams, '')"), f"SELECT id, emotion, round(score, 6) AS score FROM scored WHERE {AGREES}"),
        "entity_sentiment_ts": out(lex_score("coalesce(unigrams, '')"), f"SELECT entity, epoch_ms(try_strptime(substr(created_at, 5), '%b %d %H:%M:%S +0000 %Y')) AS ts, CAST(sign(score) AS INTEGER) AS sentiment FROM scored, (SELECT unnest({arr(K.ENTITIES)}) AS entity) WHERE contains(unigrams, entity) AND {AGREES} AND try_strptime(substr(created_at, 5), '%b %d %H:%M:%S +0000 %Y') IS NOT NULL"),
        "term_freq": out(DOCS, "SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(uni) AS token FROM docs) GROUP BY ALL"),
        "bigram_freq": out(DOCS, "SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(bi) AS token FROM docs) GROUP BY ALL"),
        "nb_train": out(CORPUS + train("m", "train", "uni"), f"""SELECT token, 0 AS label, round(ln(n0 + 1.0) - ln(t0 + {V0}.0), 6) AS theta FROM m_cond, m_prior UNION ALL SELECT token, 1, round(ln(n1 + 1.0) - ln(t1 + {V0}.0), 6) FROM m_cond, m_prior
UNION ALL SELECT NULL, 0, round(ln(d0 + 1.0) - ln(d0 + d1 + 2.0), 6) FROM m_prior UNION ALL SELECT NULL, 1, round(ln(d1 + 1.0) - ln(d0 + d1 + 2.0), 6) FROM m_prior"""),
        "nb_predict": out(PREDICT, "SELECT id, label, pred FROM e"),
        "nb_posterior": out(PREDICT, "SELECT id, round(raw0, 6) AS raw0, round(raw1, 6) AS raw1, round(p1, 6) AS p1 FROM e"),
        "nb_label_counts": out(ROUND, "SELECT pred, count(*) AS n FROM e GROUP BY pred"),
        "nb_random_baseline": out(CORPUS + RANDOM + train("m", "coin", "uni") + score("s", "m", "pool", "uni", V0) + relabel("lab", "s", "pool") + union("mixed", "coin", "lab") + train("m2", "mixed", "uni") + score("e", "m2", "test", "uni", V0, carry="label"), "SELECT count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM e"),
        "self_train_round": out(ROUND, f"SELECT id, {SPLIT} FROM e"),
        "self_train_loop": self_loop(5),
        "self_train_growth": out(growth("pool") + score("e", "m2", "test", "uni", V0, carry="label"), "SELECT id, label, pred, round(p1, 6) AS p1 FROM e"),
        "self_train_transductive": out(growth("test") + score("a", "m2", "test", "uni", V0), 'SELECT s.pred AS before, a.pred AS "after", count(*) AS n FROM s JOIN a USING (id) GROUP BY ALL'),
        "label_counts": out(DOCS, "SELECT count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, count(*) FILTER (label IS NULL) AS n_null FROM docs"),
        "validate_pseudo_labels": out(CORPUS + train("m", "train", "uni") + score("s", "m", "pool", "uni", V0) + relabel("lab", "s", "pool", where=f"{CONF} >= {TAU}") + union("mixed", "train", "lab") + train("m2", "mixed", "uni") + score("e", "m2", "test", "uni", V0, carry="label"), "SELECT count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM e"),
        "sample_per_class": out(ROUND, "SELECT id, pred, CAST(rn AS INTEGER) AS rn FROM (SELECT id, pred, row_number() OVER (PARTITION BY pred ORDER BY id) AS rn FROM e) WHERE rn <= 100"),
        "split_audit": out(ROUND, f"SELECT count(*) AS n_pool, count(*) FILTER ({CONF} >= {TAU}) AS n_high, count(*) FILTER ({CONF} < {TAU}) AS n_low, (SELECT count(*) FROM pool) - count(*) AS n_missing FROM e"),
        "co_train_round": out(_co_round(), f"SELECT 0 AS view, id, {SPLIT} FROM suni UNION ALL SELECT 1, id, {SPLIT} FROM sbi"),
        "co_train_loop": co_loop(6),
        "co_train_growth": _growth_co(),
        "co_train_label_counts": out(exchange(), "SELECT u.label AS uni_label, b.label AS bi_label, count(*) AS n FROM luni u JOIN lbi b USING (id) GROUP BY ALL"),
        "co_train_holdout": _holdout(),
        "imbalance_distance": out(CORPUS + "," + SIZES, "SELECT p, n, round(abs(p - n) / (p + n), 6) AS distance, abs(p - n) / (p + n) > 0.2 AS augment FROM z"),
        "undersample": out(CORPUS + "," + SIZES, "SELECT id, label FROM train WHERE label = 0 UNION ALL SELECT id, label FROM (SELECT id, label, n, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) AS rn FROM train, z WHERE label = 1) WHERE rn <= n"),
        "oversample": out(CORPUS + "," + SIZES, OVER),
        "resample_both": out(CORPUS + "," + SIZES, BOTH),
        "blankout": out(CORPUS + "," + BLANK, "SELECT id, CAST(copy AS INTEGER) AS copy, array_to_string(uni, ' ') AS unigrams FROM blank"),
        "balanced_self_train": balanced(BLANK + ", extra AS (SELECT id, 0 AS label, uni FROM blank)"),
        "balanced_self_train_embeddings": balanced(SYN + f", extra AS (SELECT id, 0 AS label, list({_SYN_WORD} ORDER BY i) AS uni FROM k2 GROUP BY id, copy)"),
        "balanced_self_train_sampling": balanced(SIZES + f""",
hp AS (SELECT count(*) AS hp FROM train WHERE label = 1 AND {HALF('id', "'p'")}),
extra AS (SELECT id, 0 AS label, uni FROM (SELECT id, uni, unnest(generate_series(1, CAST(ceil((hp - n) / (n // 2)) AS BIGINT))) AS copy FROM train, z, hp WHERE label = 0 AND n >= 2 AND n < hp) WHERE {HALF('id', 'copy')})""", f"(label <> 1 OR {HALF('id', chr(39) + 'p' + chr(39))})"),
        "balanced_self_train_pass_through": out(CORPUS + "," + SIZES + ", fused AS (SELECT id, label, uni FROM train WHERE label = 0 UNION ALL SELECT id, label, uni FROM (SELECT id, label, uni, n, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) AS rn FROM train, z WHERE label = 1) WHERE rn <= n)" + train("m", "fused", "uni") + score("e", "m", "pool", "uni", V0), f"SELECT id, {SPLIT} FROM e"),
        "slang_replace_joined": text_query(x_slang("lower(text)"), True),
        "remove_stopwords_joined": text_query(x_stop("lower(text)")),
        "negate_verbs_joined": f"SELECT id, {x_verbs('a')} AS out FROM (SELECT id, string_split(lower(text), ' ') AS a FROM tweet_long)",
        "negate_adjectives_joined": f"SELECT id, {x_adjectives('a')} AS out FROM (SELECT id, string_split(lower(text), ' ') AS a FROM tweet_long)",
        "commas_to_blanks": "SELECT id, replace(text, ',', ' ') AS out FROM tweet_long",
        "emoticon_counts_long": f"SELECT id, CAST(len({HITS(K.HAPPY_LONG, 'text')}) AS INTEGER) AS n_happy, CAST(len({HITS(K.SAD_LONG, 'text')}) AS INTEGER) AS n_sad FROM tweet_long",
        "co_train_accuracy": co_accuracy(6),
        "synonym_augment": out(CORPUS + "," + SYN, f"SELECT id, CAST(copy AS INTEGER) AS copy, string_agg({_SYN_WORD}, ' ' ORDER BY i) AS unigrams FROM k2 GROUP BY id, copy"),
        "predict_export": out(PREDICT, "SELECT id, label AS gold, pred FROM e"),
        "accuracy": out(PREDICT, "SELECT count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM e"),
        "confusion_matrix": out(PREDICT, "SELECT label, pred, count(*) AS n FROM e GROUP BY ALL"),
        "f1_by_label": out(PREDICT + "," + F1, 'SELECT label, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f, 6) AS f1, support FROM f2'),
        "weighted_f1": out(PREDICT + "," + F1, "SELECT round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM f2"),
        "au_prc": out(PREDICT + f", k AS ({COUNTS})", "SELECT round(CASE WHEN pp = 0 THEN p / n ELSE (tp / p) * (tp / pp) + (1 - tp / p) * (tp / pp + p / n) / 2 END, 6) AS au_prc FROM k"),
        "co_validate": _co_validate(),
    }
    from lexloom.plans.queries import TEMPORAL, TEMPORAL_CO, TEMPORAL_LU

    e |= {n: temporal(k, p, False) for n, (k, p) in TEMPORAL.items()}
    e |= {n: temporal(k, p, True) for n, (k, p) in TEMPORAL_LU.items()}
    e |= {n: temporal_co(k, p) for n, (k, p) in TEMPORAL_CO.items()}
    return e
