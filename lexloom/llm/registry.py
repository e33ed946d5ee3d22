"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import langid, leak, lookalike, mixing, pii, subjects, toxic
from lexloom.session import cut

Q: dict = {}
SQL: dict[str, str] = {}


def q(f):
    Q[f.__name__] = f
    return f


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(cols or ("text",)))


def _names(spark, d):
    return pii.learn_names(documents(spark, d), table(spark, d, "name_list"))


SECRET = b"change this key before use"


def _protected(spark, d):
    return pii.protect(documents(spark, d, "text", "screen_name"), _names(spark, d), SECRET)


@q
def p4_found(spark, d):
    return pii.pieces(_protected(spark, d))


@q
def p4_redacted(spark, d):
    return _protected(spark, d).drop("pieces")


@q
def p4_placeholders(spark, d):
    """What stands for what, and whether numbers are valid in their format: the table that links equal values, to be kept secret."""
    return _protected(spark, d).select(F.inline("pieces")).drop("field_name").groupBy("kind", "piece", "placeholder", "valid").agg(F.count("*").alias("n"))


@q
def p5_found(spark, d):
    return lookalike.pairs(documents(spark, d))


@q
def p5_canonical(spark, d):
    return lookalike.canonical(documents(spark, d)).select("doc_id", "class_id", "n_links", "changed", F.md5("canonical_text").alias("canonical_md5"))


def _languages(spark, d):
    docs = documents(spark, d, "text", "lang")
    return langid.detect(docs.withColumnRenamed("lang", "label"), langid.train(table(spark, d, "lang_sample"), docs), carry=("label",))


@q
def p6_found(spark, d):
    r = langid.relabelled(_languages(spark, d), "label")
    return r.select("doc_id", F.inline("segments")).select("doc_id", "seg_no", "lang")


@q
def p6_documents(spark, d):
    r = _languages(spark, d)
    return r.select("doc_id", "label", "lang", "confidence", F.to_json("proportions").alias("proportions"), F.size("segments").alias("n_segments"))


def _toxic(spark, d):
    docs = documents(spark, d, "text", "source")
    model = toxic.train(docs, table(spark, d, "review_label"))
    scored = cut(toxic.scan(docs.withColumn("source", F.lower(F.trim("source"))), model, carry=("source",)))
    law = toxic.calibrate(scored, model)
    return law, toxic.significance(scored, law)


@q
def p7_found(spark, d):
    law, scored = _toxic(spark, d)
    return toxic.flagged(scored, law).select("doc_id", "category").distinct()


@q
def p7_scores(spark, d):
    return _toxic(spark, d)[1].select("doc_id", "category", "score", "net", "p_value", "n_segments", "passage")


@q
def p7_rates(spark, d):
    law, scored = _toxic(spark, d)
    return toxic.rates(scored, law)


@q
def p8_found(spark, d):
    return leak.find(documents(spark, d), table(spark, d, "benchmark_item"))


@q
def p8_items(spark, d):
    items = table(spark, d, "benchmark_item")
    return leak.by_item(leak.find(documents(spark, d), items), items)


def _mix(spark, d):
    return mixing.mix(documents(spark, d, "text", "source"), table(spark, d, "source_target"))


@q
def p9_mix(spark, d):
    return _mix(spark, d)[0]


@q
def p9_shares(spark, d):
    return _mix(spark, d)[1]


def _char_mix(spark, d):
    """The same mix with sizes in characters, which SQL can count."""
    return mixing.mix(documents(spark, d, "text", "source"), table(spark, d, "source_target"), size=F.length("text"))


@q
def p9_char_mix(spark, d):
    return _char_mix(spark, d)[0].withColumnRenamed("n_tokens", "n_chars")


@q
def p9_char_shares(spark, d):
    s = _char_mix(spark, d)[1]
    return s.select("source", "n_docs", "clamped", "n_copies", F.col("n_tokens_source").alias("n_chars_source"), F.col("n_tokens_used").alias("n_chars_used"), *[F.round(c, 6).alias(c) for c in ("target_share", "max_repeat", "repeat", "reached_share")])


def _subjects(spark, d):
    return subjects.assign(documents(spark, d), table(spark, d, "subject_label"), table(spark, d, "subject_area"), table(spark, d, "lang_sample"))


@q
def p10_found(spark, d):
    return _subjects(spark, d)[0].select("doc_id", "subject")


@q
def p10_composition(spark, d):
    return subjects.composition(_subjects(spark, d)[0], documents(spark, d))


@q
def p10_topics(spark, d):
    _, topics = _subjects(spark, d)
    rows = [(t.lang, i, s, " ".join(w)) for t in topics for i, (s, w) in enumerate(zip(t.subject, t.terms))]
    return spark.createDataFrame(rows, "lang string, topic int, subject string, top_terms string")


def _form(c: str) -> str:
    for a, b in lookalike.LIGATURES:
        c = f"replace({c}, '{a}', '{b}')"
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    return f"nfc_normalize(translate({c}, {lit(lookalike.FROM + lookalike.INVISIBLE)}, {lit(lookalike.TO)}))"


def _kept(c: str, kept: str) -> str:
    return f"length(regexp_replace({c}, '[^{kept}]', '', 'g'))"


_PLAINER = lookalike.BLANKS + lookalike.HYPHENS + lookalike.FULL + lookalike.MATH + lookalike.INVISIBLE + "".join(x for x, _ in lookalike.LIGATURES)
_CLASSES = f"""WITH s AS (SELECT doc_id, text, md5(text) AS id, {_form('text')} AS form,
  {_kept('text', '\\p{L}')} AS letters, {_kept('text', '\\p{Cyrillic}')} AS cyr, {_kept('text', '\\p{Latin}')} AS lat,
  {_kept(f"translate(text, '{lookalike.CYRILLIC}', '')", '\\p{Cyrillic}')} AS own_cyr, {_kept(f"translate(text, '{lookalike.AS_LATIN}', '')", '\\p{Latin}')} AS own_lat
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, letters - CASE WHEN own_cyr > own_lat OR (own_cyr = own_lat AND cyr > lat) THEN cyr ELSE lat END AS strange FROM s),
k AS (SELECT *, count(*) OVER (PARTITION BY form) AS n FROM (SELECT DISTINCT id, text, form, strange FROM t)),
o AS (SELECT *, CASE WHEN n > 1 THEN length(text) - length(regexp_replace(translate(text, '{_PLAINER}', ''), '\\p{{M}}', '', 'g')) END AS odd FROM k),
c AS (SELECT DISTINCT form, first_value(id) OVER (PARTITION BY form ORDER BY strange, odd, length(text), id) AS class_id FROM o)"""
SQL["p5_found"] = f"WITH t AS (SELECT doc_id, text, {_form('text')} AS form FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"
SQL["p5_canonical"] = _CLASSES + " SELECT doc_id, class_id, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, id) AS n_links, id <> class_id AS changed, class_id AS canonical_md5 FROM t JOIN c USING (form)"


# the level by position in the order of cap / weight: that of the first source which it does not put over its cap
_MIX = """WITH d AS (SELECT doc_id, lower(trim(source, ' ')) AS source, coalesce(length(text), 0) AS n_chars FROM documents),
t AS (SELECT lower(trim(source, ' ')) AS source, sum(target_share) AS w, max(max_repeat) AS cap FROM source_target WHERE source IS NOT NULL GROUP BY 1),
h AS (SELECT source, sum(n_chars) AS n, count(*) AS n_docs FROM d GROUP BY 1),
s AS (SELECT coalesce(t.source, h.source) AS source, coalesce(w, 0) AS w, coalesce(n, 0) AS n, coalesce(n_docs, 0) AS n_docs, coalesce(cap, 0) AS cap FROM t FULL JOIN h USING (source)),
o AS (SELECT *, n * cap AS most, sum(n) OVER () AS total, sum(w) OVER () AS all_w, coalesce(sum(n * cap) OVER b, 0) AS kept, coalesce(sum(w) OVER b, 0) AS gone
  FROM s WHERE w > 0 AND cap > 0 AND n > 0 WINDOW b AS (ORDER BY n * cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - kept) / (all_w - gone), most / w) FILTER (WHERE (total - kept) / (all_w - gone) * w <= most + 1e-9) AS level FROM o),
p AS (SELECT s.*, CASE WHEN w > 0 AND cap > 0 AND n > 0 THEN level IS NULL OR level * w > n * cap + 1e-9 ELSE false END AS clamped, CASE WHEN NOT (w > 0 AND cap > 0 AND n > 0) THEN 0 WHEN level IS NULL OR level * w > n * cap + 1e-9 THEN cap ELSE level * w / n END AS repeat FROM s, l),
u AS (SELECT doc_id, source, n_chars, CAST(floor(repeat) + CASE WHEN CAST('0x' || substr(md5('7|' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < repeat - floor(repeat) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM d JOIN p USING (source))"""
SQL["p9_char_mix"] = _MIX + " SELECT * FROM u WHERE copies > 0"
SQL["p9_char_shares"] = (
    _MIX
    + """, g AS (SELECT source, sum(n_chars * copies) AS used, sum(copies) AS n_copies FROM u GROUP BY 1)
SELECT p.source, n_docs, clamped, CAST(coalesce(n_copies, 0) AS BIGINT) AS n_copies, CAST(n AS BIGINT) AS n_chars_source, CAST(coalesce(used, 0) AS BIGINT) AS n_chars_used, round(CAST(w AS DOUBLE), 6) AS target_share, round(CAST(cap AS DOUBLE), 6) AS max_repeat, round(CAST(repeat AS DOUBLE), 6) AS repeat, round(coalesce(used, 0) / sum(used) OVER (), 6) AS reached_share FROM p LEFT JOIN g USING (source)"""
)


def queries() -> dict:
    return dict(Q)


def sql() -> dict[str, str]:
    return dict(SQL)
