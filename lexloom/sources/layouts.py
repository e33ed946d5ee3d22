"""Sources and sinks: delimited layouts, parquet, dictionaries, fused multi-path scans.

Rows with too few columns or a non-numeric id are dropped by the readers (count
them with ``operators.quarantine``); an empty file gives an empty DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of each delimited layout by position.
LAYOUTS = {
    "extract": ("\t", ["id", "screen_name", "created_at", "followers", "friends", "retweets", "favourites", "text"]),
    "prep_in": ("\t", ["id", "passthrough", "text"]),
    "prep_out": ("\t", ["id", "passthrough", "text", "emotion", "emoticons", "cleaned"]),
    "long": (",", ["id", "created_at", "hashtags", "text", "retweet_flag", "emotion", "emoticons", "unigrams", "opaque", "bigrams"]),
    "short": (",", ["id", "created_at", "opaque", "emotion", "opaque2", "unigrams", "bigrams"]),
    "short_labeled": (",", ["id", "created_at", "opaque", "emotion", "opaque2", "unigrams", "bigrams", "pseudo_label"]),
    "tsv01": ("\t", ["id", "label", "opaque", "text"]),
}
_INTS = {"retweet_flag", "label", "followers", "friends", "retweets", "favourites"}


def parse_layout(lines: DataFrame, layout: str, column: str = "value", least: int | None = None) -> DataFrame:
    """Named, typed columns of delimited lines; lines with under ``least`` columns or without a numeric id are dropped."""
    sep, names = LAYOUTS[layout]
    parts = F.split(F.col(column), sep, -1)
    least = len(names) if least is None else least

    def cell(i: int, n: str) -> Column:
        c = F.get(F.col("__p"), F.lit(i))
        if n == "id":
            return F.trim(F.regexp_replace(c, "\t$", "")).try_cast("bigint").alias(n)
        return (c.try_cast("int") if n in _INTS else c).alias(n)

    return lines.select(parts.alias("__p")).filter(F.size("__p") >= least).select(*[cell(i, n) for i, n in enumerate(names)]).filter(F.col("id").isNotNull())


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Text lines of several files or globs as column ``value``."""
    return spark.read.text(list(paths))


def read_layout(spark: SparkSession, layout: str, *paths: str) -> DataFrame:
    return parse_layout(read_lines(spark, *paths), layout)


def write_layout(df: DataFrame, layout: str, path: str) -> None:
    """Delimited text, sorted by id inside each file, as a MapReduce sink would leave it."""
    sep, names = LAYOUTS[layout]
    df.select(*[F.coalesce(F.col(n).cast("string"), F.lit("null")).alias(n) for n in names]).sortWithinPartitions("id").select(F.concat_ws(sep, *names).alias("value")).write.mode("overwrite").text(path)


def write_labeled(df: DataFrame, path: str, label: str = "pred") -> None:
    """Rows of the ``short`` layout with the predicted label as trailing column (SNK-05); ``read_layout("short_labeled", ...)`` reads them for the next round."""
    write_layout(df.withColumn("pseudo_label", F.col(label)), "short_labeled", path)


def write_predictions(df: DataFrame, path: str, line: str = "value", pred: str = "pred") -> None:
    """``(line,prediction)`` lines, the prediction as a decimal number (SNK-08)."""
    df.select(F.concat(F.lit("("), F.coalesce(line, F.lit("")), F.lit(","), F.col(pred).cast("double").cast("string"), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """(line, pred) of such a folder; other lines are dropped."""
    m = lambda i: F.regexp_extract("value", r"^\((.*),(-?[0-9]+(?:\.[0-9]+)?)\)$", i)
    return read_lines(spark, *paths).filter(m(2) != "").select(m(1).alias("line"), m(2).cast("double").cast("int").alias("pred"))


def read_augmented(spark: SparkSession, *paths: str) -> DataFrame:
    """``(label,text)`` lines of augmentation folders, one folder per iteration (SRC-05): label, text, iter.

    iter is the number at the end of the folder's name, NULL without one; malformed lines are dropped.
    """
    m = lambda i: F.regexp_extract("value", r"^\((-?[0-9]+(?:\.[0-9]+)?),(.*)\)$", i)
    n = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), r"([0-9]+)$", 1)
    return read_lines(spark, *paths).select("value", n.alias("n")).filter(m(1) != "").select(m(1).cast("double").cast("int").alias("label"), m(2).alias("text"), n.try_cast("int").alias("iter"))


def term_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """One term per line (stop-words, verbs; SRC-07): distinct, outer blanks dropped, blank lines left out."""
    return lines.select(F.trim(column).alias("word")).filter("word <> ''").distinct()


def label_of(emotion: Column, fallback: Column | None = None, otherwise: int | None = 0) -> Column:
    """The numeric label of a row: its emotion, else the pseudo-label column, else ``otherwise`` (None drops)."""
    c = F.when(emotion == "positive", 1).when(emotion == "negative", 0)
    if fallback is not None:
        c = c.when(emotion == "neutral", fallback.try_cast("double").cast("int"))
    return c.otherwise(F.lit(otherwise).cast("int"))


def label01(label: Column) -> Column:
    """0 / 4 labels as 0 / 1; anything else NULL."""
    return F.when(label == 4, 1).when(label == 0, 0).cast("int")


def fuse(*parts: DataFrame) -> DataFrame:
    """Gold rows and any number of pseudo-labelled parts as one bag; columns absent from a part are NULL."""
    out, *rest = parts
    for p in rest:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_series(df: DataFrame, path: str, entity: str = "entity") -> None:
    """Time-series sink: parquet partitioned by entity."""
    df.repartition(entity).sortWithinPartitions(entity, "ts").write.mode("overwrite").partitionBy(entity).parquet(path)


def slang_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """``term-replacement`` lines as (term, replacement); doubled blanks are collapsed."""
    p = F.split(F.col(column), "-", 2)
    return lines.select(F.get(p, F.lit(0)).alias("term"), F.regexp_replace(F.get(p, F.lit(1)), "  +", " ").alias("replacement")).filter("replacement is not null")


def antonym_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """``a,b`` lines in both directions."""
    p = F.split(F.col(column), ",", -1)
    ab = lines.select(F.get(p, F.lit(0)).alias("word"), F.get(p, F.lit(1)).alias("antonym")).filter("antonym is not null")
    return ab.union(ab.select("antonym", "word"))


def hashtag_sentiment(lines: DataFrame, column: str = "value") -> DataFrame:
    """``#tag<tab>value`` lines as (tag, sentiment in {-1, 1}); zero and malformed lines are dropped."""
    p = F.split(F.col(column), "\t", -1)
    v = F.get(p, F.lit(1)).try_cast("double")
    return lines.filter(F.col(column).startswith("#")).select(F.get(p, F.lit(0)).alias("tag"), F.signum(v).cast("int").alias("sentiment")).filter("sentiment <> 0")


def synonym_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """``word<tab>n1<tab>n2...`` lines, lower-cased, as (word, neighbours)."""
    p = F.split(F.lower(F.col(column)), "\t", -1)
    return lines.select(F.get(p, F.lit(0)).alias("word"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("neighbours")).filter("size(neighbours) > 0")


def small_map(df: DataFrame, key: str, value: str, most: int = 100_000) -> dict:
    """A dictionary table as a Python dict for map literals; refused beyond ``most`` rows (``operators.dictionaries`` joins it instead)."""
    rows = df.select(key, value).filter(F.col(key).isNotNull() & F.col(value).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} dictionary rows: use operators.dictionaries.with_entries")
    return {r[0]: r[1] for r in sorted(rows)}
