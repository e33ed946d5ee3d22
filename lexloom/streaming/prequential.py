"""Structured Streaming: prequential evaluation, and windowed counts with late data.

A micro-batch is first scored with the model of all earlier batches, then its
counts are added to the model. The model is a folder of versions, each the running total
after one batch: a batch reads the newest version before its own and writes its own, so the work does not
grow with the number of batches, and a repeated batch (after a failure) reads the same version and
overwrites its own instead of adding its counts twice. Versions older than the one read are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import bayes as B

_COND = "token string, n0 bigint, n1 bigint"
_PRIOR = "docs0 bigint, docs1 bigint, terms0 bigint, terms1 bigint"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches with a complete version: the prior is written last."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/prior")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(n.getName().split("=")[1]) for n in names if n.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def stored_model(spark: SparkSession, path: str, before: int | None = None) -> B.Model:
    """The model of all batches under ``path`` (of those before ``before``); no counts if there are none."""
    at = [v for v in _versions(spark, path) if before is None or v < before]

    def read(kind: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{kind}/batch={at[-1]}") if at else spark.createDataFrame([], schema)

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs0", "docs1", "terms0", "terms1")]
    return B.Model(read("cond", _COND), read("prior", _PRIOR).agg(*sums))


def step(batch: DataFrame, batch_id: int, path: str, tokens: str = "uni", key: str = "id", v: int = B.UNI) -> None:
    """Test, then train: writes (batch, n, n_ok) and the running total. For ``foreachBatch``."""
    spark = batch.sparkSession
    batch = batch.persist()
    m = stored_model(spark, path, batch_id)
    s = B.score(batch.filter(F.col("label").isNotNull()), m, tokens, key, ("label",), v)
    s.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("n_ok")).withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/metric/batch={batch_id}")
    new = B.add(m, B.train(batch, tokens))
    new.cond.write.mode("overwrite").parquet(f"{path}/cond/batch={batch_id}")
    new.prior.write.mode("overwrite").parquet(f"{path}/prior/batch={batch_id}")
    batch.unpersist()
    old = [x for x in _versions(spark, path) if x < batch_id][:-1]
    for x in old:
        for kind in ("prior", "cond"):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/batch={x}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(stream: DataFrame, path: str, **kw) -> None:
    """Consume all that a stream of labelled rows holds now."""
    q = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: step(df, i, path, **kw)).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per window and key; rows later than ``late`` behind the newest are dropped when streaming."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
