from pyspark.sql import functions as F

from lexloom.operators import bayes as B
from lexloom.plans import data as P
from lexloom.streaming import prequential as S


def test_prequential_equals_batch_model(spark, data, tmp_path):
    train = P.roles(spark, data)[0].select("id", "uni", "label")
    src = f"{tmp_path}/in"
    train.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(train.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.run(stream, f"{tmp_path}/model")
    m = S.stored_model(spark, f"{tmp_path}/model")
    whole = B.train(train, "uni")
    assert sorted(m.cond.collect()) == sorted(whole.cond.select("token", "n0", "n1").collect()) and tuple(m.prior.first()) == tuple(whole.prior.first())
    metric = spark.read.parquet(f"{tmp_path}/model/metric")
    assert metric.agg(F.sum("n")).first()[0] == train.count()


def test_windowed_counts(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    assert S.windowed_counts(e, "ts", "event_type", "1 day").agg(F.sum("n")).first()[0] == e.count()
