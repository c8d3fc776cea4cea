from pyspark.sql import functions as F

from tracewright.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, x int")
    assert ingest.append_new(batch, path) == 2
    assert ingest.append_new(batch, path) == 0
    assert ingest.append_new(spark.createDataFrame([("b", 2), ("c", 3)], "id string, x int"), path) == 1
    assert spark.read.parquet(path).count() == 3


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_id", "id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    events.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_windows_stream_like_batch(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    for shape, by in ((ingest.activity, "event_type"), (ingest.visits, "user_id")):
        stream = shape(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(shape.__name__).outputMode("complete" if shape is ingest.activity else "append").start()
        q.processAllAvailable()
        q.stop()
        got = {tuple(r) for r in spark.table(shape.__name__).collect()}
        batch = {tuple(r) for r in shape(events).collect()}
        assert got <= batch and len(got) > 0.5 * len(batch), by
