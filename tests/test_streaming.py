"""Pipelines over a stream of files."""

from docpipe.operators.stages import Context
from docpipe.streaming import run_stream, windowed_group


def test_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    rows = run_stream(stream, [{"$match": {"value": {"$gt": 1}}}, {"$project": {"_id": 0, "ts": 1, "value": 1}}], Context(spark, None))
    out = windowed_group(rows, "ts", "1 day", {"n": {"$sum": 1}}, late="1 day")
    query = out.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("days").agg({"n": "sum"}).first()[0] == events.where("value > 1").count()
