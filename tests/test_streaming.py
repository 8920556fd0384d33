"""The streamed panel equals the batch one."""

from pyspark.sql import functions as F

from tessella.streaming import daily_cells, read_events


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "value")
    days = [r.d for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").limit(6).collect()]
    batch = daily_cells(events.filter(F.to_date("ts") <= days[-2]), "user_id", "value")
    for i, d in enumerate(days):
        events.filter(F.to_date("ts") == d).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        for p in (tmp_path / f"tmp{i}").glob("part-*.parquet"):
            p.rename(tmp_path / "in" / f"{i}.parquet")
    stream = daily_cells(read_events(spark, f"{tmp_path}/in", events.schema), "user_id", "value")
    q = stream.writeStream.format("memory").queryName("cells").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.date, r.symbol): round(r.value, 6) for r in spark.table("cells").collect()}
    want = {(r.date, r.symbol): round(r.value, 6) for r in batch.collect()}
    assert {k: v for k, v in got.items() if k[0] <= days[-3]} == {k: v for k, v in want.items() if k[0] <= days[-3]} and got
