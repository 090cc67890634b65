from tessera.streaming.windows import read_events, windowed


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed(read_events(spark, str(tmp_path / "in"), files_a_trigger=1), lateness="3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 2)) for r in df.collect())
    assert key(spark.table("windowed")) == key(windowed(batch))
