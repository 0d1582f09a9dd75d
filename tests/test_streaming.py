from gridloom.streaming import states


def test_tie_line_stream(spark, tmp_path):
    bus = spark.createDataFrame([(1, 1, 500.0), (2, 2, 230.0), (3, 1, 230.0)], "ibus long, area long, baskv double")
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1, 2, "1", 0), ("2024-01-01 00:02:00", 1, 3, "1", 0), ("2024-01-01 00:03:00", 1, 2, "1", 1)], "ts string, ibus long, jbus long, ckt string, stat int")
    rows.selectExpr("cast(ts as timestamp) ts", "ibus", "jbus", "ckt", "stat").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, ibus long, jbus long, ckt string, stat int").parquet(str(tmp_path / "in"))
    for name, df, mode in (("ties", states.tie_line_states(stream, bus, [1]), "append"), ("out", states.outages(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("ties").count() == 2 and spark.table("out").first()["lines_out"] == 2
