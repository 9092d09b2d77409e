from datetime import datetime, timedelta

from huntframe.streaming.threshold import threshold_stream


def test_threshold_on_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("bob", start + timedelta(seconds=i)) for i in range(5)] + [("eve", start)] + [("end", start + timedelta(hours=5))]
    spark.createDataFrame(rows, "user string, TimeGenerated timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, TimeGenerated timestamp").parquet(str(tmp_path / "in"))
    alerts = threshold_stream(stream, ["user"], "PT10M", 3)
    run = (alerts.writeStream.outputMode("append").format("memory").queryName("alerts")
           .option("checkpointLocation", str(tmp_path / "cp")).start())
    run.processAllAvailable()
    run.stop()
    assert [(r.user, r.n, r.TimeGenerated) for r in spark.table("alerts").collect()] == [("bob", 5, start)]
