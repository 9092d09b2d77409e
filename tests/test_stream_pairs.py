from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from huntframe.streaming.pairs import first_seen_stream, followed_stream

START = datetime(2024, 1, 1)
SCHEMA = "id int, user string, kind string, TimeGenerated timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder that a stream reads file by file."""

    def __init__(self, spark, folder, build):
        session = spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", "2")
        self.spark, self.folder, self.name = session, folder, "out"
        (folder / "in").mkdir()
        rows = session.readStream.schema(SCHEMA).parquet(str(folder / "in"))
        self.run = (build(rows).writeStream.outputMode("append").format("memory").queryName(self.name)
                    .option("checkpointLocation", str(folder / "state")).start())

    def send(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        self.run.processAllAvailable()
        return self.spark.table(self.name).collect()

    def state_rows(self):
        return sum(o["numRowsTotal"] for o in self.run.lastProgress["stateOperators"])


@pytest.mark.parametrize("salts", [1, 3])
def test_pairs_late_early_and_repeated(spark, tmp_path, salts):
    feed = Feed(spark, tmp_path, lambda rows: followed_stream(
        rows, ["user"], F.col("kind") == "a", F.col("kind") == "b", "PT1H", late="PT30M", key="id", salts=salts))
    try:
        out = feed.send((1, "bob", "a", at(0)), (2, "bob", "b", at(20)), (3, "bob", "b", at(0)), (4, "eve", "b", at(5)),
                        (5, None, "a", at(0)), (6, None, "b", at(1)), (7, "ann", "c", at(1)), (1, "bob", "a", at(0)))
        assert [r.id for r in out] == [2]
        # delivered again; a second first event makes no second row; the first event of eve comes after hers by arrival
        out = feed.send((2, "bob", "b", at(20)), (8, "bob", "a", at(10)), (9, "eve", "a", at(4)), (10, "bob", "b", at(60)), (11, "bob", "b", at(71)))
        assert sorted(r.id for r in out) == [2, 4, 10]
        # far later: what is older than the watermark no longer counts, and its state is gone
        feed.send((12, "zed", "c", at(0)), (13, "zed", "a", at(1000)))
        out = feed.send((14, "bob", "a", at(50)), (15, "bob", "b", at(55)), (16, "zed", "b", at(1001)))
        assert sorted(r.id for r in out) == [2, 4, 10, 16]
        for i in range(3):
            feed.send((20 + i, "zed", "a", at(3000 + 1000 * i)))
        assert feed.state_rows() <= 4 + 2 * salts
    finally:
        feed.run.stop()


def test_first_seen_per_bin(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda rows: first_seen_stream(rows, ["user"], "PT1H", "PT3H", late="PT10M"))
    try:
        feed.send((1, "bob", "x", at(5)), (2, "bob", "x", at(3)), (3, "bob", "x", at(70)), (4, "eve", "x", at(65)), (5, None, "x", at(5)))
        feed.send((6, "bob", "x", at(300)), (7, "eve", "x", at(250)), (8, "late", "x", at(10)))
        out = feed.send((9, "end", "x", at(2000)))
        # bob is new in hour 0, known in hour 1, and hour 5 looks back to hours 2 to 4; eve's hour 4 reaches back to hour 1
        assert sorted((r.user, r.TimeGenerated, r.FirstSeen, r.LastSeen, r.n) for r in out if r.user in ("bob", "eve")) == [
            ("bob", at(0), at(3), at(5), 2), ("bob", at(300), at(300), at(300), 1), ("eve", at(60), at(65), at(65), 1)]
        feed.send((10, "end", "x", at(9000)))
        assert feed.state_rows() <= 6
    finally:
        feed.run.stop()


def test_history_is_whole_bins(spark):
    with pytest.raises(ValueError):
        first_seen_stream(spark.createDataFrame([], SCHEMA), ["user"], "PT2H", "PT3H")
