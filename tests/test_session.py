import glob
import time

import pytest
from pyspark.sql import functions as F

from huntframe.session import SHUFFLE_CLEANUP, store


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    counted = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    store(counted, str(tmp_path / "counted"))
    until = time.time() + 20  # executors are told, not waited for
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert spark.read.parquet(str(tmp_path / "counted")).agg(F.sum("n")).first()[0] == 10_000
    assert counted.count() == 100
    store(counted.limit(7), str(tmp_path / "counted"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "counted")).count() == 7
    with pytest.raises(Exception, match="already exists"):
        store(counted, str(tmp_path / "counted"))
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
