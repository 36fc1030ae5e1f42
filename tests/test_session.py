"""Session helpers: shuffle sizing, first-run detection, checkpoint folder."""

import os

from gradebook.session import checkpoint_dir, read_parquet_if_exists, shuffle_partitions_for


def test_shuffle_partitions_for():
    assert shuffle_partitions_for(0, 8) == 16
    assert shuffle_partitions_for(100 * 2**40, 8000) == 819200     # 100 TB at 128 MB
    assert shuffle_partitions_for(10 * 2**30, 8000) == 16000       # at least two waves


def test_read_parquet_if_exists(spark, tmpdir_):
    missing = os.path.join(tmpdir_, "nothing-here")
    assert read_parquet_if_exists(spark, missing) is None
    spark.range(3).write.parquet(os.path.join(tmpdir_, "t"))
    assert read_parquet_if_exists(spark, os.path.join(tmpdir_, "t")).count() == 3


def test_checkpoint_dir_is_read_from_the_session(spark):
    path = checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir()
