import pytest

from care_analytics.session import checkpoint_dir, configure
from care_analytics.sources.warehouse import write_result


def test_checkpoint_dir_reads_session_setting(spark):
    d = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == d


def test_configure_keeps_existing_values(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "64m"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_write_result_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = write_result(df, str(tmp_path), "result")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2)]


def test_checkpoint_dir_without_a_setting_is_an_error(spark):
    class Unset:
        conf = {}

        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Unset)


def test_set_checkpoint_dir_counts_when_the_setting_is_missing():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return "file:/shared/here"

    assert checkpoint_dir(Session) == "file:/shared/here"
