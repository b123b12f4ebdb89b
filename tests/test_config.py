import pytest
from weekloom import config


def test_local_folders_are_refused_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        config.on_shared_disk("file:/home/someone/.weekloom", local=False)
    assert config.on_shared_disk("file:/tmp/x", local=True) == "file:/tmp/x"
    assert config.on_shared_disk("hdfs://name/user/x", local=False) == "hdfs://name/user/x"


def test_working_tables_are_removed(spark):
    kept = config.stored_small(spark.range(5), "probe")
    assert kept.count() == 5
    path = kept.inputFiles()[0]
    config.clean_up(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
