import pytest
from pyspark.sql import functions as F

from diffloom.storage import CLEANUP, numbered, remove, shared_folder, stored, tracked, with_place


class Conf(dict):
    def get(self, name, default=None):
        return dict.get(self, name, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


@pytest.mark.parametrize("master", ["yarn", "k8s://x", "local-cluster[2,1,1024]", "spark://h:7077"])
def test_executors_need_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master=master))
    folder = shared_folder(Session(spark_master=master, spark_checkpoint_dir="hdfs:///x/"))
    assert folder.startswith("hdfs:///x/") and "//" not in folder[8:]


def test_one_process_may_use_its_own_folder():
    assert shared_folder(Session(spark_master="local[3]")) != shared_folder(Session(spark_master="local"))


def test_places_follow_the_order_over_many_partitions(spark):
    table = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("x"), F.lit(1).alias("same"))
    rows = numbered(table, "x").collect()
    assert all(r.x == r.number for r in rows) and len(rows) == 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ties = with_place(table.select("same"), "same")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ties.select("_part").distinct().count() > 1


def test_part_numbers_are_read_as_numbers(spark):
    names = spark.createDataFrame([("part-99999-a.parquet",), ("part-100000-b.parquet",)], "n string")
    part = F.regexp_extract("n", r"part-(\d+)", 1).cast("long")
    assert [r.p for r in names.select(part.alias("p")).orderBy("p").collect()] == [99999, 100000]


def test_tracked_tables_can_be_removed(spark):
    before = stored(spark.range(3))
    with tracked() as paths:
        inside = stored(spark.range(5))
    assert inside.count() == 5 and len(paths) == 1
    remove(spark, paths)
    with pytest.raises(Exception):
        spark.read.parquet(paths[0]).count()
    assert before.count() == 3


def test_setting_for_shuffle_files_is_put_back(spark):
    before = spark.conf.get(CLEANUP, None)
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert table.count() == 7 and spark.conf.get(CLEANUP, None) == before
    with pytest.raises(Exception):
        stored(spark.range(3).select(F.raise_error(F.lit("no"))))
    assert spark.conf.get(CLEANUP, None) == before
