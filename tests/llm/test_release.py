import time

from siftlog.llm import common


def test_shuffles_of_a_released_table_go_at_once(spark):
    """Not when the next query ends: the next one's own shuffles come on top of them."""

    def shuffles():
        return set(filter(None, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",")))

    before = shuffles()
    table = common.written(spark.range(5000).selectExpr("id % 70 AS k").groupBy("k").count(), "released", release=True)
    until = time.time() + 5
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert table.count() == 70
