import random

import pytest
from pyspark.sql import functions as F

from siftlog.llm import common


@pytest.mark.parametrize("by_level", [False, True])
def test_rows_of_a_hot_bucket_stay_in_proportion(spark, monkeypatch, by_level):
    """A bucket of 100 blocks: no row of it is written for each of them, and all its pairs meet."""
    monkeypatch.setattr(common, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(common, "LEVEL_FROM", 4)
    rng = random.Random(8)
    sizes = {i: rng.choice([10, 11, 12, 40, 41]) for i in range(400)}
    posts = spark.createDataFrame([(i, 7) for i in sizes] + [(i, 8) for i in range(3)], "id long, post long")
    traits = spark.createDataFrame(list(sizes.items()), "id long, size int")
    tried, rows = [], {}
    real = common.written

    def written(df, label, release=False):
        table = real(df, label, release)
        rows[label] = table.count()
        return table

    def verify(pairs):
        tried.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs.where("false")

    def admit(x, y):
        return F.least(f"{x}.size", f"{y}.size") >= 0.8 * F.greatest(f"{x}.size", f"{y}.size") - 1e-9

    monkeypatch.setattr(common, "written", written)
    common.bucket_links(posts, verify, "hot", traits, admit, level=F.floor(F.log("size") / F.log(F.lit(1.2625))) if by_level else None)
    assert rows["hot-rest"] <= 403
    want = {(a, b) for a in sizes for b in sizes if a < b and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])}
    assert tried[0] | tried[1] == want and not tried[0] & tried[1]
