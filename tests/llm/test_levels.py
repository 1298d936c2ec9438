import random

from pyspark.sql import functions as F

from siftlog.llm import common


def test_large_buckets_meet_by_level(spark, monkeypatch):
    """Every pair of sizes that fit, in buckets that are cut into blocks or not, and only those."""
    monkeypatch.setattr(common, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(common, "LEVEL_FROM", 10)
    rng = random.Random(6)
    sizes = {i: rng.choice([1, 2, 3, 5, 10, 25, 80, 100, 101, 125, 126, 400]) for i in range(150)}
    posts = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])) for i in sizes for _ in range(2)]
    traits = spark.createDataFrame(list(sizes.items()), "id long, size int")
    tried = []

    def verify(pairs):
        tried.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs.where("false")  # so all that meet are seen

    def admit(x, y):
        return F.least(f"{x}.size", f"{y}.size") >= 0.8 * F.greatest(f"{x}.size", f"{y}.size") - 1e-9

    level = F.floor(F.log("size") / F.log(F.lit(1.2625)))
    common.bucket_links(spark.createDataFrame(posts, "id long, post long").distinct(), verify, "levels", traits, admit, level=level)
    of = {}
    for i, p in posts:
        of.setdefault(p, set()).add(i)
    want = {(a, b) for ids in of.values() for a in ids for b in ids if a < b and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])}
    assert max(map(len, of.values())) > 32 and tried[0] | tried[1] == want and not tried[0] & tried[1]
