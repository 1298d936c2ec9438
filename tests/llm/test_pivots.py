import numpy as np

from siftlog.llm import pivot_index


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2500, 64))
    center = rng.normal(size=64)
    v[:2000] = center / np.linalg.norm(center) + rng.normal(size=(2000, 64)) * 0.25 / 8
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_vectors(df).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= want).all()
    assert found.sum() / want.sum() >= 0.98


def test_pivots_are_apart():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = pivot_index.thinned(x)
    likeness = kept @ kept.T - 2 * np.eye(len(kept))
    assert likeness.max() < pivot_index.APART <= (x @ kept.T).max(1).min()
    assert (pivot_index.thinned(np.tile(x[:1], (5, 1))) == x[:1]).all()
