import os
import subprocess
import sys

import numpy as np

from siftlog.llm import pivot_index


def brute(rows, limit=0.93):
    sound = {i: np.array(v, float) for i, (_, v, label) in enumerate(rows) if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.max(np.abs(v)) for i, v in sound.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = [(i, j) for i in unit for j in unit if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit]
    return linked


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for k in range(0, n // 2, 4):
        for c in range(1, 4):
            base[k + c] = base[k] + rng.normal(size=dim) * np.linalg.norm(base[k]) * rng.uniform(0.0, 0.35) / dim**0.5
    return base


def test_recall_and_precision(spark):
    v = clustered(1500, 32, 0)
    rows = [(i, v[i].astype(np.float32).tolist(), int(i // 4 % 3)) for i in range(len(v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(df).collect()}
    linked = brute(rows)
    n_links = np.zeros(len(rows), int)
    for i, j in linked:
        n_links[i] += 1
        n_links[j] += 1
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= n_links).all()
    assert found.sum() / n_links.sum() >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    center = rng.normal(size=16)
    v = [center + rng.normal(size=16) * 0.1 for _ in range(200)]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    monkeypatch.setattr(pivot_index, "BLOCK", 32)
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_vectors(df).collect()}
    linked = brute(rows)
    assert sum(got.values()) >= 0.98 * 2 * len(linked)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
        (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1), (12, [1e30, 0.0], 1), (None, [1.0, 0.01], 1), (14, [-1.0, 0.0], 1), (15, [-0.0, -2.0], 2), (16, [0.0, -1.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, entry string")
    got = sorted(((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in pivot_index.near_vectors(df).collect()), key=str)
    linked = brute(rows)
    counts = [0] * len(rows)
    for i, j in linked:
        counts[i] += 1
        counts[j] += 1
    assert sorted((str(r[0]), c) for r, c in zip(rows, counts)) == sorted((a, b) for a, b, _, _ in got)
    by = {a: c for a, _, c, _ in got}
    assert by["1"] == by["2"] == by["12"] == by["None"] == 1 and by["16"] == 15
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivot_index.near_vectors(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, source)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[1] > 0.95 * sizes[0] and 0.8 * sizes[1] < sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] < sizes[3]
    assert sum(r["length"] for r in docs.collect()) == sum(r["doc_tokens"] for r in docs.where("start = 0").collect())
    assert corpus_pipeline.run(spark, source).count() == sizes[5]


def test_pipeline_on_nothing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_registry_and_guard():
    import __spark_entry__ as entry
    from siftlog.llm import registry

    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['siftlog.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op')]"
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr[-500:]
