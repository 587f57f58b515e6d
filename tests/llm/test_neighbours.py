import math

import numpy as np
import pytest

from textplan.llm import neighbours
from textplan.llm.neighbours import nearest
from tests.oracle import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, n int"


def brute(rows, k, step=20):
    known = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v) and any(v):
            known[(i, tuple(np.float32(v).tolist()))] = np.float32(v).astype(float)
    items = sorted(known.items())
    out = []
    for (i, _), q in items:
        if i % step == 0:
            s = sorted((-sum(float(a) * float(b) for a, b in zip(q, x, strict=True)), j) for (j, _), x in items if j != i)[:k]
            out += [(i, r + 1, j, -p) for r, (p, j) in enumerate(s)]
    return sorted(out)


def data(n=400):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist(), 1, 2) for i in range(n)]
    rows += [(n + i, rows[3][1], 1, 2) for i in range(130)]  # copies
    rows += [(5000, None, 1, 1), (5020, [0.0] * 8, 1, 1), (5040, [1.0] * 7 + [None], 1, 1), (5060, [1.0] * 7 + [float("nan")], 1, 1), (5080, [float("inf")] + [1.0] * 7, 1, 1), (5100, [1.0] * 3, 1, 1), (None, [1.0] * 8, 1, 1), rows[40], (-20, [9.0] * 8, None, None)]
    return rows


@pytest.mark.parametrize("part", [4096, 20, 4])
def test_exact_when_all_leaves_are_probed(spark, part, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "LEAF", 10)
    rows = data()
    out = nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k=20, share=1.0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())
    want = brute(rows, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_few_and_none(spark):
    rows = data()[:3] + [(20, [1.0] * 8, 1, 1)]
    got = sorted(tuple(r)[:3] for r in nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [w[:3] for w in brute(rows, 20)] and len(got) == 6
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got: dict[int, set[int]] = {}
    for r in nearest(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    t = rows.toPandas().sort_values("vec_id", ignore_index=True)
    x = np.stack(t.embedding).astype(float)
    hits = total = 0
    for i in np.flatnonzero(t.vec_id % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(t.vec_id.to_numpy()[np.argsort(-s)[:20]].tolist())
        hits += len(best & got[t.vec_id[i]])
        total += len(best)
    assert total > 1000 and hits / total >= 0.9


@pytest.mark.parametrize("n", [200, 500, 1000, 4000])
def test_recall_of_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got: dict[int, set[int]] = {}
    for r in nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, n, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (n // 20 * 20) >= 0.9
