import random
import re

import numpy as np
import pytest

from textplan.llm import mixing
from textplan.llm.mixing import fill_targets, mix_sources, walk

SCHEMA = "doc_id long, text string, source string, size string, order int"


def data(n=900):
    r = random.Random(8)
    rows = []
    for i in range(n):
        source = "src0" if i % 3 == 0 else r.choice(["a", "b", "é", "Z", None, "tiny"] if i % 50 == 0 else ["a", "b", "é", "Z", None])
        rows.append((i, r.choice([" ", "\n", "  "]).join("w" for _ in range(r.choice([0, 1, 5, 50, r.randint(1, 900)]))), source, "s", 1))
    return rows + [(None, "a b", "a", "s", 1), (5, None, None, None, None), (7, "x y z", "b", "s", 1), (7, "x y z", "b", "s", 1), (8, "word " * 9000, "b", "s", 1), (9, "", "empty", "s", 1)]


@pytest.mark.parametrize("block", [4096, 16])
def test_targets_are_met(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix_sources(df)
    assert out.columns == ["doc_id", "source", "order", *mixing.RESULT]
    got = out.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = sum(size(r[1]) for r in rows)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6 * total
    for i, s in enumerate(sources):
        own = [r for r in got if r.source == s]
        whole = sum(r["size"] for r in own)
        assert {r.source_size for r in own} == {whole}
        target = own[0].target
        assert target <= 2 * whole + 1e-9
        assert all(0 <= r.taken <= 2 * r["size"] and (r.taken == 0 if not r["size"] else r.taken % r["size"] == 0) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max([r["size"] for r in own] + [1])
        assert i >= 0
    again = mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_water_filling():
    assert fill_targets([10, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([20, 193.3333333, 96.6666667], rel=0.2)
    t = fill_targets([10, 100, 100], [5, 2, 1], 1.5, 2)
    assert sum(t) == pytest.approx(315) and t[0] == 20 and t[1] == pytest.approx(2 * t[2])
    assert fill_targets([], [], 1.5, 2) == [] and fill_targets([0, 0], [5, 2], 1.5, 2) == [0, 0]


def test_cube_keeps_probabilities_and_totals():
    r = np.random.default_rng(3)
    size = r.integers(1, 400, 60)
    p = r.random(60)
    mean = np.zeros(60)
    for i in range(3000):
        z = walk(p, size, np.random.default_rng(i).random(64), True, np.inf)
        assert set(z) <= {0.0, 1.0}
        mean += z
        assert abs((z - p) @ size) <= size.max() / 2 and abs(z.sum() - p.sum()) <= 3
        z = walk(p, size, np.random.default_rng(i).random(64), True, 0.01 * size.sum())
        assert set(z) <= {0.0, 1.0} and abs((z - p) @ size) <= 0.01 * size.sum()
    off = abs(mean / 3000 - p)  # the landing decides few documents by words, not by chance
    assert np.median(off) < 0.01 and (off < 0.03).mean() > 0.85
    flown = walk(p, size, r.random(64), False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs((flown - p) @ size) < 1e-6 and abs(flown.sum() - p.sum()) < 1e-9


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_words_are_within_tolerance_where_two_changes_allow_it(spark, block, monkeypatch):
    """Whatever other sources hold: a source lands by its own count, and one of several blocks is repaired too."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.02)  # that two of a dozen documents can nearly always reach
    r = random.Random(4)
    rows = [(i, "w " * r.randint(1, 30), "big", "s", 1) for i in range(600)]
    rows += [(1000 + i, "w " * r.randint(300, 1500), f"few{i % 8}", "s", 1) for i in range(96)]
    rows += [(2000 + i, "w " * r.randint(200, 800), f"long{i % 4}", "s", 1) for i in range(96)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(1,), share=0.7).collect()
    assert sum(g.target % g.source_size > 0 for g in got) > 0.9 * len(rows)
    for s in {g.source for g in got}:
        own = [g for g in got if g.source == s]
        assert abs(sum(g.taken for g in own) - own[0].target) <= 0.02 * own[0].target, s


def test_repair_finds_the_best_of_two_changes():
    r = np.random.default_rng(6)
    for n in [0, 1, 2, 3, 8, 30] * 40:
        gain = r.choice([-1, 1], n) * r.integers(1, 200, n).astype(float)
        error, tolerance = r.normal() * 150, r.choice([0.0, 0.5, 5.0])
        change = mixing.repair(gain, error, tolerance, r.random())
        best = min([abs(error), *(abs(error + gain[i]) for i in range(n)), *(abs(error + gain[i] + gain[j]) for i in range(n) for j in range(i))])
        left = abs(error + gain[change].sum())
        assert len(set(change)) == len(change) <= 2 and left <= max(best + 1e-9, tolerance)
        assert change == [] if abs(error) <= tolerance else True
