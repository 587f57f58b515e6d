import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textplan.llm import decontaminate
from textplan.llm.decontaminate import find_benchmark, without_spans
from textplan.llm.fm_index import FMIndex

SCHEMA = "doc_id long, text string, n_hit int, items string, rest int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, width):
    phrases = []
    for item, text in items:
        w = words(text)
        phrases += [(item, w[i : i + width]) for i in range(max(1, len(w) - width + 1) if w else 0)]
    out = []
    for r in rows:
        w = words(r[1])
        hit, found = [False] * len(w), set()
        for item, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit[i : i + len(p)] = [True] * len(p)
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((r[0], len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def data(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé1") for _ in range(r.randint(1, 4))) for _ in range(60)]
    prose = lambda m: " ".join(r.choice(vocabulary) for _ in range(m))
    items = [(i, prose(r.randint(10, 40))) for i in range(30)] + [(100, "x1 y2 z3"), (101, ""), (102, None), (103, "solo"), (None, prose(20)), (9, prose(15)), (104, "the the the the the the the the the the the")]
    items.append((105, items[3][1]))
    rows = []
    for i in range(120):
        parts = [prose(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 8))
            parts += [r.choice([", ", " - ", "\n"]).join(w[a : a + r.randint(5, 30)]).upper().replace("É", "é"), prose(r.randint(0, 20))]
        rows.append((i, "; ".join(parts), 1, "k", 2))
    rows += [(500, None, None, None, None), (501, "", 1, "k", 1), (502, "!!!", 1, "k", 1), (None, items[0][1], 1, "k", 1), rows[0], rows[0], (503, "the " * 20_000, 1, "k", 1), (504, "x1", 1, "k", 1), (505, "y x1 y2 z3", 1, "k", 1), (506, "Solo solo", 1, "k", 1)]
    return rows, items


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows, items = data(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    out = find_benchmark(df, bench)
    assert out.columns == ["doc_id", "text", "rest", *decontaminate.RESULT]
    got = out.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], key=str) == brute(rows, items, 10)
    for r, cut in ((r, r.cut) for r in out.withColumn("cut", F.expr(without_spans())).collect()):
        assert len(words(cut)) == r.n_words - r.n_hit


def test_empty_tables(spark):
    rows, items = data(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert find_benchmark(docs.limit(0), bench).count() == 0
    assert find_benchmark(docs, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_fm_index_finds_all():
    r = np.random.default_rng(1)
    for top in (1, 2, 5, 300):
        text = r.integers(1, top + 1, 700)
        index = FMIndex(text)
        for m in (1, 2, 5):
            phrases = np.stack([text[i : i + m] for i in r.integers(0, 690, 40)] + [r.integers(1, top + 3, m) for _ in range(10)])
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want
