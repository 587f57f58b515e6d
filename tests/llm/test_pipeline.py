"""Each stage against its operator's brute force, on small tables written as the driver has them."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_near_dup, test_repeats


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghié") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    prose = lambda m: " ".join(r.choice(vocabulary) for _ in range(m))
    items = [(i, prose(20)) for i in range(10)]
    passage = prose(70)
    rows = []
    for i in range(150):
        text = prose(r.randint(40, 150))
        if i % 10 == 1:
            text += " " + items[i % 7][1]
        if i % 10 == 2:
            text += " " + passage + " " + prose(20)
        if i % 10 == 3:
            text = rows[-3][1].replace(" ", "  ", 3)
        if i % 10 == 4:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    rows += [rows[0], (500, None, None, None, None), (501, "", "en", "src1", 0), (None, prose(60), "en", "src1", 5)]
    labels = [(i, int(i % 10 != 4), 0) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    (_, one), (_, two), (_, three), (_, four), (_, five) = corpus_pipeline.STAGES

    good = one(spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    assert {i for i in range(150) if i % 10 == 4}.isdisjoint(ids) and {i for i in range(150) if i % 10 != 4} <= ids

    rows = [tuple(r) for r in good.collect()]
    single = two(spark, good, sf_dir).cache()
    want = sorted({r[0] for r in test_near_dup.brute(rows, 5, 80) if r[3] and r[0] is not None})
    got = [r.doc_id for r in single.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == [r[0] for r in rows].count(None)
    assert single.columns == columns and len(want) < len(rows) - 10

    rows = [(r.doc_id, r.text) for r in single.collect()]
    whole = three(spark, single, sf_dir).cache()
    removed = {r[0]: (r[1], r[2]) for r in test_repeats.brute(rows, 200, False)}
    for r in whole.collect():
        size = len((r.text or "").encode())
        n, gone = removed[r.doc_id]
        assert n - gone - 4 <= size <= n - gone and r.n_chars == len(r.text)
    assert whole.columns == columns and whole.count() == len(rows) and sum(g for _, g in removed.values()) > 1000

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in whole.collect()]
    clean = four(spark, whole, sf_dir).cache()
    left = {r[0]: r[1] - r[2] for r in test_decontaminate.brute(rows, items, 10)}
    assert {r.doc_id: len(test_decontaminate.words(r.text)) for r in clean.collect()} == left
    assert clean.columns == columns and sum(left.values()) < sum(len(test_decontaminate.words(t)) for _, t in rows)

    mixed = five(spark, clean, sf_dir).collect()
    assert len(mixed) == clean.count()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in clean.collect())
    assert abs(sum(r.taken for r in mixed) - 1.5 * total) < 0.1 * total


def test_run(spark, sf_dir):
    a = sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert a and a == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))


def test_stages_on_odd_tables(spark, sf_dir):
    """Empty tables, null columns, rows that repeat, and columns that clash with the operators' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, 0), (7, "", "en", "s", 0), (8, "one two", None, "s", 7), (8, "one two", None, "s", 7)], docs.schema))
    odd = odd.selectExpr("*", "1 as kept", "'x' as score", "2 as id", "array(1) as spans", "3 as size", "4 as n")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        out = stage(spark, odd, sf_dir)
        got = out.collect()
        assert len(got) == 5 or name in ("quality classifier", "MinHash near-dedup"), name
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns, name
        if name == "MinHash near-dedup":
            assert sorted(map(str, (r.doc_id for r in got))) == ["7", "8", "None"]


def test_nothing_to_learn_from(spark, tmp_path):
    """Without labels every document stays."""
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == 2
