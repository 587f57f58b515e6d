import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textplan.llm import repeats, suffixes
from textplan.llm._text import hash_words
from textplan.llm.repeats import lempel_ziv_dedup, suffix_array_dedup
from textplan.llm.suffixes import repeated_suffixes, sort_suffixes

SCHEMA = "doc_id long, text string, kept string, start long, id int"


def brute(rows, width, words):
    units = [((r[1] or "").encode().split() if words else list((r[1] or "").encode())) for r in rows]
    count = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for r, u in zip(rows, units, strict=True):
        hit = [False] * len(u)
        for i in range(len(u) - width + 1):
            if count[tuple(u[i : i + width])] > 1:
                hit[i : i + width] = [True] * width
        kept = [x for x, h in zip(u, hit, strict=True) if not h]
        data = b" ".join(kept) if words else bytes(kept)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((r[0], len(u), sum(hit), spans, hashlib.sha256(data).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    prose = lambda m: " ".join(word() for _ in range(m))
    shared = [prose(r.randint(30, 90)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [prose(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 40)
            parts += [s[a : a + r.randint(60, 500)], prose(r.randint(0, 30))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts), "k", 1, 2))
    rows += [(400 + i, " ".join(prose(1) for _ in range(4000)), "k", 1, 2) for i in range(2)]
    rows.append((402, prose(3000) + rows[-1][1][:9000] + "x" * 20_000 + rows[-2][1][500:], "k", 1, 2))
    # One passage between ever other texts: many contents of one anchor.
    rows += [(500 + i, prose(20) + " " + shared[0] + " " + prose(20), "k", 1, 2) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "k", 1, 1), (None, rows[3][1], "k", 1, 1), (102, "x" * 900, "k", 1, 1), (103, "ab " * 300, "k", 1, 1), rows[5], rows[5], (104, rows[7][1], "k", 1, 1), (None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("words,width", [(False, 200), (False, 50), (True, 35), (True, 10)])
@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_matches_brute_force(spark, words, width, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = (lempel_ziv_dedup if words else suffix_array_dedup)(df, width)
    assert out.columns == ["doc_id", "start", "id", "n_units", "n_removed", "n_spans", "kept", "kept_sha256"]
    got = sorted([(r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()], key=str)
    assert got == brute(rows, width, words)


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("hot", [4096, 1])
def test_the_method_decides(spark, words, hot, monkeypatch):
    """Without the sort, or the parse, nothing is removed."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "factored_windows" if words else "repeated_windows", lambda values, *_: np.zeros(len(values) + 1, dtype=bool))
    df = spark.createDataFrame(corpus(4), SCHEMA).repartition(3)
    assert (lempel_ziv_dedup if words else suffix_array_dedup)(df, 20).where("n_removed > 0").count() == 0


def test_words_that_defeat_polynomials(spark):
    """Thue-Morse words of two letters have one polynomial hash modulo 2**64, whatever its base."""
    one = two = ""
    for _ in range(11):
        one, two = one + two if one else "ab", two + one if two else "ba"
    assert len(one) == 2048 and one != two
    h = hash_words([one.encode(), two.encode(), one[:60].encode(), two[:60].encode(), b"a", b"b", b"", b"ab", b"ba"])
    assert len(set(h.tolist())) == 9
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in lempel_ziv_dedup(df, 20).collect()] == [0, 0]
    assert [r.n_removed for r in suffix_array_dedup(df, 2100).collect()] == [0, 0]


def test_very_long_texts(spark):
    """A passage between two texts of 2 MB, one of which repeats itself without end."""
    r = np.random.default_rng(9)
    prose = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    shared = prose(3000)
    one, two = prose(280_000) + " " + shared + " " + prose(1000), "again and " * 200_000 + shared
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in lempel_ziv_dedup(df, 35).collect()}
    assert got == {1: (3000, 1), 2: (400_000 + 3000, 1)}
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_array_dedup(df, 200).collect()}
    size = len(shared)
    assert got[1][1] == 1 and size <= got[1][0] <= size + 4 and got[2] == (len(two), 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_array_dedup(df).count() == 0
    assert lempel_ziv_dedup(df).count() == 0


@pytest.mark.parametrize("large", [20_000, 3])
def test_sorted_suffixes(large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)
    r = np.random.default_rng(3)
    for alphabet, n in ((2, 600), (3, 2000), (200, 1000)):
        data = r.integers(97, 97 + alphabet, n, dtype=np.uint8) if alphabet < 200 else r.integers(0, 256, n, dtype=np.uint8)
        data[n // 2 : n // 2 + 200] = data[:200]
        width = 60
        starts = np.arange(n - width + 1)
        order, common = sort_suffixes(data, starts, width)
        raw = data.tobytes()
        texts = [raw[s : s + width] for s in order]
        assert texts == sorted(texts) and sorted(order) == starts.tolist()
        for i in range(1, len(texts)):
            lcp = next((k for k in range(width) if texts[i][k] != texts[i - 1][k]), width)
            assert common[i] == lcp
        count = Counter(texts)
        assert repeated_suffixes(data, starts, width).tolist() == [count[raw[s : s + width]] > 1 for s in starts]
