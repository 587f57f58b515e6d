import random
import re

import pytest

from textplan.llm import near_dup
from textplan.llm.near_dup import near_duplicates

SCHEMA = "doc_id long, text string, n int, component_id string, rest int"


def brute(rows, size, percent):
    def shingles(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    live = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for x, i in enumerate(live):
        for j in live[:x]:
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i in live:
        least[root(i)] = min(least.get(root(i), 10**9), rows[i][0])
    out = []
    for i, r in enumerate(rows):
        c = r[0] if not sets[i] else least[root(i)] if r[0] is not None else None
        out.append((r[0], len(sets[i]), c, r[0] is not None and c == r[0]))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgÉé") for _ in range(5)) for _ in range(300)]
    prose = lambda m: [r.choice(vocabulary) for _ in range(m)]
    rows = []
    for g in range(12):
        base = prose(r.choice([5, 40, 100, 400]))
        for _ in range(r.choice([1, 2, 8, 40])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.005, 0.01, 0.02, 0.03]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice([" ", "\n"]).join(w), 1, "c", 2))
    # A chain: each near the next, the ends apart.
    w = prose(120)
    for i in range(25):
        w = list(w)
        w[5 * i % 120] = r.choice(vocabulary)
        rows.append((1000 - i, " ".join(w), 1, "c", 2))
    rows += [(2000, None, None, None, None), (2001, "", 1, "c", 1), (2002, "One", 1, "c", 1), (2003, "one", 1, "c", 1), (2004, "two words", 1, "c", 1), (None, "one", 1, "c", 1), (2005, " \n ", 1, "c", 1), rows[0], rows[0], (2006, "w " * 30_000, 1, "c", 1), (2007, "w w w", 1, "c", 1)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,block,fan", [(3, 85, 1024, 512), (3, 85, 4, 3), (5, 80, 1024, 512)])
def test_matches_brute_force(spark, size, percent, block, fan, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "FAN", fan)
    monkeypatch.setattr(near_dup, "FAMILY_BLOCK", fan)
    rows = corpus(size + percent)
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), size, percent)
    assert out.columns == ["doc_id", "n", "rest", "n_shingles", "component_id", "kept"]
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()], key=str) == brute(rows, size, percent)


def test_rows_of_one_id_are_one_node(spark):
    """Two classes that have only an id in common are linked, also where it is the least of neither, or of both."""
    rows = [(3, "a b c d"), (7, "a b c d"), (7, "x y z w"), (9, "x y z w"), (20, "k l m n"), (20, "o p q r"), (21, "o p q r"), (30, "e f"), (31, "e f"), (31, "g h"), (32, "g h"), (32, "i j"), (33, "i j")]
    rows = [(*r, 1, "c", 2) for r in rows]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 85)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()], key=str) == brute(rows, 3, 85)


def test_long_texts_and_words_that_defeat_polynomials(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(5000)}" for _ in range(400_000)]
    other = list(long)
    other[::100] = ["changed"] * len(other[::100])
    one = two = ""
    for _ in range(11):
        one, two = one + two if one else "ab", two + one if two else "ba"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "short text here"), (4, f"{one} {two} {one}"), (5, f"{two} {one} {two}")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError, match="integer ids"):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
