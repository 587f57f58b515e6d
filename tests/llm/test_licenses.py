import math
import random
import re
from collections import Counter

import numpy as np

from textplan.llm.licenses import BASE, RESULT, TEMPLATES, Index, scan_licenses

SCHEMA = "doc_id long, text string, labels int, rest int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(t):
    w = words(t)
    at = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def data():
    r = random.Random(6)
    vocabulary = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "the", "version", "2", "0", "été", "x", "Licensed", "under"]
    phrases = [p for p, _ in BASE] + [t for t, _, _ in TEMPLATES] + ["CC BY-NC 4.0.", "Apache License, Version 2.0", "cc\nby cc by"]
    rows = []
    for i in range(300):
        parts = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(phrases))
        rows.append((i, r.choice([" ", "\n", ", "]).join(parts), 1, 2))
    return rows + [(None, None, None, None), (1, "", 1, 1), rows[0], rows[0], (2, "mit license " * 20_000, 1, 1)]


def test_base_matches_brute_force(spark):
    rows = data()
    out = scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "rest", *RESULT]
    got = out.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    for r in got:
        own = r.labels.split(",") if r.labels else []
        assert set(r.base_labels.split(",")) - {""} <= set(own) and own == sorted(set(own))
        assert 0 <= r.score <= 1 and (r.score == 1 if r.n_base else True)


def stands(w, phrase, at):
    return at >= 0 and w[at : at + len(phrase)] == phrase


def brute_labels(rows):
    """Labels and score of each row, by trying every template at every place."""
    texts = [words(r[1]) for r in rows]
    df = Counter(x for w in texts for x in set(w))
    idf = lambda x: math.log((1 + len(rows)) / (1 + df[x])) + 1e-3
    out = []
    for w in texts:
        labels, score = set(brute(" ".join(w))[4].split(",")) - {""}, 0.0
        if labels:
            score = 1.0
        for t, label, key in TEMPLATES:
            t, key = t.split(), key.split()
            shift = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
            for at in range(-shift, len(w)):
                if stands(w, key, at + shift):
                    labels.add(label)
                    score = max(score, sum(idf(x) for i, x in enumerate(t) if 0 <= at + i < len(w) and w[at + i] == x) / sum(map(idf, t)))
        out.append((",".join(sorted(labels)), round(min(score, 1.0), 9)))
    return out


def test_labels_and_score_match_brute_force(spark):
    rows = [r for r in data() if len(r[1] or "") < 10_000]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in got) == sorted((str(r[0]), *b) for r, b in zip(rows, brute_labels(rows), strict=True))


def test_anchors_are_each_documents_own():
    index = Index()
    idf = np.linspace(1, 2, len(index.words))
    n = next(i for i, (t, _, _) in enumerate(TEMPLATES) if t.startswith("licensed under the apache"))
    rare = index.rare_first(idf)[n]
    of = {w: i for i, w in enumerate(index.words)}
    held = np.zeros((3, len(index.words)), dtype=bool)
    for row, text in enumerate([TEMPLATES[n][0], TEMPLATES[n][2], "licensed under the apache version"]):
        held[row, [of[w] for w in text.split()]] = True
    one, two, none = ({index.words[w] for w in rare[a]} for a in index.anchors(n, rare, held))
    assert one != two and len(one) >= 3 and one & set(TEMPLATES[n][2].split()) and two <= set(TEMPLATES[n][2].split())
    assert not none  # a word of the key phrase is missing


def test_every_template_is_found(spark):
    rows = [(i, f"Some prose here. {t.capitalize()}. And more.") for i, (t, _, _) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, label, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score > 0.999
    # A key phrase alone gives the label; a notice without it does not.
    rows = [(0, "under Apache License, Version 2.0"), (1, "licensed under the apache version 2 0"), (2, "cc by nc 4 1")]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "apache,apache-2.0", 1: "", 2: "cc-by"}


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
