"""License scans through a positional index of rare words.

Templates of licence notices are indexed word by word: a posting is a template
and a position. In each document, words of the licence vocabulary are looked
up. A document's anchors for a template are the template's words that the
document holds, rarest first (highest inverse document frequency over the
whole corpus): ANCHORS of them, and more until one is of the template's key
phrase. Two documents thus use different anchors for one template where they
hold different words of it. A posting and a place in the document fix where
the template would begin; beginnings on which all the anchors of the key phrase
agree are candidates (the others may stand or not: a notice may be reworded
around its key phrase), and at each the whole mandatory key phrase must stand
at its place before the template's label is given. As anchors of the key phrase
must stand with it, no place is lost. Base phrases are found everywhere with
the same index (each is a template of its own that must match whole, anchored
at the rarest of its words).

Scale: texts are read where they lie, twice: once for document frequencies of
the (fixed, small) vocabulary, summed with partial aggregation, and once for
the scan. Nothing but the vocabulary's counts reaches the driver, and no
documents are shuffled.

Defined results: null and empty texts have no words, no labels and score 0;
ids may be null or repeat; other columns are carried unless named like a
result column; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import ALNUM, Words, flat, hash_words, pieces

RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

#: Base phrases and their labels.
BASE: list[tuple[str, str]] = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices, the label that each adds, and the key phrase that must stand in it.
TEMPLATES: list[tuple[str, str, str]] = [
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("released under the mit license", "mit", "the mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission is hereby granted free of charge"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "gnu general public license version 2"),
    ("licensed under the gnu general public license v2", "gpl-2.0", "gnu general public license v2"),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license version 3"),
    ("licensed under the gnu general public license v3", "gpl-3.0", "gnu general public license v3"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("licensed under the gnu affero general public license", "agpl", "gnu affero general public license"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", "cc by nd 4 0"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", "creative commons attribution 4 0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
    ("dedicated to the public domain under cc0 1 0", "cc0-1.0", "cc0 1 0"),
    ("licensed under the mozilla public license version 2 0", "mpl-2.0", "mozilla public license version 2 0"),
    ("licensed under the bsd 3 clause license", "bsd-3-clause", "bsd 3 clause"),
    ("licensed under the bsd 2 clause license", "bsd-2-clause", "bsd 2 clause"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution and use in source and binary forms"),
    ("licensed under the isc license", "isc", "isc license"),
    ("licensed under the eclipse public license version 2 0", "epl-2.0", "eclipse public license"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
]

#: The document's rarest words of a template that anchor candidates.
ANCHORS = 3


class Index:
    """Postings of the templates' words, in order of word hash."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.texts = [t.split() for t, _, _ in templates]
        self.labels = [label for _, label, _ in templates]
        vocabulary = sorted({w for t in self.texts for w in t} | {w for p, _ in BASE for w in p.split()})
        self.words = vocabulary
        self.hash = hash_words([w.encode() for w in vocabulary])
        self.order = np.argsort(self.hash)
        self.sorted_hash = self.hash[self.order]
        number = {w: i for i, w in enumerate(vocabulary)}
        self.numbers = [np.array([number[w] for w in t]) for t in self.texts]
        self.base = [(np.array([number[w] for w in p.split()]), label) for p, label in BASE]
        self.keys = []
        for text, (_, _, key) in zip(self.texts, templates, strict=True):
            k = key.split()
            at = next(i for i in range(len(text)) if text[i : i + len(k)] == k)
            self.keys.append((at, np.array([number[w] for w in k])))

    def number(self, w: Words) -> np.ndarray:
        """The vocabulary's number of each word, or -1."""
        if not len(w):
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.sorted_hash, w.hash).clip(max=len(self.hash) - 1)
        return np.where(self.sorted_hash[at] == w.hash, self.order[at], -1)

    def rare_first(self, idf: np.ndarray) -> list[np.ndarray]:
        """Each template's distinct words, rarest first."""
        return [np.array(sorted(set(t.tolist()), key=lambda w: (-idf[w], w))) for t in self.numbers]

    def anchors(self, t: int, rare: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which of a template's words (columns, rarest first) anchor it in each text (rows), given the words that texts hold.

        No word does where the key phrase can't stand, as one of its words is missing.
        """
        own = held[:, rare]
        in_key = np.isin(rare, self.keys[t][1])
        keys_before = np.cumsum(own & in_key, axis=1) - (own & in_key)
        chosen = own & ((np.cumsum(own, axis=1) <= ANCHORS) | (in_key & (keys_before == 0)))
        return chosen & own[:, in_key].all(1)[:, None]


def _stands_at(number: np.ndarray, phrase: np.ndarray, at: np.ndarray, stop: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether the phrase's words stand from each place, within its text."""
    ok = (at >= begin) & (at + len(phrase) <= stop)
    for i, w in enumerate(phrase):
        ok[ok] = number[at[ok] + i] == w
    return ok


def _frequencies(index: Index):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(len(index.words), dtype=np.int64), 0
        for b in pieces(batches):
            w = Words(*flat(b["text"]), ALNUM, lower=True)
            number = index.number(w)
            text = np.repeat(np.arange(b.num_rows), np.diff(w.of))
            known = number >= 0
            pairs = np.unique(text[known] * len(index.words) + number[known])
            seen += np.bincount(pairs % len(index.words), minlength=len(index.words))
            docs += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(seen)), -1]), pa.array([*seen.tolist(), docs])], names=["word", "n"])

    return go


def scan_shard(column, index: Index, rare: list[np.ndarray], idf: np.ndarray) -> list[tuple]:
    """n_words, n_base, first, last, base labels, labels, score of each text."""
    w = Words(*flat(column), ALNUM, lower=True)
    n_texts = len(w.of) - 1
    number = index.number(w)
    begins, stops = w.of[:-1], w.of[1:]
    n_base = np.zeros(n_texts, dtype=np.int64)
    first, last = np.full(n_texts, 2**62), np.full(n_texts, -1)
    base: list[set[str]] = [set() for _ in range(n_texts)]
    labels: list[set[str]] = [set() for _ in range(n_texts)]
    score = np.zeros(n_texts)
    known = np.flatnonzero(number >= 0)
    by_word = known[np.argsort(number[known], kind="stable")]
    edge = np.searchsorted(number[by_word], np.arange(len(index.words) + 1))
    places = lambda word: by_word[edge[word] : edge[word + 1]]
    text_of = lambda at: np.searchsorted(w.of, at, side="right") - 1

    for phrase, label in index.base:
        anchor = int(np.argmax(idf[phrase]))
        at = places(int(phrase[anchor])) - anchor
        at = at[at >= 0]
        text = text_of(at + anchor)
        ok = _stands_at(number, phrase, at, stops[text], begins[text])
        at, text = at[ok], text[ok]
        n_base += np.bincount(text, minlength=n_texts)
        np.minimum.at(first, text, at - begins[text])
        np.maximum.at(last, text, at - begins[text])
        for i in np.unique(text).tolist():
            base[i].add(label)
        score[text] = 1.0

    held_words = np.zeros((n_texts, len(index.words)), dtype=bool)
    held_words[text_of(known), number[known]] = True
    for n, (t, label, (key_at, key), words) in enumerate(zip(index.numbers, index.labels, index.keys, rare, strict=True)):
        chosen = index.anchors(n, words, held_words)
        if not chosen.any():
            continue
        # Beginnings by the postings of each text's anchors of the key phrase, and how many of them must agree.
        votes, needed = [], np.zeros(n_texts, dtype=np.int64)
        for c, word in enumerate(words.tolist()):
            for i in np.flatnonzero(key == word).tolist():
                at = places(word)
                votes.append(at[chosen[text_of(at), c]] - (key_at + i))
                needed += chosen[:, c]
        begin, count = np.unique(np.concatenate(votes), return_counts=True)
        inside = (begin + key_at >= 0) & (begin + key_at + len(key) <= len(number))
        begin, count = begin[inside], count[inside]
        begin = begin[count == needed[text_of(begin + key_at)]]
        if not len(begin):
            continue
        text = text_of(begin + key_at)
        ok = _stands_at(number, key, begin + key_at, stops[text], begins[text])
        begin, text = begin[ok], text[ok]
        held = np.zeros(len(begin))
        for i, word in enumerate(t):
            at = begin + i
            inside = (at >= begins[text]) & (at < stops[text])
            held[inside] += (number[at[inside]] == word) * idf[word]
        np.maximum.at(score, text, held / idf[t].sum())
        for i in np.unique(text).tolist():
            labels[i].add(label)
    return [(int(stops[i] - begins[i]), int(n_base[i]), int(first[i]) if n_base[i] else None, int(last[i]) if n_base[i] else None, ",".join(sorted(base[i])), ",".join(sorted(base[i] | labels[i])), float(min(score[i], 1.0))) for i in range(n_texts)]


def _scan(index: Index, rare: list[np.ndarray], idf: np.ndarray, names: list[str]):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = list(zip(*scan_shard(b["text"], index, rare, idf), strict=True))
            yield pa.RecordBatch.from_arrays([b["rest"], *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names=names)

    return go


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Find licence phrases and notices in every whole text.

    Returns the columns of `docs` but the text, and n_words, n_base (places of
    base phrases), first_word and last_word (their least and largest start),
    base_labels, labels (with those of templates) and score: the share of the
    best template's rarity that stands in the text, 1 for a base phrase.
    """
    index = Index()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = {r["word"]: r["n"] for r in texts.mapInArrow(_frequencies(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + counts.get(i, 0))) + 1e-3 for i in range(len(index.words))])
    carry = [c for c in docs.columns if c not in RESULT and c != text_col]
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("rest"), F.col(text_col).cast("string").alias("text"))
    ddl = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema = StructType(rest.select("rest").schema.fields + StructType.fromDDL(ddl).fields)
    out = rest.mapInArrow(_scan(index, index.rare_first(idf), idf, schema.names), schema)
    return out.select(*[F.col(f"rest.`{c}`") for c in carry], *RESULT)
