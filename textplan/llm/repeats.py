"""Removal of passages that occur more than once in a corpus.

A window is a fixed number of bytes (or words) of one document; whatever lies
in a window whose content also starts anywhere else is removed. Windows are
judged on the input. The two operators here differ in the unit and in how
candidates are resolved: `suffix_array_dedup` sorts suffixes (deep-shallow),
`lempel_ziv_dedup` factors text against reference blocks (relative
Lempel-Ziv). They share the candidate search:

1. Each document's windows are gathered into runs with a common anchor (the
   least k-gram hash of the window), about one run for 85 bytes or 15 words.
   Equal windows have equal anchors, so a run whose anchor is unique in the
   corpus (and in the run) holds no repeat. Runs are counted by anchor with partial aggregation.
2. Runs that are equal as a whole (by a 128-bit digest of their content) are
   a class, so a passage in a third of all documents is one row. Nothing is
   decided by that: the contents of a class's first and last place go on, and
   its members take the spans that are found in its first.
3. Contents are dealt out by anchor, and all of an anchor's meet in a task,
   where the sort or the parse finds the windows that occur twice. An anchor
   with more than HOT classes is split: its classes with two places are dealt
   out one by one, and its windows are gathered anew, each for itself, so that
   only equal windows need to meet. These go through the same sort or parse.

Spans go back to the documents in one join on the document's key.

Defined results: null text has no bytes or words and is returned as such;
null and repeated ids are allowed (a row is known by id and text, and repeated
rows repeat each other); ids are integers; documents shorter than a window are kept; an empty
table gives an empty result; other columns are carried, except those named
like a result column, which the result column replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import NOT_SPACE, Words, as_long, byte_values, digest_128, flat, pieces, runs_of_windows, shingle_hash
from .suffixes import repeated_windows

#: Classes of one anchor that a task resolves together, some 300 bytes each.
HOT = 4096
#: Bytes of run contents that a task resolves at a time, unless one anchor has more.
CHUNK = 1 << 19
NO_ID = -(2**63)
RESULT = ("n_units", "n_removed", "n_spans", "kept", "kept_sha256")

#: (values, offsets, classes, extra, shared, width) -> places where a repeated window begins; see `repeated_windows`.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
RUNS = "id long, tx long, head boolean, start long, stop long, anchor long, d1 long, d2 long, twice boolean"


class Unit:
    """Bytes or words: values to compare, their offsets by text, and the byte range of each."""

    def __init__(self, words: bool, width: int, k: int):
        self.words, self.width, self.k = words, width, k

    def read(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, offsets = flat(column)
        if self.words:
            w = Words(buf, offsets, NOT_SPACE, lower=False)
            return buf, offsets, w.hash, w.of, w.start, w.end
        at = np.arange(len(buf) + 1)
        return buf, offsets, byte_values(buf), offsets, at[:-1], at[1:]

    def digests(self, buf: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the bytes, or of the words whatever lies between them."""
        return digest_128(values if self.words else buf, start, end)


def _find_runs(unit: Unit):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=1 << 19):
            buf, offsets, values, of, first, last = unit.read(b["text"])
            start, n, anchor, twice = runs_of_windows(values, of, unit.width, unit.k)
            doc = np.searchsorted(of, start, side="right") - 1
            d1, d2 = unit.digests(buf, values, start, start + n + unit.width - 1)
            from_, to = first[start] - offsets[doc], last[start + n + unit.width - 2] - offsets[doc]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(doc)), b["tx"].take(pa.array(doc)), pa.array(start == of[doc]), pa.array(from_), pa.array(to), pa.array(as_long(anchor)), pa.array(d1), pa.array(d2), pa.array(twice)], names=["id", "tx", "head", "start", "stop", "anchor", "d1", "d2", "twice"])

    return go


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by `deal`, in tables that hold all rows of each of its values and about `most` bytes of content."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in pieces(batches, "content", most):
        held.append(b)
        size += b["content"].nbytes
        if size < most:
            continue
        t = pa.Table.from_batches(held)
        deal = t["deal"].to_numpy()
        cut = int(np.searchsorted(deal, deal[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            size = sum(x["content"].nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _resolve(unit: Unit, resolver: Resolver):
    """For contents sorted by deal, class and place: the byte ranges of each class's repeated windows, from the start of its content."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, CHUNK):
            buf, offsets, values, of, first, last = unit.read(t["content"])
            deal, anchor, d1, d2, extra, twice = (t[c].to_numpy() for c in ("deal", "anchor", "d1", "d2", "extra", "twice"))
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            dealt = np.ones(t.num_rows, dtype=bool)
            dealt[1:] = deal[1:] != deal[:-1]
            group = np.cumsum(dealt) - 1
            shared = (np.bincount(group, new) > 1) | (np.bincount(group, twice) > 0)
            found = resolver(values if unit.words else buf, of, np.cumsum(new) - 1, extra, shared[group], unit.width)
            start = np.flatnonzero(found & ~np.r_[False, found[:-1]])
            stop = np.flatnonzero(found & ~np.r_[found[1:], False]) + unit.width - 1
            row = np.searchsorted(of, start, side="right") - 1
            at = pa.array(row)
            out = pa.Table.from_arrays([t["anchor"].take(at), t["d1"].take(at), t["d2"].take(at), pa.array(first[start] - offsets[row]), pa.array(last[stop] - offsets[row])], names=["anchor", "d1", "d2", "from", "to"])
            yield from out.combine_chunks().to_batches()

    return go


def _single_windows(unit: Unit):
    """Each window of the classes' contents as a run of its own: its byte range in the content, and two halves of its digest."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "content", 1 << 17):
            buf, offsets, values, of, first, last = unit.read(b["content"])
            ok = np.flatnonzero(np.arange(len(values)) + unit.width <= np.repeat(of[1:], np.diff(of)))
            w1, w2 = unit.digests(buf, values, ok, ok + unit.width)
            row = np.searchsorted(of, ok, side="right") - 1
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b["anchor"].take(at), b["d1"].take(at), b["d2"].take(at), pa.array(first[ok] - offsets[row]), pa.array(last[ok + unit.width - 1] - offsets[row]), pa.array(w1), pa.array(w2)], names=["anchor", "d1", "d2", "from", "to", "w1", "w2"])

    return go


def _cut(unit: Unit, names: list[str], as_text: bool):
    """Texts without their spans."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            buf, offsets, _, of, first, last = unit.read(b["text"])
            spans = b["spans"].to_pylist()
            units, removed, n_spans, kept, sha = [], [], [], [], []
            for i, own in enumerate(spans):
                lo, hi = offsets[i], offsets[i + 1]
                keep = np.ones(hi - lo, dtype=bool)
                n, reach = 0, -1
                for a, z in sorted((s["start"], s["stop"]) for s in own or ()):
                    # Runs of words are apart by white space: they touch if no word lies between.
                    if a > reach and not (unit.words and n and not NOT_SPACE[buf[lo + reach : lo + a]].any()):
                        n += 1
                    keep[max(a, 0) : z] = False
                    reach = max(reach, z)
                if unit.words:
                    w = slice(of[i], of[i + 1])
                    stays = keep[first[w] - lo]
                    data = b" ".join(buf[s:e].tobytes() for s, e in zip(first[w][stays], last[w][stays], strict=True)) if own else b" ".join(buf[lo:hi].tobytes().split())
                    units.append(of[i + 1] - of[i])
                    removed.append(int((~stays).sum()))
                else:
                    data = buf[lo:hi][keep].tobytes()
                    units.append(hi - lo)
                    removed.append(int((~keep).sum()))
                n_spans.append(n)
                kept.append(data.decode("utf-8", "ignore") if as_text else data)
                sha.append(hashlib.sha256(data).hexdigest())
            rest = [b[c] for c in b.schema.names if c not in ("spans", "text")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(units, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sha, pa.string())], names=names)

    return go


def _dedup(docs: DataFrame, unit: Unit, resolver: Resolver, name: str, id_col: str, text_col: str, as_text: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, name)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("tx")]
    texts = docs.select(*key, F.col(text_col).cast("string").alias("text"))

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    klass = ["anchor", "d1", "d2"]

    runs = scratch.keep("runs", texts.where("text is not null").mapInArrow(_find_runs(unit), RUNS))
    # Rows that repeat as a whole have one text between them.
    again = scratch.keep("again", runs.where("head").groupBy("id", "tx").count().where("count > 1").select("id", "tx"))
    if not again.isEmpty():
        one = texts.join(again, ["id", "tx"]).groupBy("id", "tx").agg(F.first("text").alias("text"))
        texts = texts.join(again, ["id", "tx"], "left_anti").unionByName(one)
    shared = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("anchor")
    marked = scratch.keep("marked", runs.drop("head").join(shared, "anchor", "left_semi"))
    scratch.drop("runs")
    place = F.struct("id", "tx", "start", "stop")
    classes = scratch.keep("classes", marked.groupBy(*klass).agg(F.count("*").alias("copies"), F.max("twice").alias("twice"), F.min(place).alias("one"), F.max(place).alias("two")))
    hot = scratch.keep("hot", classes.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"))
    places = classes.select(*klass, (F.col("copies") > 1).alias("paired"), "twice", F.explode(F.expr("if(copies > 1, array(named_struct('extra', false, 'at', one), named_struct('extra', true, 'at', two)), array(named_struct('extra', false, 'at', one)))")).alias("p")).select(*klass, "paired", "twice", "p.extra", "p.at.*")
    pulled = scratch.keep("pulled", places.join(texts, ["id", "tx"]).select(*klass, "paired", "twice", "extra", F.expr("substring(cast(text as binary), cast(start as int) + 1, cast(stop - start as int))").alias("content")))
    scratch.drop("classes")

    def resolve(contents: DataFrame) -> DataFrame:
        dealt = contents.select("deal", *klass, "twice", "extra", "content").repartition(n_parts, "deal").sortWithinPartitions("deal", *klass, "extra")
        return dealt.mapInArrow(_resolve(unit, resolver), "anchor long, d1 long, d2 long, from long, to long")

    if hot.isEmpty():
        found = resolve(pulled.withColumn("deal", F.col("anchor")))
    else:
        cool = pulled.join(hot, "anchor", "left_anti").withColumn("deal", F.col("anchor"))
        pairs = pulled.where("paired").join(hot, "anchor", "left_semi").withColumn("deal", F.xxhash64(*klass)).withColumn("twice", F.lit(False))
        crowd = pulled.where("not extra").join(hot, "anchor", "left_semi").select(*klass, "content")
        windows = scratch.keep("windows", crowd.mapInArrow(_single_windows(unit), "anchor long, d1 long, d2 long, from long, to long, w1 long, w2 long"))
        spot = F.struct(*klass, "from", "to")
        often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(spot).alias("one"), F.max(spot).alias("two")).where("n > 1")
        spots = often.select("w1", "w2", F.explode(F.expr("array(named_struct('extra', false, 'at', one), named_struct('extra', true, 'at', two))")).alias("p")).select("w1", "w2", "p.extra", "p.at.*")
        alone = spots.join(crowd, klass).select(F.col("w1").alias("deal"), F.col("w1").alias("anchor"), F.col("w2").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(False).alias("twice"), "extra", F.expr("substring(content, cast(from as int) + 1, cast(to - from as int))").alias("content"))
        agreed = resolve(alone).select(F.col("anchor").alias("w1"), F.col("d1").alias("w2")).distinct()
        found = resolve(cool.unionByName(pairs)).unionByName(windows.join(agreed, ["w1", "w2"], "left_semi").select(*klass, "from", "to"))
    spans = marked.join(found, klass).select("id", "tx", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("stop"))
    spans = scratch.keep("spans", spans.groupBy("id", "tx").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    scratch.drop("marked", "pulled", "windows", "again", "hot")

    carry = [f for f in docs.schema.fields if f.name not in RESULT and f.name != text_col]
    rest = docs.select(*key, F.struct(*[F.col(f"`{f.name}`") for f in carry], F.lit(0).alias("_")).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = rest.drop("id", "tx", "text").schema.add("n_units", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary").add("kept_sha256", "string")
    out = rest.join(spans, ["id", "tx"], "left").select("rest", "text", "spans").mapInArrow(_cut(unit, schema.names, as_text), schema)
    return out.select(*[F.col(f"rest.`{f.name}`") for f in carry], *RESULT)


def suffix_array_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Remove every byte in a `width`-byte string that also starts elsewhere, by deep-shallow suffix sorting.

    Returns the other columns of `docs` and: n_units (bytes), n_removed,
    n_spans (maximal removed runs), kept (the bytes that stay), kept_sha256.
    With `as_text`, kept is a string; characters of which a part was removed
    are left out of it.
    """
    return _dedup(docs, Unit(False, width, max(1, min(32, width // 2))), repeated_windows, "suffix-array", id_col, text_col, as_text)


def lempel_ziv_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Remove every word in a window of `width` words that also starts elsewhere, by relative Lempel-Ziv parsing.

    Words are runs of anything but ASCII white space. Returns as
    `suffix_array_dedup` does, with words as units; `kept` joins the words
    that stay with one space.
    """
    return _dedup(docs, Unit(True, width, max(1, min(8, width // 2))), factored_windows, "lempel-ziv", id_col, text_col, as_text)


def factored_windows(values: np.ndarray, offsets: np.ndarray, classes: np.ndarray, extra: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """At which places of these texts a window of `width` words begins that lies in a factor.

    All texts together are the reference block; its index lists every place in
    the order of the phrases (of up to eight words) that follow it, so the
    longest factor from a place is with a neighbour of it there. Texts are
    parsed greedily, all at once: at its next place whose first phrase occurs
    elsewhere, each text's factor runs on for as long as it agrees, word by
    word, with either neighbour. Factors of at least `width` words cover the
    windows in them. Windows across a factor's end may occur at a third place,
    so the parse goes on `width - 1` words before it; behind a shorter factor,
    which may hide a longer one, at the next word.
    """
    found = np.zeros(len(values) + 1, dtype=bool)
    size = np.diff(offsets)
    ends = np.repeat(offsets[1:], size)
    place = np.arange(len(values))
    places = place[place + width <= ends]
    if len(places) < 2:
        return found
    k = min(8, width)
    phrase = shingle_hash(values, k)
    keys = [phrase[places + d] for d in sorted({*range(0, width - k, k), width - k})]
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    alike = first[1:] == first[:-1]
    ahead, behind = np.full(len(values), -1), np.full(len(values), -1)
    ahead[places[order[1:]][alike]] = places[order[:-1]][alike]
    behind[places[order[:-1]][alike]] = places[order[1:]][alike]
    seeds = np.flatnonzero(((ahead >= 0) | (behind >= 0)) & ~extra[np.repeat(np.arange(len(size)), size)])
    stop = np.searchsorted(seeds, offsets[1:])
    at = np.searchsorted(seeds, offsets[:-1])
    live = np.flatnonzero(at < stop)
    edge = np.zeros(len(values) + 1, dtype=np.int64)
    while len(live):
        i = seeds[at[live]]
        length = np.maximum(_agree(values, ends, i, ahead[i]), _agree(values, ends, i, behind[i]))
        step = length - width + 1
        long = step > 0
        np.add.at(edge, i[long], 1)
        np.add.at(edge, i[long] + step[long], -1)
        at[live] = np.where(long, np.searchsorted(seeds, i + step.clip(1)), at[live] + 1)
        live = live[at[live] < stop[live]]
    found[:-1] = np.cumsum(edge)[:-1] > 0
    return found


def _agree(values: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from each two places agree, each within its text; 0 for a place of -1."""
    out = np.zeros(len(i), dtype=np.int64)
    live = np.flatnonzero(j >= 0)
    room = np.minimum(ends[i] - i, ends[j] - j)
    stride = 16
    while len(live):
        ahead = out[live, None] + np.arange(stride)
        inside = ahead < room[live, None]
        ahead = np.where(inside, ahead, 0)
        same = (values[i[live, None] + ahead] == values[j[live, None] + ahead]) & inside
        whole = same.all(1)
        out[live] += np.where(whole, stride, np.argmin(same, 1))
        live = live[whole]
        stride = max(16, min(stride * 2, (1 << 18) // max(len(live), 1)))
    return out
