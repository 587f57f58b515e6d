"""Benchmark decontamination with an FM-index for each shard of the training text.

Each slice of a partition's documents is a shard. Its words are mapped to the
numbers of the benchmark's words (others: zero), and stretches in which every
neighbouring pair is a pair of the benchmark are kept; a phrase can occur only
within such a stretch, so this loses nothing and the index stays small. Over
the stretches an FM-index is built; every benchmark window is searched
backward through the ranks of a wavelet tree, its occurrences are located by
sampled suffix positions, and hit words are merged to spans of bytes.

The documents are read once and never shuffled, so no key is hot. The
benchmark's windows travel with the tasks. They are read in blocks of at most
BLOCK_WORDS words; only a benchmark of several blocks needs a further
aggregation, by document, of the spans of all blocks.

Defined results: null texts and items have no words; an item without words has
no window; items with one text hit together; null item ids are not named in
`items`; null and repeated document ids are allowed; other columns are carried
unless named like a result column; an empty table gives an empty result, and
an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import ALNUM, Words, flat, hash_words, pieces
from .fm_index import FMIndex

#: Words of benchmark items that one pass searches for.
BLOCK_WORDS = 2_000_000
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


class Phrases:
    """The distinct windows of a block of benchmark items, as numbers of words."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        of: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            buf, offsets = flat(pa.array([low]))
            w = Words(buf, offsets, ALNUM, lower=True)
            ids = [of.setdefault(buf[s:e].tobytes(), len(of) + 1) for s, e in zip(w.start, w.end, strict=True)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).update([] if item is None else [str(item)])
        h = hash_words(list(of)) if of else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h)
        #: Word hashes in order, and the number of each word.
        self.hash, self.number = h[order], order + 1
        by_len: dict[int, list[tuple[int, ...]]] = {}
        for p in sorted(windows):
            by_len.setdefault(len(p), []).append(p)
        self.windows = [np.array(ps, dtype=np.int64) for _, ps in sorted(by_len.items())]
        self.items = [[sorted(windows[p]) for p in ps] for _, ps in sorted(by_len.items())]
        pairs = {(a, b) for p in windows for a, b in zip(p[:-1], p[1:], strict=True)}
        self.base = len(of) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        self.shortest = min(by_len, default=0)


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.searchsorted(table, values).clip(max=len(table) - 1)] == values


def search_shard(column, phrases: Phrases):
    """Words of a shard, which of them are hit, and the items with hits by text."""
    w = Words(*flat(column), ALNUM, lower=True)
    n = len(w)
    hit = np.zeros(n + 1, dtype=np.int64)
    found: dict[int, set[str]] = {}
    if n and len(phrases.hash):
        at = np.searchsorted(phrases.hash, w.hash).clip(max=len(phrases.hash) - 1)
        number = np.where(phrases.hash[at] == w.hash, phrases.number[at], 0)
        new_text = np.zeros(n + 1, dtype=bool)
        new_text[w.of] = True
        tied = _within(number[:-1] * phrases.base + number[1:], phrases.pairs) & (number[:-1] > 0) & (number[1:] > 0) & ~new_text[1:n]
        # Stretches of tied words; a lone word is one too.
        begin = np.flatnonzero(np.r_[True, ~tied])
        size = np.diff(np.r_[begin, n])
        keep = (size >= phrases.shortest) & (number[begin] > 0)
        begin, size = begin[keep], size[keep]
        if len(begin):
            # The kept stretches one after another, a separator behind each.
            room = size + 1
            start = np.r_[0, np.cumsum(room)[:-1]]
            origin = np.repeat(begin - start, room) + np.arange(int(room.sum()))
            text = np.where(np.arange(len(origin)) == np.repeat(start + size, room), phrases.base, number[origin.clip(max=n - 1)])
            index = FMIndex(text)
            for windows, items in zip(phrases.windows, phrases.items, strict=True):
                lo, hi = index.search(windows)
                which = np.flatnonzero(hi > lo)
                if not len(which):
                    continue
                count = (hi - lo)[which]
                rows = np.repeat(lo[which] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
                word = origin[index.locate(rows)]
                np.add.at(hit, word, 1)
                np.add.at(hit, word + windows.shape[1], -1)
                text_of = np.searchsorted(w.of, word, side="right") - 1
                for i, p in np.unique(np.stack([text_of, np.repeat(which, count)], 1), axis=0).tolist():
                    found.setdefault(i, set()).update(items[p])
    return w, np.cumsum(hit)[:n] > 0, found


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _scan(phrases: Phrases, names: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            _, offsets = flat(b["text"])
            w, hit, found = search_shard(b["text"], phrases)
            sums = np.r_[0, np.cumsum(hit)]
            n_hit = sums[w.of[1:]] - sums[w.of[:-1]]
            items = [sorted(found.get(i, ())) for i in range(b.num_rows)]
            spans: list[list[dict]] = [[] for _ in items]
            edge = np.zeros(len(w) + 1, dtype=bool)
            edge[w.of] = True
            first = np.flatnonzero(hit & ~np.r_[False, hit[:-1]][: len(hit)] | hit & edge[: len(hit)])
            last = np.flatnonzero(hit & ~np.r_[hit[1:], False][: len(hit)] | hit & edge[1 : len(hit) + 1])
            for i, s, e in zip((np.searchsorted(w.of, first, side="right") - 1).tolist(), w.start[first].tolist(), w.end[last].tolist(), strict=True):
                spans[i].append({"start": s - int(offsets[i]), "stop": e - int(offsets[i])})
            out = [pa.array(np.diff(w.of)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items]), pa.array(n_hit > 0), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([b[c] for c in b.schema.names] + out, names=names)

    return go


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of bounded size, read from the cluster one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        block.append((r["item"], r["text"]))
        size += len(r["text"] or "") // 4 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Find benchmark windows of `width` words (or a whole shorter item) in documents.

    Words are lower-cased runs of letters, digits and all that isn't ASCII.
    Returns the columns of `docs` and n_words, n_hit, n_items, items_sha256,
    contaminated, items (sorted ids) and spans (byte ranges of hit words).
    """
    carry = [c for c in docs.columns if c not in RESULT]
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("rest"), F.col(text_col).cast("string").alias("text"))
    ddl = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, stop: long>>"
    schema = StructType(rest.schema.fields + StructType.fromDDL(ddl).fields)
    parts = [rest.mapInArrow(_scan(Phrases(block, width), schema.names), schema) for block in _blocks(benchmark, item_col, "text")]
    out = parts[0] if len(parts) == 1 else _merge(rest, parts)
    return out.select(*[F.col(f"rest.`{c}`") for c in carry], *RESULT)


def _merge(rest: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One row of each document from its rows of several benchmark blocks; rows that repeat in the input stay as many."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    grouped = every.groupBy("rest", "text").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"), (F.count("*") / len(parts)).cast("int").alias("times"))
    joined = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(s))),
    )
    out = grouped.withColumn("spans", joined)
    inside = "aggregate(spans, 0L, (n, s) -> n + regexp_count(cast(substring(cast(text as binary), cast(s.start as int) + 1, cast(s.stop - s.start as int)) as string), '[0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]+'))"
    out = out.withColumn("n_hit", F.expr(inside)).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("_", "times", "all")


def without_spans(text_col: str = "text", spans_col: str = "spans") -> str:
    """SQL for a text without its spans (a space in place of each)."""
    t = f"cast(`{text_col}` as binary)"
    cut = f"substring({t}, cast(a.at as int) + 1, cast(s.start - a.at as int))"
    return (
        f"case when size({spans_col}) > 0 then aggregate({spans_col}, named_struct('out', '', 'at', 0L), "
        f"(a, s) -> named_struct('out', concat(a.out, cast({cut} as string), ' '), 'at', s.stop), "
        f"a -> concat(a.out, cast(substring({t}, cast(a.at as int) + 1) as string))) else `{text_col}` end"
    )
