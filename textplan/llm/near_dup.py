"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives each document its set size, a digest of its
   set, the low b bits of HASHES minima packed into 64-bit words, and a key for
   each band of ROWS whole minima.
2. Documents with equal sets are one class (partial aggregation on the digest),
   so groups of copies are never paired.
3. Classes that share a band's key are candidates. Each is paired with the
   least class of the bucket only; the packed bits' estimate of similarity,
   corrected for chance collisions of b bits, drops pairs far below the
   threshold, and the rest are confirmed on the full sets.
4. Components of the confirmed links are found with tables. Members of a bucket
   that are still in different components and whose estimate allows a link are
   gathered into families, and all pairs of a family across components are
   confirmed on the full sets, in blocks of bounded size, as products of 0/1
   matrices; components are then found again. Pairs are not written out, and
   pairs within a component need no check, so no link between components is
   lost and a bucket of thousands of copies costs one pair for each.

At similarity s a pair shares no band with probability (1 - s^ROWS)^BANDS,
7e-9 at 0.85 and 3e-6 at 0.8, while one of similarity 0.4 meets with 0.28; the
estimate is trusted to six standard errors.

A document's id is its node. Rows of one id with different texts are in several
classes; a link from the least of them to each of the others makes them one.

Defined results: ids are integers (else ValueError); documents with fewer words than a shingle have their whole
word sequence as one; null texts and texts without words have an empty set and
are linked with nothing; rows with a null id are linked with nothing and have
a null component; rows with one id are one node; an empty table gives an empty
result; other columns are carried unless named like a result column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType

from ._store import Scratch
from ._text import NOT_SPACE, U, Words, as_long, flat, mix, pieces, shingle_hash
from .components import components

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
#: Classes of a bucket that are compared in one block.
BLOCK = 1024
#: Members that one copy of a bucket's first class is compared with.
FAN = 512
#: Documents, and shingles of theirs, of a family in one block.
FAMILY_BLOCK, FAMILY_SHINGLES = 512, 400_000
RESULT = ("n_shingles", "component_id", "kept")
_MULTIPLY = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
_FOLD = np.random.default_rng(8).integers(1, 2**63, ROWS, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    w = Words(*flat(column), NOT_SPACE, lower=True)
    all_ = shingle_hash(w.hash, size)
    for a, b in zip(w.of[:-1], w.of[1:], strict=True):
        if b - a >= size:
            yield np.unique(all_[a : b - size + 1])
        elif b > a:
            yield shingle_hash(w.hash[a:b], b - a)
        else:
            yield all_[:0]


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**64 - 1, dtype=U)
    for i in range(0, len(s), 2048):
        np.minimum(out, np.multiply.outer(_MULTIPLY, s[i : i + 2048]).min(1), out=out)
    return out


def _sign(size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = (np.arange(64 // BITS, dtype=U) * U(BITS))[None, :]
        number = np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)
        for b in pieces(batches):
            n, digest, rows = [], [], np.zeros((b.num_rows, HASHES), dtype=U)
            for i, s in enumerate(shingle_sets(b["text"], size)):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                rows[i] = minima(s)
            packed = ((rows & U(2**BITS - 1)).reshape(b.num_rows, -1, 64 // BITS) << shift).sum(2)
            with np.errstate(over="ignore"):
                bands = mix((rows.reshape(b.num_rows, BANDS, ROWS) * _FOLD).sum(2) + number)

            def lists(x):
                return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(as_long(np.ascontiguousarray(x)).ravel()))

            yield pa.RecordBatch.from_arrays([b["rest"], b["id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(packed), lists(bands)], names=["rest", "id", "n", "digest", "bits", "bands"])

    return go


def estimate(a: str, b: str) -> str:
    """SQL for the similarity that the packed bits of two columns tell, corrected for chance."""
    low = sum(1 << i for i in range(0, 64, BITS))
    fold = " | ".join(f"shiftrightunsigned(x ^ y, {i})" for i in range(BITS))
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({fold}) & {low}L)), 0, (u, v) -> u + v)"
    chance = 2.0**-BITS
    return f"((1 - {differ} / {float(HASHES)}D) - {chance}D) / {1 - chance}D"


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - 6 * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def _confirm(size: int, percent: int):
    """For rows sorted by (a, salt), the text of `a` itself (b null) first: the links among them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, []
        for batch in pieces(batches):
            a, salt, b = (batch[c].to_pylist() for c in ("a", "salt", "b"))
            out = []
            for i, s in enumerate(shingle_sets(batch["text"], size)):
                if b[i] is None:
                    if key != (a[i], salt[i]):
                        key, mine = (a[i], salt[i]), []
                    mine.append(s)
                elif key == (a[i], salt[i]):
                    for m in mine:
                        both = len(np.intersect1d(m, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(m) + len(s) - both):
                            out.append((a[i], b[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return go


def _by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each group, from batches sorted by these integer columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        ids = np.stack([b[c].to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and last != ids[s].tolist():
                yield held
                held = []
            held.append(b.slice(s, e - s))
            last = ids[s].tolist()
    if held:
        yield held


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare: a block with itself, or two blocks."""
    left = np.flatnonzero(side <= 0)
    return left, np.flatnonzero(side > 0) if (side > 0).any() else left


def _across(threshold: float):
    """For rows sorted by (key, i, j): members that may be similar enough to one of another component.

    Each comes with its component and one that its component then belongs with.
    """
    least, chance = least_estimate(threshold), 2.0**-BITS
    low = U(sum(1 << i for i in range(0, 64, BITS)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_group(batches, ("key", "i", "j")):
            t = pa.Table.from_batches(held)
            cls, comp, n, side = (t[c].to_numpy() for c in ("cls", "component", "n", "side"))
            bits = t["bits"].combine_chunks().flatten().to_numpy().view(U).reshape(t.num_rows, -1)
            left, right = _sides(side)
            touched = np.zeros(t.num_rows, dtype=bool)
            root = comp.copy()
            for x in left:
                other = right[(comp[right] != comp[x]) & (np.minimum(n[right], n[x]) >= threshold * np.maximum(n[right], n[x]) - 1e-9)]
                d = bits[other] ^ bits[x]
                f = d.copy()
                for i in range(1, BITS):
                    f |= d >> U(i)
                same = 1 - np.bitwise_count(f & low).sum(1) / HASHES
                other = other[(same - chance) / (1 - chance) >= least]
                if len(other):
                    touched[x] = touched[other] = True
                    root[np.isin(root, root[other])] = root[x]
            at = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(comp[at]), pa.array(root[at])], names=["cls", "component", "root"])

    return go


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of left and right sets, as products of 0/1 matrices over values that two sets hold."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, int(often.sum()) - lo)), dtype=np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _confirm_family(size: int, percent: int):
    """For rows sorted by (family, i, j): links between components, confirmed on full sets, one for each two components that meet."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_group(batches, ("family", "i", "j")):
            t = pa.Table.from_batches(held)
            cls, root, side = (t[c].to_numpy().copy() for c in ("cls", "component", "side"))
            sets = [s for b in pieces(iter(held)) for s in shingle_sets(b["text"], size)]
            left, right = _sides(side)
            n = np.array([len(s) for s in sets])
            both = _shared_counts(sets, left, right)
            linked = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
            out = []
            for i, x in enumerate(left):
                other = right[linked[i]]
                for r in np.unique(root[other]):
                    if r != root[x]:
                        out.append((cls[x], cls[other[root[other] == r][0]]))
                        root[root == r] = root[x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return go


def _in_blocks(members: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows with `blocks` dealt to pairs of blocks (i <= j) of their group; side tells which block a row is of (0: i is j)."""
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    spread = members.select(group, *columns, block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns, F.expr("case when block = other then 0 when block < other then -1 else 1 end").alias("side"))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of `size`-word shingles have a Jaccard similarity of percent/100 or more.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. Returns
    the other columns of `docs` and n_shingles, component_id (the smallest id
    that links reach) and kept (the id is component_id).
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; near_duplicates needs integer ids")
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    threshold = percent / 100
    carry = [c for c in docs.columns if c not in RESULT and c not in (id_col, text_col)]
    fields = [docs.schema[id_col], *(docs.schema[c] for c in carry)]
    rest = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("rest"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = rest.drop("text").schema.add("n", "long").add("digest", "binary").add("bits", ArrayType(LongType())).add("bands", ArrayType(LongType()))
    signed = scratch.keep("signed", rest.mapInArrow(_sign(size), schema))

    linked = signed.where("n > 0 and id is not null")
    classes = scratch.keep("classes", linked.groupBy("digest").agg(F.min("id").alias("cls"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    entries = classes.select(F.explode("bands").alias("key"), "cls")
    first = entries.groupBy("key").agg(F.min("cls").alias("a"), F.count("*").alias("in_bucket")).where("in_bucket > 1")
    bucket = scratch.keep("bucket", entries.join(first, "key"))
    lean = classes.select("cls", "n", "bits")
    close = f"least(na, nb) >= {threshold}D * greatest(na, nb) - 1e-9D and {estimate('xa', 'xb')} >= {least_estimate(threshold)}D"

    def likely(pairs: DataFrame) -> DataFrame:
        one = lean.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
        two = lean.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
        return pairs.join(one, "a").join(two, "b").where(close).select("a", "b").distinct()

    # One join fetches the texts of all candidates, by sort and merge at any size; both confirmations read what it wrote.
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = scratch.keep("texts", every.hint("merge").join(bucket.select(F.col("cls").alias("id")).distinct(), "id", "left_semi"))

    def confirm(pairs: DataFrame) -> DataFrame:
        fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
        dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt"))
        own = fan.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
        wanted = dealt.select(F.col("b").alias("id"), "a", "b", "salt").unionByName(own.select(F.col("a").alias("id"), "a", "b", "salt"))
        both = texts.join(wanted, "id").select("a", "salt", "b", "text")
        both = both.repartition(n_parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return scratch.keep("links", both.mapInArrow(_confirm(size, percent), "a long, b long"))

    pairs = scratch.keep("pairs", likely(bucket.where("cls <> a").select("a", F.col("cls").alias("b")).distinct()))
    links = confirm(pairs)
    # Ids with different sets: each of their classes is linked to the least one.
    several = linked.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    several = scratch.keep("several", linked.select("id", "digest").join(several, "id").join(classes.select("digest", "cls"), "digest").select("id", "cls").distinct())
    if not several.isEmpty():
        links = links.unionByName(several.join(several.groupBy("id").agg(F.min("cls").alias("a")), "id").select("a", F.col("cls").alias("b")))
    labels = components(links, scratch, "first")

    # Members of one bucket that are still apart.
    member = bucket.join(labels, bucket.cls == labels.node, "left").select("key", "cls", "in_bucket", F.coalesce("component", "cls").alias("component"))
    apart = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("in_bucket").alias("of")).where("lo <> hi").select("key", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks"))
    spread = _in_blocks(member.select("key", "cls", "component").join(apart, "key").join(lean, "cls"), "key", ["cls", "component", "n", "bits"])
    spread = spread.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    still = scratch.keep("still", spread.mapInArrow(_across(threshold), "cls long, component long, root long"))
    if not still.isEmpty():
        # Families of components with likely pairs; their members are compared once, whatever buckets they share.
        family = components(still.select(F.col("component").alias("a"), F.col("root").alias("b")).distinct(), scratch, "families").select("node", F.col("component").alias("family"))
        mine = still.select("cls", "component").distinct().join(family, F.col("component") == F.col("node")).join(lean.select("cls", "n"), "cls").select("cls", "component", "family", "n")
        size_of = mine.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total")).select("family", F.ceil(F.greatest(F.col("m") / FAMILY_BLOCK, F.col("total") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
        rows = _in_blocks(mine.join(size_of, "family"), "family", ["cls", "component"])
        rows = texts.join(rows, texts.id == rows.cls).select("family", "i", "j", "cls", "component", "side", "text")
        rows = rows.repartition(n_parts, "family", "i", "j").sortWithinPartitions("family", "i", "j")
        more = scratch.keep("links-across", rows.mapInArrow(_confirm_family(size, percent), "a long, b long"))
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch, "second")
    named = scratch.keep("named", classes.select("digest", "cls").join(labels, classes.cls == labels.node, "left").select("digest", F.coalesce("component", "cls").alias("component")))
    scratch.drop("classes", "bucket", "pairs", "still", "texts", "several")
    out = signed.select("rest", "id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(*[F.col(f"rest.`{f.name}`") for f in fields], F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
