"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Index: each tree splits a bounded sample of vectors at the median of a random
direction until a leaf holds few; then every vector goes down every tree to
its leaf. Large inner products are not near points, so vectors are lifted by
one coordinate, sqrt(M^2 - |x|^2) with M the largest norm; queries get zero
there, and the nearest lifted points are those with the largest product.

Search: for each query, one priority queue holds the unexplored branches of
all trees by their margin to the query. The best branch is followed down to
its leaf, the other sides are queued, until SHARE of the leaves are found, or
as many as FLOOR vectors fill, if that is more: a table of up to FLOOR vectors
is searched whole. Queries
meet the vectors of their leaves by a join on (tree, leaf, part, block), are
scored exactly in double precision, and the best of each leaf are merged.

Scale: equal vectors are one point with their `k + 1` least ids (no other can
be in a result), chosen with a partial limit before any shuffle, so a vector
that a third of all rows hold is one point, indexed and searched once. A leaf's
vectors are dealt in parts and its queries in blocks, both of about PART rows,
so a task holds one part and one block; a part is sent once for each block and
a block once for each part, one row for PART comparisons. The forest is of the size of its sample,
which grows with the table up to SAMPLE, and travels as a broadcast of at most
that size. Queries are every row whose id is divisible by QUERY_STEP.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; rows with a null id take no
part; rows that repeat an id and a vector count once; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

TREES, LEAF, SEED = 4, 160, 11
#: Leaves of a tree at most, and the share of the forest's leaves that a query probes. Both are set by recall: among
#: vectors without structure in 64 dimensions the nearest are hardly nearer than others, and 0.9 takes this much.
LEAVES, SHARE = 64, 0.3
#: Vectors whose number of leaves a query probes at least: a small table has few leaves, and a share of them finds too little.
FLOOR = 3000
SAMPLE = 65_536
#: Vectors of a leaf, and queries, that a task scores at a time.
PART = 16_384


class Tree:
    """Inner nodes in arrays: direction, threshold, children (leaves are ~number)."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.direction, self.at, self.left, self.right, self.leaves = [], [], [], [], 0
        self.root = self._split(sample, np.arange(len(sample)), leaf, rng)
        self.direction = np.array(self.direction) if self.direction else np.zeros((0, sample.shape[1]))
        self.at = np.array(self.at)

    def _split(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            # Between two random points, as far as they differ.
            a, b = x[rng.choice(rows, 2, replace=False)]
            d = a - b if np.abs(a - b).max() > 1e-9 else rng.normal(size=x.shape[1])
            d = d / np.linalg.norm(d)
            p = x[rows] @ d
            cut = float(np.median(p))
            low = p < cut
            if low.any() and not low.all():
                node = len(self.direction)
                self.direction.append(d)
                self.at.append(cut)
                self.left.append(0)
                self.right.append(0)
                self.left[node] = self._split(x, rows[low], leaf, rng)
                self.right[node] = self._split(x, rows[~low], leaf, rng)
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        left, right = np.array(self.left, dtype=np.int64), np.array(self.right, dtype=np.int64)
        live = np.flatnonzero(node >= 0)
        while len(live):
            n = node[live]
            node[live] = np.where((x[live] * self.direction[n]).sum(1) < self.at[n], left[n], right[n])
            live = live[node[live] >= 0]
        return ~node


class Forest:
    def __init__(self, sample: np.ndarray, norm: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        self.norm = norm
        lifted = self.lift(sample)
        self.trees = [Tree(lifted, leaf, np.random.default_rng([seed, i])) for i in range(trees)] if len(sample) else []

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))]

    def probe(self, query: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order in which the shared queue yields them."""
        q = np.r_[query / max(np.linalg.norm(query), 1e-300) * self.norm, 0.0]
        margins = [t.direction @ q - t.at if len(t.at) else t.at for t in self.trees]
        queue = [(-np.inf, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found: list[tuple[int, int]] = []
        while queue and len(found) < probes:
            worst, i, node = heapq.heappop(queue)
            t, margin = self.trees[i], margins[i]
            while node >= 0:
                m = margin[node]
                near, far = (t.right[node], t.left[node]) if m >= 0 else (t.left[node], t.right[node])
                heapq.heappush(queue, (max(worst, abs(m)), i, far))
                node = near
            found.append((i, ~node))
        return found


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def _index(forest):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f: Forest = forest.value
        for t in batches:
            for i in range(0, len(t), 4096):
                part = t.iloc[i : i + 4096]
                x = f.lift(_stack(part["v"]))
                yield pd.concat([pd.DataFrame({"tree": np.int32(n), "leaf": tree.leaf_of(x).astype(np.int32), "point": part["point"].to_numpy(), "least": part["least"].to_numpy(), "v": part["v"].to_numpy()}) for n, tree in enumerate(f.trees)], ignore_index=True)

    return go


def _probe(forest, probes: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f: Forest = forest.value
        for t in batches:
            for i in range(0, len(t), 64):
                part = t.iloc[i : i + 64]
                rows = [(tree, leaf, p, v) for p, v in zip(part["point"], part["v"], strict=True) for tree, leaf in f.probe(np.asarray(v, dtype=float), probes)]
                yield pd.DataFrame(rows, columns=["tree", "leaf", "query", "q"]).astype({"tree": "int32", "leaf": "int32"})

    return go


def _score(k: int):
    """Points of one leaf part with the queries that probe it: each query's best k points."""

    def go(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            points = points.sort_values("point", ignore_index=True)
            x, least = _stack(points["v"]), points["least"].to_numpy()
            for i in range(0, len(queries), 256):
                part = queries.iloc[i : i + 256]
                q = _stack(part["q"])
                rough = q @ x.T
                m = min(k, len(x))
                edge = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m] - 1e-9 * (1 + np.abs(rough).max(1))
                for j, query in enumerate(part["query"]):
                    near = np.flatnonzero(rough[j] >= edge[j])
                    score = products(q[j], x[near])
                    best = np.lexsort((least[near], -score))[:k]
                    out.append(pd.DataFrame({"query": query, "point": points["point"].to_numpy()[near[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return go


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component, so that equal vectors score alike everywhere."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


def nearest(vectors: DataFrame, k: int = 20, step: int = 20, share: float = SHARE, trees: int = TREES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each row whose id is divisible by `step`.

    Returns query_id, rank (from 1), vec_id, score (the exact inner product);
    nearest first, ties to the smaller vec_id, the query's own id left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("v")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    usable = usable.where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)).select("id", F.transform(v, lambda c: c + 0.0).alias("v"))
    lengths = usable.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    rows = scratch.keep("rows", usable.where(F.size("v") == width).select("id", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("h2")))

    # Points: distinct vectors; of equal ones the k + 1 least ids (row_number under a limit is cut before the shuffle).
    few = rows.select("h", "h2", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = few.groupBy("h", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("point"))
    points = scratch.keep("points", ids.join(rows.select(F.col("id").alias("point"), "h", "h2", "v"), ["h", "h2", "point"]).dropDuplicates(["h", "h2", "point"]).select("h", "h2", F.xxhash64("h", "h2").alias("point"), F.col("point").alias("least"), "ids", "v"))
    asked = rows.where(F.pmod("id", F.lit(step)) == 0).select(F.col("id").alias("query_id"), "h", "h2").distinct()
    queries = points.join(asked.select("h", "h2").distinct(), ["h", "h2"], "left_semi").select("point", "v")

    facts = points.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm")).collect()[0]
    n = facts["n"]
    sample = points.where(F.pmod(F.xxhash64("point", F.lit(SEED)), F.lit(1 << 20)) < int(min(1.0, SAMPLE * 0.9 / max(n, 1)) * (1 << 20))).select("point", "v").limit(SAMPLE).toArrow()
    sample = sample.take(pc.sort_indices(sample["point"]))["v"].combine_chunks()
    fitted = Forest(sample.flatten().to_numpy().reshape(len(sample), width), facts["norm"] or 0.0, trees, max(LEAF, -(-len(sample) // LEAVES)))
    if not fitted.trees:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = spark.sparkContext.broadcast(fitted)
    probes = max(1, math.ceil(max(share, min(1.0, FLOOR / n)) * sum(t.leaves for t in fitted.trees)))
    leaves = sum(t.leaves for t in fitted.trees)
    parts = max(1, -(-n * len(fitted.trees) // (leaves * PART)))
    blocks = max(1, -(-queries.count() * probes // (leaves * PART)))

    indexed = points.select("point", "least", "v").mapInPandas(_index(forest), "tree int, leaf int, point long, least long, v array<double>")
    indexed = indexed.withColumn("part", F.pmod("point", F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    probed = queries.repartition(n_parts, "point").mapInPandas(_probe(forest, probes), "tree int, leaf int, query long, q array<double>").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    leaf = ["tree", "leaf", "part", "block"]
    scored = indexed.groupBy(*leaf).cogroup(probed.groupBy(*leaf)).applyInPandas(_score(k + 1), "query long, point long, score double")
    found = scored.distinct().join(points.select("point", "least", "ids"), "point")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    flat = found.select("query", "score", F.explode("ids").alias("vec_id"))
    flat = flat.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = scratch.keep("lists", flat.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")))

    asked = asked.join(points.select("h", "h2", F.col("point").alias("query")), ["h", "h2"])
    own = asked.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("i", "s")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "s.vec_id", "s.score")
