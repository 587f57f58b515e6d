"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target of words. A document of a source with target t and
size s (all its words) is wanted t/s times: its whole part is taken as is, and
the fraction is an inclusion probability. The cube method rounds these
probabilities to 0 or 1 while the totals of words and of documents stay as
they are: the vector of probabilities walks within the null space of the
balancing constraints until a coordinate of the walk is 0 or 1, with the
martingale's coin deciding the direction, so each document is included with
exactly its probability, but for those few that the landing decides.

Scale: with two constraints a walk needs three undecided documents at a time,
so blocks of BLOCK documents of one source are walked on their own, and each
leaves at most two undecided. Those are walked again in blocks, level by
level. A source lands at the level where it is one block, however large others
are; its last one or two documents are the landing problem, settled so that
the words come nearest to their total. Where they are still off by more than
TOLERANCE (sources of few long documents), at most two decided documents change
sides: in the block itself, or for a source of several blocks in a pass over
two of its documents for each size and side, which leaves out no change of
words. A source with a third of all rows is many blocks. The number of levels
follows from the largest source's count.

Reruns agree: blocks are dealt by a hash of the document, a block's order and
its coins come from the same hash and the seed, and targets are computed from
whole numbers.

Defined results: null texts and texts without words have size 0 and take 0; a
null source is a source of its own, last in order; ids may be null or repeat;
other columns are carried unless named like a result column; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

#: Documents of one source that are walked together.
BLOCK = 4096
RESULT = ("size", "source_size", "target", "taken")
EPS = 1e-9
#: Share of a source's target by which its words may be off without a decided document changing sides.
TOLERANCE = 0.005


def count_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[int], share: float, most: int) -> list[float]:
    """Split share x all words by weight; a target stops at most x its source, and the excess is shared again."""
    total, targets = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = (total - sum(targets)) / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def repair(gain: np.ndarray, error: float, tolerance: float, coin: float) -> list[int]:
    """Which documents change sides, two at most, where the words are off by more than the tolerance.

    `gain` is what a document's change adds to the words. Of the single ones,
    then the pairs, within the tolerance the coin picks one; if there are none,
    what comes nearest is taken, or nothing.
    """
    if abs(error) <= tolerance or not len(gain):
        return []
    single = np.abs(error + gain)
    near = np.flatnonzero(single <= tolerance)
    if len(near):
        return [int(near[int(coin * len(near))])]
    # The best partner of each is beside the place of what it lacks in sorted order, itself left out.
    by = np.argsort(gain, kind="stable")
    g = gain[by]
    at = np.searchsorted(g, -error - g)[:, None] + np.arange(-2, 2)
    off = np.abs(error + g[:, None] + g[np.clip(at, 0, len(g) - 1)])
    off[(at < 0) | (at >= len(g)) | (at == np.arange(len(g))[:, None])] = np.inf
    best = off.min(1)
    near = np.flatnonzero(best <= tolerance)
    if not len(near) and min(single.min(), best.min()) >= abs(error):
        return []
    if not len(near) and single.min() <= best.min():
        return [int(single.argmin())]
    i = int(near[int(coin * len(near))]) if len(near) else int(best.argmin())
    return [int(by[i]), int(by[at[i, off[i].argmin()]])]


def walk(p: np.ndarray, size: np.ndarray, coins: np.ndarray, land: bool, tolerance: float = 0.0) -> np.ndarray:
    """The flight phase over one block, and with `land` its landing.

    Three undecided documents move along the null vector of their words and
    counts until one is decided; the next takes its place. Documents of equal
    size need two only.
    """
    free = (p >= EPS) & (p <= 1 - EPS)
    p = p.astype(float).tolist()
    x = size.astype(float).tolist()
    coins = coins.tolist()
    held: list[int] = []
    used = 0

    def move(ids: list[int], step: list[float]) -> None:
        nonlocal used
        up = min(((1 - p[i]) / s if s > 0 else -p[i] / s) for i, s in zip(ids, step, strict=True) if s)
        down = min((p[i] / s if s > 0 else (p[i] - 1) / s) for i, s in zip(ids, step, strict=True) if s)
        coin = coins[used % len(coins)]
        used += 1
        by = up if coin * (up + down) < down else -down
        for i, s in zip(ids, step, strict=True):
            v = p[i] + by * s
            p[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v

    for i in range(len(p)):
        if not EPS <= p[i] <= 1 - EPS:
            p[i] = round(p[i])
            continue
        held.append(i)
        while len(held) == 3 or len(held) == 2 and x[held[0]] == x[held[1]]:
            if len(held) == 2:
                move(held, [1.0, -1.0])
            else:
                a, b, c = (x[j] for j in held)
                move(held, [b - c, c - a, a - b])
            held = [j for j in held if 0 < p[j] < 1]
    if land:
        due = sum(p[j] * x[j] for j in held)
        # Of the ways to decide what is left, that which comes nearest in words; a tie goes by the coin.
        ways = [[float(i >> b & 1) for b in range(len(held))] for i in range(2 ** len(held))]
        off = [sum(z * x[j] for z, j in zip(way, held, strict=True)) - due for way in ways]
        best = min(range(len(ways)), key=lambda i: (abs(off[i]), (ways[i] == ways[-1]) == (coins[used % len(coins)] < 0.5)))
        for z, j in zip(ways[best], held, strict=True):
            p[j] = z
        out = np.array(p)
        ids = np.flatnonzero(free)
        change = ids[repair((1 - 2 * out[ids]) * np.array(x)[ids], off[best], tolerance, coins[(used + 1) % len(coins)])]
        out[change] = 1 - out[change]
        return out
    return np.array(p)


def _block_walk(seed: int, level: int, share: float):
    def go(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["order", "size", "p"], kind="stable", ignore_index=True)
        first = int(t["order"].iloc[0]) & 0x7FFFFFFF
        coins = np.random.default_rng([seed, level, len(t), first, int(t["source_no"].iloc[0])]).random(len(t) + 4)
        # A source of several blocks is repaired later, among the documents of all.
        tolerance = share * float(t["target"].iloc[0]) if level == 1 else np.inf
        t["p"] = walk(t["p"].to_numpy(), t["size"].to_numpy(), coins, int(t["blocks"].iloc[0]) == 1, tolerance)
        return t

    return go


def _changes(seed: int):
    def go(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["gain", "order"], kind="stable", ignore_index=True)
        coin = np.random.default_rng([seed, int(t["source_no"].iloc[0])]).random()
        return t.loc[repair(t["gain"].to_numpy(), float(t["error"].iloc[0]), float(t["tolerance"].iloc[0]), coin), ["row"]]

    return go


def _repaired(walked: DataFrame, targets: list[float], large: list[int], scratch: Scratch, seed: int) -> DataFrame:
    """Sources of several blocks that are off by more than the tolerance, with up to two documents each on the other side."""
    spark = walked.sparkSession
    sources = spark.createDataFrame([(i,) for i in large], "source_no int")
    sums = walked.join(F.broadcast(sources), "source_no").groupBy("source_no").agg(F.sum(F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken"))
    off = [(r["source_no"], r["taken"] - targets[r["source_no"]], TOLERANCE * targets[r["source_no"]]) for r in sums.toLocalIterator()]
    off = [r for r in off if abs(r[1]) > r[2]]
    if not off:
        return walked
    # Two documents of a size and side stand for all (row_number under a limit is cut before the shuffle).
    gain = walked.join(F.broadcast(spark.createDataFrame(off, "source_no int, error double, tolerance double")), "source_no").select("source_no", "row", "order", "error", "tolerance", ((1 - 2 * F.col("p")) * F.col("size")).alias("gain"))
    few = gain.withColumn("n", F.row_number().over(Window.partitionBy("source_no", "gain").orderBy("order", "row"))).where("n <= 2").drop("n")
    changes = scratch.keep("changes", few.groupBy("source_no").applyInPandas(_changes(seed), "row long"))
    changed = F.broadcast(changes.withColumn("changed", F.lit(True)))
    return walked.join(changed, "row", "left").withColumn("p", F.when(F.col("changed"), 1 - F.col("p")).otherwise(F.col("p"))).select(walked.columns)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Choose how many words of each document a mix takes.

    Sources, in order of code point with null last, weigh `weights`, repeating;
    a row for each of them reaches the driver, so they are kinds of origin, not
    one for each document.
    Returns the columns of `docs` but the text, and size, source_size, target
    (of the source) and taken (a whole number of times the size, `most` at most).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    carry = [c for c in docs.columns if c not in RESULT and c != text_col]
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("rest"), F.col(source_col).alias("source"), count_words(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col)).alias("order"), F.monotonically_increasing_id().alias("row"))
    sized = scratch.keep("sized", rest)

    # A row for each source, not for documents; weights need their order.
    stats = sorted(((r["source"], int(r["size"]), r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("n")).toLocalIterator()), key=lambda r: (r[0] is None, "" if r[0] is None else r[0].encode() if isinstance(r[0], str) else str(r[0]).encode()))
    targets = fill_targets([s for _, s, _ in stats], [weights[i % len(weights)] for i in range(len(stats))], share, most)
    plan = spark.createDataFrame([(i, r[0], r[1], t, -(-r[2] // BLOCK) or 1) for i, (r, t) in enumerate(zip(stats, targets, strict=True))], f"source_no int, source {docs.schema[source_col].dataType.simpleString()}, source_size long, target double, blocks long")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(plan, sized.source.eqNullSafe(plan.source)).select("rest", "source_no", "source_size", "target", "blocks", "size", "order", "row", times.alias("times"))
    whole = F.least(F.floor(F.col("times") + EPS), F.lit(most)).cast("long")
    rows = rows.select("rest", "source_no", "source_size", "target", "blocks", "size", "order", "row", whole.alias("whole"), F.when((F.col("size") == 0) | (F.col("times") - whole < EPS), 0.0).otherwise(F.col("times") - whole).alias("p"))
    decided = [rows.where("p = 0")]
    undecided = rows.where("p > 0")
    level, blocks = 0, max([-(-n // BLOCK) or 1 for _, _, n in stats], default=1)
    while True:
        last = blocks <= 1  # of the largest source; the others have landed
        level += 1
        dealt = undecided.withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), F.col("blocks")))
        walked = scratch.keep(f"level-{level}", dealt.groupBy("source_no", "block").applyInPandas(_block_walk(seed, level, TOLERANCE), dealt.schema))
        decided.append(walked.where("p = 0 or p = 1").drop("block"))
        if last:
            break
        # Each block leaves two documents at most, so the next level's blocks are as full.
        blocks = -(-2 * blocks // BLOCK)
        undecided = walked.where("p > 0 and p < 1").drop("block").withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK).cast("long"))
    walked = decided[1]
    for d in decided[2:]:
        walked = walked.unionByName(d)
    large = [i for i, r in enumerate(stats) if r[2] > BLOCK]
    out = decided[0].unionByName(_repaired(walked, targets, large, scratch, seed) if large else walked)
    return out.select(*[F.col(f"rest.`{c}`") for c in carry], "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken"))

