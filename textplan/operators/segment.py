"""Line matches to records: which record each match belongs to.

`closed` groups (no end marker, no free-text lines) need a window only; the
others go through a fold over sorted rows that keeps one open record in
memory. Both add `rec`, a number that grows along the input, to the matches of
records and drop the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Lines after its start in which a record without markers takes members.
NEAR = 100
KEYS = ["input", "key"]
#: Bytes of the tables read, in their files, for one task that sorts lines.
TASK_BYTES = 12 << 20
MOST_TASKS = 20_000
#: Sizes from here on are not estimates.
UNKNOWN = 1 << 50


@dataclass(frozen=True)
class Roles:
    """What the patterns of a group do."""

    patterns: int
    starts: frozenset[int]
    markers: frozenset[int] = frozenset()
    ends: frozenset[int] = frozenset()
    whole_line: bool = False
    blank_start: bool = False
    joined: bool = False  # a start pattern has a variable that collects
    table: bool = False

    @property
    def closed(self) -> bool:
        pre = self.starts - self.markers if self.markers else frozenset()
        return not self.ends and not self.whole_line and not self.blank_start and not self.joined and len(pre) <= 1

    @property
    def one_line(self) -> bool:
        """Every match is a record of its own."""
        return self.table or self.patterns == 1 and not self.joined and self.closed


def evenly(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by these columns over as many tasks as the tables below them ask for, TASK_BYTES each.

    Text is compressed well in files and shuffles and takes many times that
    when its lines are sorted, so tasks cut by the shuffle's bytes, or a fixed
    number of them, would sort more and more as tables grow.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    plan = rows.select(*by)._jdf.queryExecution().optimizedPlan()
    if plan.nodeName() == "Project":  # dealt out by a constant too, rows would be shuffled again for a window that ignores it
        made = [plan.projectList().apply(i) for i in range(len(by))]
        by = tuple(c for c, e in zip(by, made, strict=True) if not (e.nodeName() == "Alias" and e.child().foldable())) or by
    if size < UNKNOWN:
        n = min(max(-(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism)), MOST_TASKS)
    return rows.repartition(n, *by)


def last_so_far(rows: DataFrame, columns: list[str], by: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """These columns with the last value that isn't null up to each row, along `order` within `by`.

    With a chunk (a number that grows along the order), no task holds more
    than one of them: each chunk's last values are carried to the next ones
    through a table of one row a chunk.
    """
    quoted = [f"`{c}`" for c in columns]
    if chunk is None:
        rows = evenly(rows, *by)
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({c: F.last(F.col(q), ignorenulls=True).over(w) for c, q in zip(columns, quoted, strict=True)})
    rows = rows.withColumn("_chunk", chunk)
    mine = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*by, "_chunk").agg(*[F.max_by(F.col(q), F.when(F.col(q).isNotNull(), F.struct(*order))).alias(f"_last{i}") for i, q in enumerate(quoted)])
    chunks = chunks.select(*by, "_chunk", *[F.last(f"_last{i}", ignorenulls=True).over(before).alias(f"_last{i}") for i in range(len(columns))])
    rows = rows.join(chunks, [*by, "_chunk"]).withColumns({c: F.coalesce(F.last(F.col(q), ignorenulls=True).over(mine), F.col(f"_last{i}")) for i, (c, q) in enumerate(zip(columns, quoted, strict=True))})
    return rows.drop("_chunk", *[f"_last{i}" for i in range(len(columns))])


def segment(matches: DataFrame, roles: Roles, chunk_lines: int | None = None, together: bool = False) -> DataFrame:
    """Add `rec` (and `end_line`) to the matches of records. together: those of one input are in one task already.

    With chunk_lines, a closed group of one huge input is numbered in chunks
    of that many lines, so that no task holds the input: each chunk's last
    start is carried to the next ones through a table of one row a chunk.
    """
    place = F.col("line_no") * roles.patterns + F.col("p")
    if roles.one_line:
        return matches.withColumn("rec", place).withColumn("end_line", F.lit(None).cast("bigint"))
    if not roles.closed:
        return _folded(matches, roles)
    if chunk_lines:
        return _members(_in_chunks(matches, roles, place, chunk_lines), roles)
    if not together:
        matches = evenly(matches, *KEYS)
    w = Window.partitionBy(*KEYS).orderBy("line_no", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("p").isin(*roles.starts)
    if roles.markers:
        marker = F.col("p").isin(*roles.markers)
        matches = matches.withColumn("seen", F.max(marker.cast("int")).over(w))
        start = marker | F.col("p").isin(*(roles.starts - roles.markers or {-1})) & (F.col("seen") == 0)
    out = matches.withColumn("starts", start).withColumn("rec", F.last(F.when(F.col("starts"), place), ignorenulls=True).over(w))
    return _members(out, roles)


def _members(out: DataFrame, roles: Roles) -> DataFrame:
    near = F.col("starts") | (F.col("line_no") - F.floor(F.col("rec") / roles.patterns) < NEAR)
    if roles.markers:  # their records take members from any distance
        near = near | F.floor(F.col("rec") % roles.patterns).isin(*roles.markers)
    return out.where("rec is not null").where(near).drop("starts", "seen").withColumn("end_line", F.lit(None).cast("bigint"))


def _in_chunks(matches: DataFrame, roles: Roles, place: Column, chunk_lines: int) -> DataFrame:
    marker = F.col("p").isin(*(roles.markers or {-1}))
    other = F.col("p").isin(*(roles.starts - roles.markers or {-1}))
    rows = matches.withColumn("chunk", F.floor(F.col("line_no") / chunk_lines))
    mine = Window.partitionBy(*KEYS, "chunk").orderBy("line_no", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Without markers every start counts; with them, others count until the first marker.
    free = other & (F.max(marker.cast("int")).over(mine) == 0) if roles.markers else other
    rows = rows.withColumn("_marked", F.when(marker, place)).withColumn("_free", F.when(free, place))
    chunks = rows.groupBy(*KEYS, "chunk").agg(F.max("_marked").alias("marked"), F.max("_free").alias("free"))
    before = Window.partitionBy(*KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("seen_before", F.coalesce(F.max(F.col("marked").isNotNull()).over(before), F.lit(False)))
    chunks = chunks.withColumn("last", F.greatest("marked", F.when(~F.col("seen_before"), F.col("free"))))
    chunks = chunks.withColumn("carried", F.max("last").over(before)).select(*KEYS, "chunk", "seen_before", "carried")
    rows = rows.join(chunks, [*KEYS, "chunk"])
    rows = rows.withColumn("_start", F.coalesce("_marked", F.when(~F.col("seen_before"), F.col("_free"))))
    rec = F.coalesce(F.max("_start").over(mine), F.col("carried"))
    return rows.withColumn("starts", F.col("_start").isNotNull()).withColumn("rec", rec).drop("chunk", "_marked", "_free", "_start", "seen_before", "carried")


@dataclass
class Open:
    """The open record of a fold."""

    rec: int
    opener: int
    start_line: int
    values: dict = field(default_factory=dict)
    ended: bool = False
    end_line: int | None = None
    count: dict[int, int] = field(default_factory=dict)


class Fold:
    """The decisions of a group with end markers, free-text lines or collecting start patterns, one match at a time."""

    def __init__(self, roles: Roles):
        self.r, self.now, self.emitted = roles, None, 0

    def _opens(self, p: int, line: int) -> bool:
        r, now = self.r, self.now
        if now is None:
            return True
        near = 0 <= line - now.start_line < NEAR
        if r.whole_line and p == 0:
            return False
        if r.markers:
            if p in r.markers:
                return True
            if r.ends and not now.ended:
                return False
            if now.opener in r.markers:
                return False
            return p == now.opener or not near
        if r.whole_line:
            return p != now.opener and not near
        return True

    def _joins(self, p: int, line: int) -> str:
        """For a match that can't start by its pattern: merge, start or ignore."""
        r, now = self.r, self.now
        if now is None:
            return "start" if not r.whole_line and self.emitted and not r.ends and r.blank_start else "ignore"
        if now.ended:
            return "start" if p == 0 else "ignore"
        again = now.count.get(p, 0) > 0
        if r.whole_line and again or r.blank_start and not r.ends and p == now.opener and again:
            return "start"
        if now.opener in r.markers or r.ends or r.whole_line or 0 <= line - now.start_line < NEAR:
            return "merge"
        return "ignore"

    def step(self, p: int, line: int, plain: dict, collects: bool, ahead: list[tuple[int, bool]]) -> int | None:
        """The record of this match, or None. `ahead`: (pattern, is end or start marker) of later matches on its line."""
        r = self.r
        if p in r.starts:
            action = "start" if self._opens(p, line) else "merge"
            if action == "start" and collects and self.now is not None and not r.table:
                same = not plain or p == self.now.opener or all(self.now.values.get(k) == v for k, v in plain.items())
                if same:
                    action = "merge"
            if action == "start" and r.markers and r.ends and self.now is not None:
                waits = p in r.markers and any(not special and not self.now.count.get(q, 0) for q, special in ahead)
                if waits or not self.now.ended and not (p in r.markers and p == self.now.opener):
                    self.now.start_line = line
                    action = "merge"
        else:
            action = self._joins(p, line)
        if action == "ignore":
            return None
        if action == "start":
            self.emitted += self.now is not None
            self.now = Open(line * r.patterns + p, p, line)
        now = self.now
        for k, v in plain.items():
            now.values.setdefault(k, v)
        now.count[p] = now.count.get(p, 0) + 1
        rec = now.rec
        if p in r.ends:
            now.ended, now.end_line = True, line
            if p in r.starts:
                self.emitted += 1
                self.now = None
        return rec


def _folded(matches: DataFrame, roles: Roles) -> DataFrame:
    """Batches of sorted matches through the fold; only places, patterns and (where start patterns collect) values are looked at row by row."""
    names = [n for n in matches.columns if n not in (*KEYS, "line_no", "p")]
    joined = [n for n in names if n.startswith("_j:")]
    rows = matches.withColumn("_key", F.xxhash64("key"))
    extra = ["_key"]
    if joined:  # whether a start goes on with the open record depends on its values
        collects = F.lit(False)
        for n in joined:
            collects = collects | F.col(f"`{n}`").isNotNull()
        plain = [n for n in names if n not in joined]
        rows = rows.withColumn("_plain", F.to_json(F.struct(*[F.col(f"`{n}`") for n in plain])) if plain else F.lit("{}")).withColumn("_collects", collects)
        extra += ["_plain", "_collects"]
    rows = evenly(rows, *KEYS).sortWithinPartitions("input", "key", "line_no", "p")
    special = roles.ends | roles.markers
    # Patterns whose matches always join a record that is open and has not ended.
    plain_members = roles.ends and not joined and not roles.whole_line and not roles.blank_start
    members = frozenset(range(roles.patterns)) - roles.starts - roles.ends if plain_members else frozenset()
    schema = StructType([*rows.drop(*extra).schema.fields, *StructType.fromDDL("rec bigint, end_line bigint").fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, who, rest = Fold(roles), None, None

        def numbered(t: pa.Table) -> list[pa.RecordBatch]:
            nonlocal fold, who
            n = t.num_rows
            t = t.combine_chunks()
            lines, ps = t["line_no"].to_numpy(), t["p"].to_numpy()
            new_input = np.zeros(n, dtype=bool)  # a row of another input (or parent's record) than the one before
            if n > 1:
                name, key = t["input"].combine_chunks(), t["_key"].to_numpy()
                new_input[1:] = pc.not_equal(name[1:], name[:-1]).fill_null(True).to_numpy(zero_copy_only=False) | (key[1:] != key[:-1])
            if n:
                first = (t["input"][0].as_py(), t["_key"][0].as_py())
                new_input[0] = first != who
                who = (t["input"][-1].as_py(), t["_key"][-1].as_py())
            new_line = new_input.copy()
            new_line[1:] |= lines[1:] != lines[:-1]
            several = np.flatnonzero(~np.r_[new_line[1:], [True]])  # rows with another match of their line behind them
            ahead: dict[int, list[tuple[int, bool]]] = {}
            for j in reversed(several.tolist()):
                q = int(ps[j + 1])
                ahead[j] = [(q, q in special), *ahead.get(j + 1, ())]
            none: list[tuple[int, bool]] = []
            plain = [json.loads(x) for x in t["_plain"].to_pylist()] if joined else None
            collects = t["_collects"].to_pylist() if joined else None
            rec: list[int | None] = []
            for j, (p, line, new) in enumerate(zip(ps.tolist(), lines.tolist(), new_input.tolist(), strict=True)):
                if new:
                    fold = Fold(roles)
                if p in members and (now := fold.now) is not None and not now.ended:  # what a step would do, without one
                    now.count[p] = 1
                    rec.append(now.rec)
                    continue
                rec.append(fold.step(p, line, plain[j] if joined else {}, bool(collects[j]) if joined else False, ahead.get(j, none)))
            rec_ = pa.array(rec, pa.int64())
            ended = pa.array(lines, mask=~np.isin(ps, list(roles.ends)), type=pa.int64())
            out = t.drop_columns(extra).append_column("rec", rec_).append_column("end_line", ended)
            return out.filter(pc.is_valid(rec_)).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            if not t.num_rows:
                continue
            # The last line of the last input may go on in the next batch.
            line, key = t["line_no"].to_numpy(), t["_key"].to_numpy()
            other = pc.not_equal(t["input"], t["input"][-1]).combine_chunks().fill_null(True).to_numpy(zero_copy_only=False)
            differs = np.flatnonzero((line != line[-1]) | (key != key[-1]) | other)
            cut = int(differs[-1]) + 1 if len(differs) else 0
            yield from numbered(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from numbered(rest)

    return rows.mapInArrow(go, schema)
