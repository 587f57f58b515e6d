"""Reading records one by one, and Structured Streaming.

`parse_stream` hands each record of a bounded input to a callback. The
streaming functions take a streaming DataFrame of (input, line_no, line): a
group whose matches are records of their own stays stateless; other groups
hold the open record of each input in state and give it out when the next one
starts, when it ends, or when its input has been quiet for a while.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StringType, StructField, StructType

from ..operators.segment import Fold
from ..plans.plan import GroupPlan, NotStreamable, Plan


def parse_stream(plan: Plan, inputs: DataFrame, each: Callable[[dict[str, Any], tuple[int, int | None], str], None]) -> int:
    """Call each(record, (first line, last line if marked), path) for every record in order; an exception ends it.

    Records come to the driver a partition at a time. The plan is the same as
    for a batch, so both give the same records.
    """
    if why := plan.why_not_streamable():
        raise NotStreamable(why)
    n = 0
    for g in plan.groups:
        df, fields = plan.group_records(inputs, g)
        packed = df.select("input", "at", "start_line", "end_line", F.to_json(F.struct(*[F.col(f"`{f}`") for f in fields])).alias("r")).orderBy("input", "at")
        for row in packed.toLocalIterator():
            each(json.loads(row["r"]), (row["start_line"], row["end_line"]), g.path)
            n += 1
    return n


def stream_records(plan: Plan, lines: DataFrame, timeout: str = "1 minute") -> DataFrame:
    """(input, at, record): records of a streaming DataFrame (input string, line_no bigint, line string), as JSON.

    One query holds the state of one group of several lines; for more of them, start a query for each (`stream_frame`).
    """
    groups = _streamable(plan)
    _one_state(groups)
    out: DataFrame | None = None
    for g in groups:
        df, fields = _group_stream(plan, lines, g, timeout)
        part = df.select("input", "at", F.to_json(F.struct(*[F.col(f"`{f}`") for f in fields])).alias("record"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def stream_frame(plan: Plan, lines: DataFrame, path: str | None = None, timeout: str = "1 minute") -> DataFrame:
    """Typed records of the groups with this name (or of the only one): input, at and the fields, as `Plan.records` gives them for a batch."""
    groups = [g for g in _streamable(plan) if path is None or g.name.replace("*", "") == path]
    _one_state(groups)
    out: DataFrame | None = None
    for g in groups:
        df, fields = _group_stream(plan, lines, g, timeout)
        df = df.select("input", "at", *[F.col(f"`{f}`") for f in fields])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no group named {path}")
    return out


def _streamable(plan: Plan) -> list[GroupPlan]:
    if why := plan.why_not_streamable():
        raise NotStreamable(why)
    return plan.groups


def _one_state(groups: list[GroupPlan]) -> None:
    held = [g.name or "_anonymous_" for g in groups if not g.roles.one_line]
    if len(held) > 1:
        raise NotStreamable({n: ["several groups of several lines need a query each"] for n in held})


def _group_stream(plan: Plan, lines: DataFrame, g: GroupPlan, timeout: str) -> tuple[DataFrame, list[str]]:
    lines = lines.select("input", F.expr("cast(array() as array<bigint>)").alias("key"), F.col("line_no").cast("bigint").alias("line_no"), F.rtrim("line", F.lit("\r \t")).alias("line"))
    return plan._records(lines, g) if g.roles.one_line else _stateful(plan, lines, g, timeout)


def _stateful(plan: Plan, lines: DataFrame, g: GroupPlan, timeout: str) -> tuple[DataFrame, list[str]]:
    matches, fields, recorded = plan._matches(lines, g)
    earlier = {str(c.args[-1]).strip("'\"") for e in plan.groups[: plan.groups.index(g)] for c in e.all_calls() if c.name == "record"}
    if recorded or any(n in text for n in earlier for text in g.group.attrs.values()):
        raise NotStreamable({g.name or "_anonymous_": ["records of several lines with recorded values need the lines of a batch"]})
    types = StructType([StructField(f, StringType() if matches.schema[f].dataType == NullType() else matches.schema[f].dataType) for f in fields])
    rows = matches.select("input", "line_no", "p", F.to_json(F.struct(*[F.col(f"`{f}`") for f in fields])).alias("values"))
    roles, special = g.roles, g.roles.ends | g.roles.markers
    millis = pd.Timedelta(timeout).value // 1_000_000

    def go(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int, int, int | None, str]] = []
        fold = Fold(roles)
        if state.exists:
            (saved,) = state.get
            d = json.loads(saved)
            fold.emitted = d.pop("emitted")
            if d:
                from ..operators.segment import Open

                fold.now = Open(d["rec"], d["opener"], d["start_line"], d["values"], d["ended"], d["end_line"], {int(k): v for k, v in d["count"].items()})

        def give(o) -> None:
            if o is not None:
                out.append((key[0], o.rec, o.start_line, o.end_line, json.dumps({f: o.values[f] for f in fields if f in o.values})))

        if state.hasTimedOut:
            give(fold.now)
            state.remove()
            yield pd.DataFrame(out, columns=["input", "at", "start_line", "end_line", "record"]).astype({"end_line": "Int64"})
            return
        frames = list(batches)
        t = pd.concat(frames).sort_values(["line_no", "p"]) if frames else pd.DataFrame(columns=["input", "line_no", "p", "values"])
        for _, same in t.groupby("line_no", sort=True):
            ps = same["p"].tolist()
            for i, (p, line, values) in enumerate(zip(ps, same["line_no"], same["values"], strict=True)):
                before = fold.now
                fold.step(int(p), int(line), json.loads(values), False, [(q, q in special) for q in ps[i + 1 :]])
                if before is not None and fold.now is not before:
                    give(before)
        now = fold.now
        keep = {"emitted": fold.emitted} | ({} if now is None else {"rec": now.rec, "opener": now.opener, "start_line": now.start_line, "values": now.values, "ended": now.ended, "end_line": now.end_line, "count": now.count})
        state.update((json.dumps(keep),))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["input", "at", "start_line", "end_line", "record"]).astype({"end_line": "Int64"})

    folded = rows.groupBy("input").applyInPandasWithState(go, "input string, at bigint, start_line bigint, end_line bigint, record string", "saved string", "append", "ProcessingTimeTimeout")
    # The group's functions and defaults, as in a batch; they also drop records without values.
    typed = folded.withColumn("_v", F.from_json("record", types)).select("input", F.expr("cast(array() as array<bigint>)").alias("key"), F.col("at").alias("rec"), "at", "start_line", "end_line", *[F.col("_v")[f].alias(f) for f in fields])
    return plan._finish(typed, fields, [], g, lines)
