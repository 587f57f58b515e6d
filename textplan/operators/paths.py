"""Records to a nested result: one tree of JSON for each input, or one for all.

Records of an input meet in one group, as the tree is one value; typed frames
(`Plan.records`) are the way to work with many records of one input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import group as group_functions
from ..functions.inputs import hostname

SEP = "\x1f"


class Raw(str):
    """A record that stays the JSON that it is."""


def dump(x: Any) -> str:
    if isinstance(x, Raw):
        return x
    if isinstance(x, dict):
        return "{" + ", ".join(f"{json.dumps(k)}: {dump(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(map(dump, x)) + "]"
    return json.dumps(x)


def store(tree: dict[str, Any], segments: list[str], records: list[Any]) -> None:
    """Put a group's records at a path. A segment with * is a list, with ** a map; one record without either is a map."""
    here: Any = tree
    for i, s in enumerate(segments):
        name, stars = s.rstrip("*"), len(s) - len(s.rstrip("*"))
        last = i == len(segments) - 1
        if not last:
            nxt = here.get(name)
            if nxt is None:
                nxt = here[name] = [{}] if stars == 1 else {}
            if isinstance(nxt, list):
                nxt = nxt[0] if nxt else nxt.append({}) or nxt[0]
            here = nxt
            continue
        old = here.get(name)
        if stars == 2:
            new = old if isinstance(old, dict) else {}
            for r in records:
                new.update(json.loads(r) if isinstance(r, Raw) else r)
            here[name] = new
        elif stars == 1:
            here[name] = [*(old if isinstance(old, list) else [] if old is None else [old]), *records]
        elif old is None:
            here[name] = records[0] if len(records) == 1 else list(records)
        else:
            here[name] = [*(old if isinstance(old, list) else [old]), *records]


def build(rows: list[tuple[str, Any]], named: dict[str, dict[str, Any]]) -> Any:
    """A tree of (path, record) in order; a group without a name gives a list instead."""
    tree: dict[str, Any] = {}
    at = 0
    while at < len(rows):
        path = rows[at][0]
        end = at
        while end < len(rows) and rows[end][0] == path:
            end += 1
        store(tree, path.split(SEP), [r for _, r in rows[at:end]])
        at = end
    for path, values in named.items():
        store(tree, path.split("."), [values])
    if list(tree) == ["_anonymous_"]:
        return tree["_anonymous_"]
    return tree


def collapse(x: Any) -> Any:
    """Nested groups of one record are a map."""
    if isinstance(x, dict):
        return {k: collapse(v) for k, v in x.items()}
    if isinstance(x, list):
        items = [collapse(v) for v in x]
        return items[0] if len(items) == 1 and isinstance(items[0], dict) else items
    return x


def results(plan, inputs: DataFrame) -> DataFrame:
    """(input, result): a tree of JSON for each input, also for those without records.

    Rows of records, and one more for each input, meet by input in order of
    group and place. A record without nested groups goes into the tree as the
    JSON that it is.
    """
    from ..plans.plan import resolved_path

    together = plan.template.attrs.get("results") == "per_template"
    named = plan.template.named_vars
    asks = any(v == "gethostname" for values in named.values() for v in values.values())
    host = F.first(hostname(F.col("text"))).alias("path") if asks else F.lit(None).cast("string").alias("path")
    none = F.lit(None).cast("string")
    rows = inputs.groupBy("input").agg(host) if asks else inputs.select("input", host)
    rows = rows.select("input", F.lit(-1).alias("g"), F.lit(0).cast("bigint").alias("at"), "path", none.alias("record"), F.lit(False).alias("item"), F.lit(False).alias("nested"))
    for order, g in enumerate(plan.groups):
        if g.group.attrs.get("void", "absent").lower() in ("", "true"):
            continue
        df, fields = plan.group_records(inputs, g)
        segments, used = resolved_path(g, fields, plan.variables)
        kept = sorted(f for f in fields if f not in used)
        item = "itemize" in g.group.attrs and g.group.attrs["itemize"] in fields
        record = F.to_json(F.struct(group_functions.col(g.group.attrs["itemize"]).alias("v"))) if item else F.to_json(F.struct(*[group_functions.col(f) for f in kept])) if kept else F.lit("{}")
        nested = any(df.schema[f].dataType.typeName() in ("array", "struct", "map") for f in kept)
        rows = rows.unionByName(df.select("input", F.lit(order).alias("g"), "at", F.concat_ws(SEP, *segments).alias("path"), record.alias("record"), F.lit(item).alias("item"), F.lit(nested).alias("nested")))

    def finish(who: str | None, host: str | None, parts: dict[tuple[int, str], list]) -> tuple[str | None, str]:
        about = {p: {k: (host or False) if v == "gethostname" else v for k, v in values.items()} for p, values in named.items()}
        return who, dump(build([(path, r) for (_, path), own in parts.items() for r in own], about))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees of inputs whose rows come one after another."""
        begun, who, host = False, None, None
        parts: dict[tuple[int, str], list] = {}

        def give(out: list[tuple[str | None, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["input", "result"])

        for b in batches:
            out = []
            for name, g, path, record, item, nested in zip(*(b[c].to_pylist() for c in ("input", "g", "path", "record", "item", "nested")), strict=True):
                mine = "all" if together else name
                if begun and mine != who:
                    out.append(finish(who, host, parts))
                    parts, host = {}, None
                begun, who = True, mine
                if g < 0:
                    host = host or path
                elif item:
                    parts.setdefault((g, path if path.endswith("*") else path + "*"), []).append(json.loads(record)["v"])
                else:
                    parts.setdefault((g, path), []).append(collapse(json.loads(record)) if nested else Raw(record))
            if out:
                yield give(out)
        if begun:
            yield give([finish(who, host, parts)])

    if together:
        return rows.coalesce(1).sortWithinPartitions("g", "input", "at").mapInArrow(make, "input string, result string")
    return rows.repartition("input").sortWithinPartitions("input", "g", "at").mapInArrow(make, "input string, result string")
