"""Where each variable was captured: spans of the line for each match.

The expression of a line is taken piece by piece, fixed text too, so that the
pieces of a match make up the line; a variable starts where the pieces before
it end. All of that is one expression of the engine's own kind a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..pattern import Pattern

_SPANS = "map<string, struct<start: int, stop: int>>"


def _spans(p: Pattern) -> Column:
    """A map from variables (the last of one name) to their first and last place in the line."""
    parts = [(x, g) for x, g in p.parts if x]
    piece = {g: i for i, (_, g) in enumerate(parts) if g}
    places = {v.name: piece[v.group] for v in p.variables if v.group}
    if not places:
        return F.expr(f"cast(map() as {_SPANS})")
    regex = "(?d)^" + "".join(f"({x})" for x, _ in parts) + (r"[\t ]*$" if p.regex.endswith(r"[\t ]*$") else "$")
    pieces = F.split(F.regexp_replace("line", regex, "\x01".join(f"${i + 1}" for i in range(len(parts)))), "\x01", -1)

    def spans(found: Column) -> Column:
        entries: list[Column] = []
        for name, i in places.items():
            start = F.length(F.array_join(F.slice(found, 1, i), "")) if i else F.lit(0)
            entries += [F.lit(name), F.struct(start.alias("start"), (start + F.length(F.get(found, F.lit(i)))).alias("stop"))]
        return F.create_map(*entries)

    return F.get(F.transform(F.array(pieces), spans), 0).cast(_SPANS)


def lineage(plan, inputs: DataFrame) -> DataFrame:
    """(input, line_no, line, group, pattern, matched, spans): a row for each line and pattern that fits it, or one without."""
    found: dict[str, list[Column]] = {}  # by the inputs that groups read
    lines: dict[str, DataFrame] = {}
    apart = any("groups" in n.attrs for n in plan.template.inputs)
    for i, g in enumerate(plan.groups):
        reads = str(i) if apart else g.group.attrs.get("input", "")
        if reads not in lines:
            lines[reads] = plan._prepared(inputs, g)
        todo = [(g, g.name or "_anonymous_")]
        while todo:
            h, path = todo.pop(0)
            todo += [(c, f"{path}.{c.name}") for c in h.children]
            for p in h.patterns:
                row = F.struct(F.lit(path).alias("group"), F.lit(p.index).alias("pattern"), _spans(p).alias("spans"))
                found.setdefault(reads, []).append(F.when(F.col("line").rlike(p.regex), row))
    out: DataFrame | None = None
    for reads, rows in found.items():
        m = F.explode_outer(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("m")
        part = lines[reads].select("input", "line_no", "line", m).select("input", "line_no", "line", "m.group", "m.pattern", F.col("m").isNotNull().alias("matched"), "m.spans")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out
