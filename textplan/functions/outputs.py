"""Functions of results and formats.

Structural functions and tables work on DataFrames. Formats that give one text
are for results of a size to be read: they run on the driver over what the
caller collected.
"""

from __future__ import annotations

import csv
import io
import json
import math
import pprint as pretty
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import FunctionError


def traverse(data: Any, path: str, strict: bool = False) -> Any:
    """Walk a dotted path; a list on the way is walked item by item."""
    for i, part in enumerate(parts := [p for p in path.split(".") if p]):
        if isinstance(data, list):
            return [traverse(x, ".".join(parts[i:]), strict) for x in data]
        if not isinstance(data, dict) or part not in data:
            if strict:
                raise FunctionError(f"no {part} on the path {path}")
            return {}
        data = data[part]
    return data


def traverse_column(c: Column, path: str) -> Column:
    """The same over a struct column."""
    for part in path.split("."):
        c = c[part]
    return c


def dict_to_list(data: Any, key_name: str = "key", path: str = "") -> Any:
    """Maps under a path become lists of their values, in order of key, each with its key."""
    if path:
        head, _, rest = path.partition(".")
        if isinstance(data, list):
            return [dict_to_list(x, key_name, path) for x in data]
        if isinstance(data, dict) and head in data:
            return {**data, head: dict_to_list(data[head], key_name, rest)}
        return data
    if isinstance(data, list):
        return [dict_to_list(x, key_name) for x in data]
    if isinstance(data, dict) and all(isinstance(v, dict) for v in data.values()):
        return [{key_name: k, **data[k]} for k in sorted(data)]
    return data


def entries_to_list(c: Column, key_name: str = "key") -> Column:
    """A map column as an array of structs in order of key."""
    return F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(e["key"].alias(key_name), e["value"].alias("value")))


def is_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often."""
    return set(a.columns) == set(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def table_rows(data: Any, path: str = "", headers: list[str] | None = None, missing: str = "", key: str = "") -> list[list[Any]]:
    """A list of lists: the header row (all keys, sorted, unless given) and a row for each record."""
    data = traverse(data, path) if path else data
    rows: list[dict] = []

    def gather(x: Any) -> None:
        if isinstance(x, list):
            for y in x:
                gather(y)
        elif isinstance(x, dict):
            if key and all(isinstance(v, dict) for v in x.values()):
                rows.extend({key: k, **v} for k, v in sorted(x.items()))
            elif x:
                rows.append(x)

    gather(data)
    names = headers or sorted({k for r in rows for k in r})
    return [names, *([r.get(n, missing) for n in names] for r in rows)]


def table(df: DataFrame, headers: list[str] | None = None, missing: str = "") -> DataFrame:
    """The same as a frame of strings, distributed."""
    names = headers or sorted(df.columns)
    return df.select(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(missing)).alias(n) if n in df.columns else F.lit(missing).alias(n) for n in names])


def to_json(data: Any) -> str:
    return json.dumps(data, indent=4, sort_keys=True)


def to_yaml(data: Any) -> str:
    import yaml

    return yaml.safe_dump(data, default_flow_style=False)


def to_csv(data: Any, sep: str = ",", quote: str = '"', **options: Any) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=sep, quotechar=quote, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(table_rows(data, **options))
    return out.getvalue().rstrip("\n")


def tabulate(data: Any, **options: Any) -> str:
    rows = [[str(x) for x in r] for r in table_rows(data, **options)]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


#: The parts of a workbook of one sheet.
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORKBOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def excel(data: Any, path: str = "output.xlsx", **options: Any) -> str:
    """A workbook of one sheet of texts, written to a file; the file's path."""
    import zipfile
    from xml.sax.saxutils import escape

    cells = lambda row: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>' for x in row)
    rows = "".join(f"<row>{cells(row)}</row>" for row in table_rows(data, **options))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in {**_WORKBOOK, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{rows}</sheetData></worksheet>'}.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + part)
    return path


def jinja2(data: Any, template: str = "") -> str:
    try:
        import jinja2 as engine
    except ImportError as e:
        raise FunctionError("format jinja2 needs jinja2") from e
    return engine.Template(template).render(data=data)


def graph(data: Any, source: str = "source", target: str = "target") -> tuple[list[dict], list[dict]]:
    """Nodes and links of records that name two ends."""
    head, *rows = table_rows(data)
    records = [dict(zip(head, r, strict=True)) for r in rows]
    links = [r for r in records if r.get(source) not in (None, "") and r.get(target) not in (None, "")]
    nodes = sorted({str(r[e]) for r in links for e in (source, target)})
    return [{"id": n} for n in nodes], [{"source": str(r[source]), "target": str(r[target])} for r in links]


def graph_frames(df: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The same as frames, distributed."""
    links = df.select(F.col(f"`{source}`").alias("source"), F.col(f"`{target}`").alias("target")).where("source is not null and target is not null")
    return links.select(F.explode(F.array("source", "target")).alias("id")).distinct(), links


def layout(nodes: list[dict], links: list[dict], algo: str = "grid") -> dict[str, tuple[int, int]]:
    """A place for each node. grid: row by row; circle: around a point; layers: by distance from the nodes that nothing leads to."""
    ids = [n["id"] for n in nodes]
    if algo == "circle":
        radius = max(100, 30 * len(ids))
        turn = 2 * math.pi / max(len(ids), 1)
        return {n: (round(radius + radius * math.cos(i * turn)), round(radius + radius * math.sin(i * turn))) for i, n in enumerate(ids)}
    if algo == "layers":
        level = dict.fromkeys(set(ids) - {e["target"] for e in links} or ids[:1], 0)
        now = sorted(level)
        while now:
            now = sorted({e["target"] for e in links if e["source"] in now} - level.keys())
            level |= dict.fromkeys(now, max(level.values()) + 1)
        level = {n: level.get(n, 0) for n in ids}
        seen: dict[int, int] = {}
        out = {}
        for n in ids:
            seen[level[n]] = seen.get(level[n], -1) + 1
            out[n] = (150 * seen[level[n]], 120 * level[n])
        return out
    if algo != "grid":
        raise FunctionError(f"no such layout: {algo}")
    side = max(1, math.ceil(math.sqrt(len(ids))))
    return {n: (150 * (i % side), 120 * (i // side)) for i, n in enumerate(ids)}


def n2g(data: Any, source: str = "source", target: str = "target", module: str = "yed", algo: str = "") -> str:
    """A drawing of those nodes and links: GraphML, or for module drawio a diagram, with places for the nodes if `algo` asks for a layout."""
    from xml.sax.saxutils import quoteattr

    nodes, links = graph(data, source, target)
    at = layout(nodes, links, algo) if algo else {}
    if module.lower() in ("drawio", "draw.io"):
        at = at or layout(nodes, links)
        cells = ['<mxCell id="0"/>', '<mxCell id="1" parent="0"/>']
        cells += [f'<mxCell id={quoteattr("n:" + n["id"])} value={quoteattr(n["id"])} style="rounded=1;whiteSpace=wrap;" vertex="1" parent="1"><mxGeometry x="{at[n["id"]][0]}" y="{at[n["id"]][1]}" width="120" height="60" as="geometry"/></mxCell>' for n in nodes]
        cells += [f'<mxCell id="e:{i}" edge="1" parent="1" source={quoteattr("n:" + e["source"])} target={quoteattr("n:" + e["target"])}><mxGeometry relative="1" as="geometry"/></mxCell>' for i, e in enumerate(links)]
        return "\n".join(['<mxfile><diagram name="Page-1"><mxGraphModel><root>', *cells, "</root></mxGraphModel></diagram></mxfile>"])
    if module.lower() != "yed":
        raise FunctionError(f"no such module: {module}")
    keys = ['  <key id="x" for="node" attr.name="x" attr.type="int"/>', '  <key id="y" for="node" attr.name="y" attr.type="int"/>'] if at else []
    place = lambda n: f'<data key="x">{at[n][0]}</data><data key="y">{at[n][1]}</data>'
    body = [f"    <node id={quoteattr(n['id'])}>{place(n['id'])}</node>" if at else f"    <node id={quoteattr(n['id'])}/>" for n in nodes] + [f"    <edge source={quoteattr(e['source'])} target={quoteattr(e['target'])}/>" for e in links]
    return "\n".join(['<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '  <graph edgedefault="undirected">', *body, "  </graph>", "</graphml>"])


FORMATS = {
    "raw": lambda d, **k: d, "json": lambda d, **k: to_json(d), "yaml": lambda d, **k: to_yaml(d), "pprint": lambda d, **k: pretty.pformat(d, sort_dicts=True),
    "csv": to_csv, "table": table_rows, "tabulate": tabulate, "excel": excel, "jinja2": jinja2, "n2g": n2g,
}
STRUCTURAL = {"traverse": traverse, "dict_to_list": dict_to_list}
#: Formats of the whole list of results; the others are made for each input.
WHOLE = ("json", "yaml", "pprint", "raw")


def apply_outputs(plan, data: list[Any]) -> Any:
    """All outputs of a template in order: functions first, then the format."""
    from ..pattern import parse_calls

    for node in plan.template.outputs:
        for call in parse_calls(node.attrs.get("functions", "")):
            f = plan.functions["output"].get(call.name) or STRUCTURAL.get(call.name)
            if f is None:
                raise FunctionError(f"no such output function: {call.name}")
            data = [f(x, *call.args, **call.kwargs) for x in data]
        kind = node.attrs.get("format", "raw")
        if kind not in FORMATS:
            raise FunctionError(f"no such format: {kind}")
        options: dict[str, Any] = {k: node.attrs[k] for k in ("path", "missing", "key", "sep", "quote", "source", "target", "module", "algo", "template") if k in node.attrs and k != "path" or k == "path" and kind in ("csv", "table", "tabulate") and "path" in node.attrs}
        if "headers" in node.attrs:
            options["headers"] = [h.strip() for h in node.attrs["headers"].split(",")]
        data = FORMATS[kind](data, **options) if kind in WHOLE else [FORMATS[kind](x, **options) for x in data]
        if node.attrs.get("returner") == "terminal":
            print(data)
    return data
