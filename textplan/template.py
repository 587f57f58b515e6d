"""Template text to a tree of groups, inputs, outputs, lookups, macros and variables."""

from __future__ import annotations

import ast
import configparser
import csv
import io
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

KINDS = {
    "template": "template", "v": "vars", "vars": "vars", "variables": "vars", "g": "group", "grp": "group", "group": "group",
    "i": "input", "in": "input", "input": "input", "o": "output", "out": "output", "output": "output",
    "lookup": "lookup", "macro": "macro", "doc": "doc", "extend": "extend",
}
#: Only these tags are markup: any other '<' belongs to the text.
_TAG = re.compile(rf"<(/?)({'|'.join(sorted(KINDS, key=len, reverse=True))})((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)


@dataclass
class Group:
    name: str
    attrs: dict[str, str]
    lines: list[str]
    children: list[Group]
    anonymous: bool = False


@dataclass
class Template:
    attrs: dict[str, str] = field(default_factory=dict)
    groups: list[Group] = field(default_factory=list)
    inputs: list[Node] = field(default_factory=list)
    outputs: list[Node] = field(default_factory=list)
    lookups: dict[str, Any] = field(default_factory=dict)
    macros: list[str] = field(default_factory=list)
    vars: dict[str, Any] = field(default_factory=dict)
    named_vars: dict[str, dict[str, Any]] = field(default_factory=dict)
    doc: str = ""
    warnings: list[str] = field(default_factory=list)


def _plain(text: str) -> str:
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return text


def tree(text: str) -> Node:
    """The tags of a template, under one root whether or not the text has one."""
    root = Node("template")
    stack, at = [root], 0
    while m := _TAG.search(text, at):
        stack[-1].text += text[at : m.start()]
        at = m.end()
        closing, kind, attrs, alone = m[1], KINDS[m[2]], m[3], m[4]
        if closing:
            if len(stack) == 1 or stack[-1].kind != kind:
                raise TemplateError(f"</{m[2]}> closes nothing that is open")
            stack.pop()
            continue
        node = Node(kind, {k: _plain(v[1:-1]) for k, v in _ATTR.findall(attrs)})
        stack[-1].children.append(node)
        if alone:
            continue
        if kind in ("macro", "doc"):  # nothing in them is markup
            end = re.compile(rf"</{m[2]}\s*>").search(text, at)
            if not end:
                raise TemplateError(f"<{m[2]}> is never closed")
            node.text, at = text[at : end.start()], end.end()
            continue
        stack.append(node)
    stack[-1].text += text[at:]
    if len(stack) > 1:
        raise TemplateError(f"<{stack[-1].kind}> is never closed")
    if [c.kind for c in root.children] == ["template"] and not root.text.strip():
        return root.children[0]
    return root


def _lines(text: str) -> list[str]:
    return [x.rstrip("\r\n") for x in _plain(text).split("\n") if x.strip() and not x.lstrip().startswith("##")]


def _group(node: Node) -> Group:
    return Group(node.attrs.get("name", ""), node.attrs, _lines(node.text), [_group(c) for c in node.children if c.kind == "group"], "name" not in node.attrs)


def load_text(data: str, loader: str = "python", key: str | None = None) -> Any:
    """The value of a <vars> or <lookup> text in one of the five formats."""
    loader = loader.lower()
    if loader == "python":
        try:
            return ast.literal_eval(data.strip())
        except (ValueError, SyntaxError):
            out: dict[str, Any] = {}
            for s in ast.parse(data.strip()).body:
                if not (isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name)):
                    raise TemplateError("python variables are assignments of literals") from None
                out[s.targets[0].id] = ast.literal_eval(s.value)
            return out
    if loader == "json":
        return json.loads(data)
    if loader == "yaml":
        import yaml

        return yaml.safe_load(data)
    if loader == "csv":
        rows = list(csv.DictReader(io.StringIO(data.strip())))
        if not rows:
            return {}
        key = key or next(iter(rows[0]))
        return {r[key]: r for r in rows}
    if loader == "ini":
        c = configparser.ConfigParser()
        c.optionxform = str
        c.read_string(data)
        return {s: dict(c[s]) for s in c.sections()}
    raise TemplateError(f"no such loader: {loader}")


def _read(path: str, base: Path | None) -> str:
    return (Path(path) if base is None or Path(path).is_absolute() else base / path).read_text()


def _extend(into: Template, node: Node, base: Path | None, seen: tuple[str, ...]) -> None:
    path = node.attrs.get("template", "")
    if path in seen:
        raise TemplateError(f"{path} extends itself")
    other = parse(_read(path, base), base, (*seen, path))
    chosen = lambda kind: [x.strip() for x in node.attrs[kind].split(",")] if kind in node.attrs else None
    names = chosen("groups")
    into.groups += [g for i, g in enumerate(other.groups) if names is None or g.name in names or str(i) in names]
    for kind in ("inputs", "outputs"):
        names = chosen(kind)
        getattr(into, kind).extend(n for i, n in enumerate(getattr(other, kind)) if names is None or n.attrs.get("name") in names or str(i) in names)
    for kind in ("lookups", "vars"):
        names = chosen(kind)
        for k, v in getattr(other, kind).items():
            if names is None or k in names:
                getattr(into, kind).setdefault(k, v)
    into.macros += other.macros


def _fill(t: Template, node: Node, base: Path | None, seen: tuple[str, ...]) -> None:
    for c in node.children:
        if c.kind == "group":
            t.groups.append(_group(c))
        elif c.kind == "input":
            t.inputs.append(c)
        elif c.kind == "output":
            t.outputs.append(c)
        elif c.kind == "macro":
            t.macros.append(c.text)
        elif c.kind == "doc":
            t.doc += c.text
        elif c.kind == "lookup":
            data = _read(c.attrs["include"], base) if "include" in c.attrs else c.text
            t.lookups[c.attrs.get("name", "")] = load_text(data, c.attrs.get("load", "python"), c.attrs.get("key"))
        elif c.kind == "vars":
            data = _read(c.attrs["include"], base) if "include" in c.attrs else c.text
            values = load_text(data, c.attrs.get("load", "python"), c.attrs.get("key")) if data.strip() else {}
            if "name" in c.attrs:
                t.named_vars.setdefault(c.attrs["name"], {}).update(values)
            else:
                t.vars |= values
        elif c.kind == "extend":
            _extend(t, c, base, seen)
        elif c.kind == "template":
            _fill(t, c, base, seen)
    if lines := _lines(node.text):
        t.groups.insert(0, Group("", {}, lines, [], True))


def parse(text: str, base: str | Path | None = None, seen: tuple[str, ...] = ()) -> Template:
    """Compile template text to its tree. `base`: folder of included files."""
    node = tree(text)
    t = Template(attrs=dict(node.attrs))
    _fill(t, node, Path(base) if base else None, seen)
    if not t.groups:
        t.warnings.append("the template has no group and no text")
    return t


#: What inputs, outputs and lookups may name.
INPUT_LOADS = ("text", "yaml", "json", "csv", "file", "directory", "url", "database")
LOOKUP_LOADS = ("python", "yaml", "json", "csv", "ini")
FORMATS = ("raw", "json", "yaml", "table", "csv", "pprint", "tabulate", "excel", "jinja2", "n2g")
RETURNERS = ("self", "terminal", "file", "syslog")


def siblings(text: str) -> list[str]:
    """The texts of several <template> tags side by side, each with attributes of its own; else the text itself."""
    root = tree(text)
    if len(root.children) < 2 or any(c.kind != "template" for c in root.children) or root.text.strip():
        return [text]
    out, depth, begin = [], 0, 0
    for m in _TAG.finditer(text):
        if KINDS[m[2]] == "template" and not m[4]:
            begin = m.start() if not m[1] and depth == 0 else begin
            depth += -1 if m[1] else 1
            if depth == 0:
                out.append(text[begin : m.end()])
    return out


def check_template(t: Template, functions: tuple[str, ...] | None = None) -> list[str]:
    """What is wrong with a parsed template: kinds that don't exist, calls whose parentheses don't pair up, macros that are no Python, and, given the group functions there are, others."""
    found: list[str] = []

    def group(g: Group) -> None:
        for key in ("functions", "chain"):
            for call in (x.strip() for x in g.attrs.get(key, "").split("|")):
                if call.count("(") != call.count(")"):
                    found.append(f"group {g.name!r}: parentheses of {call!r} do not pair up")
                elif functions is not None and call and call.split("(")[0] not in functions:
                    found.append(f"group {g.name!r}: no such function: {call.split('(')[0]}")
        for c in g.children:
            group(c)

    for g in t.groups:
        group(g)
    for kind, nodes, attribute, known in (("input", t.inputs, "load", INPUT_LOADS), ("output", t.outputs, "format", FORMATS), ("output", t.outputs, "returner", RETURNERS)):
        found += [f"{kind}: no such {attribute}: {n.attrs[attribute]}" for n in nodes if n.attrs.get(attribute, known[0]) not in known]
    for m in t.macros:
        try:
            ast.parse(m)
        except SyntaxError as e:
            found.append(f"macro: {e}")
    return found


def validate(text: str) -> list[str]:
    """What is wrong with a template's text; empty if nothing is."""
    try:
        t = parse(text)
    except (TemplateError, SyntaxError, ValueError, KeyError, OSError) as e:
        return [str(e)]
    found = ["{{ and }} do not pair up"] if text.count("{{") != text.count("}}") else []
    return found + check_template(t) + t.warnings
