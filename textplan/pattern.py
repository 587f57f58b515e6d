"""Template lines to anchored regular expressions of the JVM and the variables that they capture."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

#: Built-in names and their patterns.
BUILTIN = {
    "PHRASE": r"(?:\S+ {1})+?\S+",
    "ROW": r"(?:\S+ +)+?\S+",
    "ORPHRASE": r"\S+|(?:\S+ {1})+?\S+",
    "DIGIT": r"\d+",
    "IP": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "PREFIX": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2}",
    "IPV6": r"(?:[a-fA-F0-9]{1,4}:|:){1,7}(?:[a-fA-F0-9]{1,4}|:?)",
    "PREFIXV6": r"(?:[a-fA-F0-9]{1,4}:|:){1,7}(?:[a-fA-F0-9]{1,4}|:?)/[0-9]{1,3}",
    "_line_": r".+",
    "WORD": r"\S+",
    "MAC": r"(?:[0-9a-fA-F]{2}(?::|\.|\-)){5}(?:[0-9a-fA-F]{2})|(?:[0-9a-fA-F]{4}(?::|\.|\-)){2}(?:[0-9a-fA-F]{4})",
}
INDICATORS = ("_start_", "_end_", "_line_", "_exact_", "_exact_space_")
HOLE = re.compile(r"\{\{([\s\S]+?)\}\}")


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Name:
    """An argument without quotes: a template variable if there is one, else its own text."""

    text: str


@dataclass
class Call:
    name: str
    args: list[Any] = field(default_factory=list)
    kwargs: dict[str, Any] = field(default_factory=dict)


@dataclass
class Variable:
    name: str
    calls: list[Call]
    group: int | None  # of the regular expression; None: nothing is captured

    @property
    def joins(self) -> Call | None:
        return next((c for c in self.calls if c.name == "joinmatches"), None)


@dataclass
class Pattern:
    index: int
    line: str
    regex: str
    variables: list[Variable]
    start: bool = False
    end: bool = False
    whole_line: bool = False
    blank: bool = False
    literal: str = ""  # longest fixed text, a cheap test before the expression
    parts: list[tuple[str, int]] = field(default_factory=list)  # the expression, piece by piece, and the group that a piece is (0: none)

    @property
    def groups(self) -> int:
        return max([v.group or 0 for v in self.variables], default=0)


def split_outside_quotes(text: str, sep: str) -> list[str]:
    parts, depth, quote, now = [], 0, "", ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == sep and not quote and depth <= 0:
            parts.append(now)
            now = ""
        else:
            now += c
    return [*parts, now]


def _value(node: ast.expr) -> Any:
    if isinstance(node, ast.Name):
        return {"True": True, "False": False, "None": None}.get(node.id, Name(node.id))
    if isinstance(node, ast.Attribute):
        return Name(ast.unparse(node))
    return ast.literal_eval(node)


def parse_call(text: str) -> Call:
    """`name`, or `name(arguments)` with Python literals, bare names and keywords."""
    text = text.strip()
    m = re.fullmatch(r"([\w.-]+)\s*(?:\(([\s\S]*)\))?", text)
    if not m:
        raise PatternError(f"not a function: {text}")
    if m[2] is None:
        return Call(m[1])
    try:
        call = ast.parse(f"f({_raw_strings(m[2])})", mode="eval").body
        return Call(m[1], [_value(a) for a in call.args], {k.arg: _value(k.value) for k in call.keywords})
    except (SyntaxError, ValueError):
        out = Call(m[1])
        for part in split_outside_quotes(m[2], ","):
            out.args.append(part.strip().strip("\"'"))
        return out


def _raw_strings(text: str) -> str:
    """Strings of arguments are regular expressions as often as not: backslashes stay, but for \\n and \\t."""
    return re.sub(r"\\(?![nt\"'])", r"\\\\", text)


def parse_calls(text: str) -> list[Call]:
    return [parse_call(p) for p in split_outside_quotes(text, "|") if p.strip()]


def without_groups(regex: str) -> str:
    """A user's fragment with its capturing groups made plain, so that ours keep their numbers."""
    out, in_class, i = "", False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out += regex[i : i + 2]
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        if c == "(" and not in_class:
            named = re.match(r"\(\?P?<\w+>", regex[i:])
            if named:
                out += "(?:"
                i += named.end()
                continue
            out += "(" if regex[i + 1 : i + 2] == "?" else "(?:"
        else:
            out += c
        i += 1
    return out


def _literal(text: str, exact_digits: bool, exact_space: bool) -> str:
    out = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
    if not exact_digits:
        out = re.sub(r"\d+", r"\\d+", out)
    return out if exact_space else re.sub(r"[ \t]+", r"[ \\t]+", out)


def _expand(calls: list[Call], variables: dict[str, Any]) -> list[Call]:
    """Chains are put in place when the template is compiled."""
    out = []
    for c in calls:
        if c.name == "chain" and c.args:
            name = c.args[0].text if isinstance(c.args[0], Name) else c.args[0]
            value = variables.get(name, [])
            out += _expand([x for v in (value if isinstance(value, list) else [value]) for x in parse_calls(str(v))], variables)
        else:
            out.append(c)
    return out


def fragment(call: Call, variables: dict[str, Any]) -> str:
    """The expression that `re("...")` or `ignore("...")` asks for: a template variable, a built-in name, or itself."""
    arg = call.args[0]
    text = arg.text if isinstance(arg, Name) else str(arg)
    return without_groups(str(variables[text]) if text in variables else BUILTIN.get(text, text))


def compile_line(line: str, index: int, variables: dict[str, Any]) -> Pattern:
    holes = list(HOLE.finditer(line))
    specs = []
    for h in holes:
        name, *rest = split_outside_quotes(h[1].strip(), "|")
        specs.append((name.strip(), _expand([parse_call(x) for x in rest if x.strip()], variables)))
    names = {n for n, _ in specs} | {c.name for _, cs in specs for c in cs}
    p = Pattern(index, line, "", [])
    p.start, p.end = "_start_" in names, "_end_" in names
    exact_space = "_exact_space_" in names
    exact = "_exact_" in names or exact_space
    text_left = HOLE.sub("", line).strip()
    if not text_left and specs and all(n in ("_start_", "_end_") for n, _ in specs):
        p.regex, p.blank = r"(?d)^[ \t]*$", True
        return p
    at, group = 0, 0
    for h, (name, calls) in zip(holes, specs, strict=True):
        text = line[at : h.start()]
        at = h.end()
        mark = name in INDICATORS and name != "_line_"
        sets = any(c.name == "set" for c in calls) and not any(c.name in BUILTIN or c.name == "re" for c in calls)
        if mark or sets:  # takes no text, nor the space before it
            p.parts.append((_literal(text.rstrip(" \t"), exact, exact_space), 0))
            if line[at : at + 1] in (" ", "\t") and text.endswith((" ", "\t")):
                p.parts.append((r"[ \t]+", 0))
                at += len(line[at:]) - len(line[at:].lstrip(" \t"))
            if sets:
                p.variables.append(Variable(name, calls, None))
            continue
        p.parts.append((_literal(text, exact, exact_space), 0))
        if name.startswith("ignore"):
            call = parse_call(name)
            regex = fragment(call, variables) if call.args else next((BUILTIN[c.name] for c in calls if c.name in BUILTIN), r"\S+")
            p.parts.append((f"(?:{regex})", 0))
            continue
        found = [fragment(c, variables) for c in calls if c.name == "re" and c.args] + [BUILTIN[c.name] for c in calls if c.name in BUILTIN]
        if not found and name in BUILTIN:
            found = [BUILTIN[name]]
        if not found:
            found = [".*?" if any(c.name == "default" for c in calls) else r"\S+"]
        if name == "_line_" or any(c.name == "_line_" for c in calls):
            p.whole_line = name == "_line_" and not text_left
        group += 1
        p.parts.append(("|".join(found), group))
        p.variables.append(Variable(name, [c for c in calls if c.name not in ("re", *BUILTIN) and c.name not in INDICATORS], group))
    p.parts.append((_literal(line[at:].rstrip(), exact, exact_space), 0))
    out = "".join(f"({x})" if g else x for x, g in p.parts)
    p.regex = f"(?d)^{out}" + ("$" if exact_space else r"[\t ]*$")
    pieces = re.split(r"\d+|[ \t]+", HOLE.sub("\0", line).replace("\0", "  ")) if not exact else [HOLE.sub("  ", line)]
    p.literal = max((x.strip() for x in re.split(r"\s{2,}", "  ".join(pieces))), key=len, default="")
    if wrong := what_is_wrong(p.regex):
        raise PatternError(f"line {line!r}: {wrong}")
    return p


def what_is_wrong(regex: str) -> str | None:
    """Why an expression can't be compiled: by the engine that runs it, or by Python's while no session is there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(regex)
        except IllegalArgumentException as e:
            return str(e)
        return None
    try:
        re.compile(regex.replace("(?d)", ""))
    except re.error as e:
        return str(e)
    return None


def looks_around(regex: str) -> str | None:
    """What an expression has that engines in linear time refuse: a look around, a possessive or atomic group, a reference back."""
    found = re.search(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|[*+?}]\+", regex)
    return found[0] if found else None


def dynamic_names(path: str) -> list[str]:
    """Variables in a group's name."""
    return [h[1].strip() for h in HOLE.finditer(path)]
