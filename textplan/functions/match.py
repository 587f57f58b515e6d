"""Functions of match variables, each a rewrite of a Column; conditions are boolean Columns that filter the match.

A function takes a Value, the call's arguments (template variables already in
place) and its keywords. It returns a Value, or a Condition. Values that a
function can't convert become null (typed mode).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..pattern import without_groups


@dataclass
class Value:
    col: Column
    kind: str = "string"  # string, bigint, double, boolean, array, struct
    adds: dict[str, Column] = field(default_factory=dict)  # further fields of the record
    records: dict[str, Column] = field(default_factory=dict)  # recorded for later matches

    def to(self, col: Column, kind: str | None = None) -> Value:
        return Value(col, kind or self.kind, self.adds, self.records)

    @property
    def text(self) -> Column:
        return self.col if self.kind == "string" else F.array_join(self.col, " ") if self.kind == "array" else self.col.cast("string")


@dataclass
class Condition:
    col: Column


class FunctionError(ValueError):
    pass


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def regex(text: Any) -> str:
    return "(?d)" + without_groups(str(text))


def lit(x: Any) -> Column:
    if isinstance(x, Column):
        return x
    return F.array(*map(lit, x)) if isinstance(x, (list, tuple)) else F.lit(x)


def kind_of(x: Any) -> str:
    return {bool: "boolean", int: "bigint", float: "double", list: "array", tuple: "array"}.get(type(x), "string")


def glob(pattern: Column) -> Column:
    """A glob as an expression: * and ? stop at a slash."""
    c = F.regexp_replace(pattern, r"([\\.^$|+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(c, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"({_OCTET}\.){{3}}{_OCTET}"
IPV6 = r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|::1|::"


def ipv4_number(c: Column) -> Column:
    return F.aggregate(F.split(c, "[.]"), F.lit(0).cast("bigint"), lambda a, x: a * 256 + F.coalesce(x.try_cast("bigint"), F.lit(0)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r\x85\u00a0\u2028\u2029"))


# Conditions -------------------------------------------------------------


def _any(make: Callable[[Column, Any], Column], each: bool = True) -> Callable:
    def f(v: Value, args, kwargs) -> Condition:
        found = [make(v.text, a) for a in (args if each else args[:1])]
        out = found[0] if found else F.lit(True)
        for x in found[1:]:
            out = out | x
        return Condition(out)

    return f


def _not(make: Callable[[Column, Any], Column]) -> Callable:
    return lambda v, args, kwargs: Condition(~make(v.text, args[0]) if args else F.lit(True))


_starts = lambda c, a: c.startswith(lit(a).cast("string"))
_ends = lambda c, a: c.endswith(lit(a).cast("string"))
_has = lambda c, a: c.contains(lit(a).cast("string"))
_has_re = lambda c, a: c.rlike(regex(a))
_starts_re = lambda c, a: c.rlike("(?d)^" + without_groups(str(a)))
_ends_re = lambda c, a: c.rlike("(?d)" + without_groups(str(a)) + r"\z")
_digits = lambda c, a=None: strip(c).rlike("^[0-9]+$")


def _compare(op: str) -> Callable:
    def f(v: Value, args, kwargs) -> Condition:
        a, b = v.text.try_cast("double"), lit(args[0]).try_cast("double")
        return Condition(F.coalesce(a > b if op == ">" else a < b, F.lit(False)))

    return f


def is_ip(c: Column) -> Column:
    return strip(c).rlike(f"^({IPV4}|{IPV6})$")


def _cidr_match(v: Value, args, kwargs) -> Condition:
    net, _, bits = str(args[0]).partition("/")
    if not re.fullmatch(IPV4, net) or not bits.isdigit() or int(bits) > 32:
        return Condition(F.lit(False))
    number = 0
    for octet in net.split("."):
        number = number * 256 + int(octet)
    shift = 32 - int(bits)
    c = F.regexp_replace(v.text, "/.*$", "")
    return Condition(c.rlike(f"^{IPV4}$") & (F.shiftright(ipv4_number(c), shift) == F.lit(number >> shift)))


CONDITIONS: dict[str, Callable] = {
    "contains": _any(_has),
    "contains_re": _any(_has_re, each=False),
    "startswith": _any(_starts),
    "startswith_re": _any(_starts_re, each=False),
    "endswith": _any(_ends),
    "endswith_re": _any(_ends_re, each=False),
    "notstartswith": _not(_starts),
    "notstartswith_re": _not(_starts_re),
    "notendswith": _not(_ends),
    "notendswith_re": _not(_ends_re),
    "exclude": _not(_has),
    "exclude_re": _not(_has_re),
    "equal": lambda v, a, k: Condition(v.text == lit(a[0]).cast("string")),
    "notequal": lambda v, a, k: Condition(v.text != lit(a[0]).cast("string")),
    "isdigit": lambda v, a, k: Condition(_digits(v.text)),
    "notdigit": lambda v, a, k: Condition(~_digits(v.text)),
    "greaterthan": _compare(">"),
    "lessthan": _compare("<"),
    "is_ip": lambda v, a, k: Condition(is_ip(v.text)),
    "cidr_match": _cidr_match,
}


# Values -----------------------------------------------------------------


def _split(v, a, k):
    return v.to(F.transform(F.split(v.text, quote(str(a[0] if a else ",")), -1), strip), "array")


def _join(v, a, k):
    return v.to(F.array_join(v.col, str(a[0] if a else ",")), "string") if v.kind == "array" else v


def _mac_eui(v, a, k):
    bare = F.lower(F.translate(v.text, ".:-", ""))
    mac = F.regexp_replace(F.rpad(bare, 12, "0"), "(..)(?=.)", "$1:")
    return v.to(F.when(bare.rlike("^[0-9a-z]{1,12}$"), mac).otherwise(v.text), "string")


def _count(v, a, k):
    n = F.size(v.col) if v.kind == "array" else F.octet_length(v.col) if v.kind == "string" else F.lit(1)
    return v.to(n.cast("bigint"), "bigint")


def _to(v, a, k):
    kind = str(a[0]) if a else "str"
    if kind == "bool":
        c = v.text
        return v.to(F.when(c.isin("1", "t", "T", "TRUE", "true", "True"), True).when(c.isin("0", "f", "F", "FALSE", "false", "False"), False), "boolean")
    known = {"int": ("bigint", "bigint"), "float": ("double", "double"), "str": ("string", "string")}
    if kind not in known:
        return v
    return v.to(v.text if kind == "str" else strip(v.text).try_cast(known[kind][0]), known[kind][1])


def _to_int(v, a, k):
    return v.to(strip(v.text).try_cast("bigint"), "bigint")


def _to_net(v, a, k):
    c = v.text
    return v.to(F.when(c.rlike(f"^{IPV4}$"), F.concat(c, F.lit("/32"))).otherwise(c), "string")


def _to_cidr(v, a, k):
    c = v.text
    bits = F.aggregate(F.split(c, "[.]"), F.lit(0), lambda n, x: n + F.bit_count(F.coalesce(x.try_cast("int"), F.lit(0))))
    return v.to(F.when(c.contains("/"), F.element_at(F.split(c, "/"), -1).try_cast("bigint")).when(c.rlike(f"^{IPV4}$"), bits.cast("bigint")), "bigint")


def _item(v, a, k):
    i = int(a[0])
    n = F.size(v.col) if v.kind == "array" else F.length(v.text)
    at = F.greatest(F.least(F.lit(i) if i >= 0 else n + i, n - 1), F.lit(0))
    return v.to(F.get(v.col, at), "string") if v.kind == "array" else v.to(v.text.substr(at + 1, F.lit(1)), "string")


def typed(x: Any) -> Any:
    """A literal of `let`: True, numbers and text."""
    if not isinstance(x, str):
        return x
    if x in ("True", "False"):
        return x == "True"
    for t in (int, float):
        try:
            return t(x)
        except ValueError:
            continue
    return x


def _let(v, a, k):
    if len(a) == 1:
        return v.to(lit(a[0]), kind_of(a[0]))
    x = typed(a[1])
    return Value(v.col, v.kind, v.adds | {str(a[0]): lit(x)}, v.records)


def first_replaced(c: Column, pattern: str, new: str) -> Column:
    found = F.regexp_substr(c, F.lit(pattern))
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(found.isNull(), c).otherwise(F.concat(c.substr(F.lit(1), at - 1), F.lit(new), c.substr(at + F.length(found), F.length(c))))


def _java_replacement(new: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", new)


def _resub(v, a, k):
    old, new = regex_with_groups(a[0] if a else k["old"]), str(a[1] if len(a) > 1 else k.get("new", ""))
    n = int(k.get("count", a[2] if len(a) > 2 else 1))
    c = v.text
    if n <= 0:
        return v.to(F.regexp_replace(c, old, _java_replacement(new)), "string")
    if n == 1:
        return v.to(first_replaced(c, old, new), "string")
    # The first n matches, cut out one after another; the text behind the last stays.
    done, rest = F.lit(""), c
    for _ in range(n):
        found, at = F.regexp_substr(rest, F.lit(old)), F.regexp_instr(rest, F.lit(old))
        head = F.when(found.isNull(), F.lit("")).otherwise(F.concat(rest.substr(F.lit(1), at - 1), F.regexp_replace(found, old, _java_replacement(new))))
        rest = F.when(found.isNull(), rest).otherwise(rest.substr(at + F.length(found), F.length(rest)))
        done = F.concat(done, head)
    return v.to(F.concat(done, rest), "string")


def regex_with_groups(x: Any) -> str:
    return "(?d)" + str(x)


def _pairs(a: list) -> list[tuple[str, str]]:
    """(old, new) of `replaceall(new, old...)`, where an old may be a list, or a dict of new to old."""
    if len(a) == 1:
        olds, new = a, ""
    else:
        new, olds = a[0], a[1:]
    out: list[tuple[str, str]] = []
    for old in olds:
        if isinstance(old, dict):
            for n, o in sorted(old.items()):
                out += [(str(x), str(n)) for x in (o if isinstance(o, list) else [o])]
        else:
            out += [(str(x), str(new)) for x in (old if isinstance(old, list) else [old])]
    return out


def _replaceall(v, a, k):
    c = v.text
    for old, new in _pairs(a):
        c = F.replace(c, F.lit(old), F.lit(new))
    return v.to(c, "string")


def _resuball(v, a, k):
    c = v.text
    for old, new in _pairs(a):
        c = F.regexp_replace(c, regex_with_groups(old), _java_replacement(new))
    return v.to(c, "string")


def _prepend(v, a, k):
    return v.to(F.array_prepend(v.col, lit(a[0]).cast("string"))) if v.kind == "array" else v.to(F.concat(lit(a[0]).cast("string"), v.text), "string")


def _append(v, a, k):
    return v.to(F.array_append(v.col, lit(a[0]).cast("string"))) if v.kind == "array" else v.to(F.concat(v.text, lit(a[0]).cast("string")), "string")


def _default(v, a, k):
    x = a[0] if a else ""
    if v.kind == "string":
        return v.to(F.when(v.col.isNull() | (strip(v.col) == ""), lit(x).cast("string")).otherwise(v.col))
    return v.to(F.coalesce(v.col, lit(x)))


#: Numbers that one span of unrange() may become.
MOST_NUMBERS = 100_000


def _unrange(v, a, k):
    """Spans of numbers written out; one of more than MOST_NUMBERS numbers stays as it is."""
    by, glue = str(k.get("rangechar", a[0] if a else "-")), str(k.get("joinchar", a[1] if len(a) > 1 else ","))
    span = rf"^\s*[0-9]+\s*{quote(by)}\s*[0-9]+\s*$"

    def one(x: Column) -> Column:
        ends = F.split(x, quote(by))
        lo, hi = strip(ends[0]).try_cast("bigint"), strip(ends[1]).try_cast("bigint")
        return F.when(~x.rlike(span) | F.coalesce(hi - lo >= MOST_NUMBERS, F.lit(True)), F.array(x)).when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: n.cast("string"))).otherwise(F.array().cast("array<string>"))

    return v.to(F.array_join(F.flatten(F.transform(F.split(v.text, quote(glue)), one)), glue), "string")


#: Units of a time span, their patterns and seconds.
UPTIME = [
    ("years", r"(?i)(\d+)\s*(?:ys?|yrs?.?|years?)", 60 * 60 * 24 * 365),
    ("months", r"(?i)(\d+)\s*(?:mos?.?|mths?.?|months?)", 60 * 60 * 24 * 30),
    ("weeks", r"(?i)([\d.]+)\s*(?:w|wks?|weeks?)", 60 * 60 * 24 * 7),
    ("days", r"(?i)([\d.]+)\s*(?:d|dys?|days?)", 60 * 60 * 24),
    ("hours", r"(?i)([\d.]+)\s*(?:h|hrs?|hours?)", 60 * 60),
    ("mins", r"(?i)([\d.]+)\s*(?:m(?!o|th)|mins?|minutes?)", 60),
    ("secs", r"(?i)([\d.]+)\s*(?:s|secs?|seconds?)", 1),
]


def _uptimeparse(v, a, k):
    part = {name: F.nullif(F.regexp_extract(v.text, pattern, 1), F.lit("")) for name, pattern, _ in UPTIME}
    if str(k.get("format", a[0] if a else "seconds")) == "dict":
        return v.to(F.struct(*[c.alias(n) for n, c in part.items()]), "struct")
    total = F.lit(0.0)
    for name, _, seconds in UPTIME:
        total = total + F.coalesce(part[name].try_cast("double"), F.lit(0.0)) * seconds
    return v.to(total.cast("bigint"), "bigint")


def _truncate(v, a, k):
    """The first n bytes of the text; a character that the cut goes through is left out."""
    n = int(a[0]) if a else 0
    if n <= 0:
        return v
    cut = F.substring(v.text.cast("binary"), 1, n)
    whole = F.rtrim(F.make_valid_utf8(cut.cast("string")), F.lit("\ufffd"))
    return v.to(F.when(F.octet_length(v.text) <= n, v.text).when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise(whole), "string")


IP_FACTS = "ip string, compressed string, exploded string, version int, max_prefixlen int, is_private boolean, is_loopback boolean, is_multicast boolean, is_link_local boolean, is_reserved boolean, is_unspecified boolean"


def _ip_info_v6() -> Callable:
    @F.pandas_udf(IP_FACTS)
    def look(s: pd.Series) -> pd.DataFrame:
        import ipaddress

        names = [f.split()[0] for f in IP_FACTS.split(", ")]

        def one(x):
            try:
                ip = None if x is None else ipaddress.ip_interface(x).ip
            except ValueError:
                ip = None
            if ip is None or ip.version != 6:
                return [None] * len(names)
            return [str(ip), *(getattr(ip, n) for n in names[1:])]

        return pd.DataFrame([one(x) for x in s], columns=names, dtype=object)

    return look


def _ip_info(v, a, k):
    """Facts of an IPv4 or IPv6 address (with or without a prefix length); null for other text.

    IPv4 is computed by Columns; a Python worker gives the facts of IPv6 as Python's ipaddress has them, fully exploded.
    """
    c = F.regexp_replace(strip(v.text), r"""^["']|["']$""", "")
    ip = F.regexp_replace(c, "/.*$", "")
    n = ipv4_number(ip)

    def within(net: str, bits: int) -> Column:
        number = 0
        for octet in net.split("."):
            number = number * 256 + int(octet)
        return F.shiftright(n, 32 - bits) == F.lit(number >> (32 - bits))

    facts = F.struct(
        ip.alias("ip"), ip.alias("compressed"), ip.alias("exploded"), F.lit(4).alias("version"), F.lit(32).alias("max_prefixlen"),
        (within("10.0.0.0", 8) | within("172.16.0.0", 12) | within("192.168.0.0", 16)).alias("is_private"),
        within("127.0.0.0", 8).alias("is_loopback"), within("224.0.0.0", 4).alias("is_multicast"), within("169.254.0.0", 16).alias("is_link_local"),
        within("240.0.0.0", 4).alias("is_reserved"), (n == 0).alias("is_unspecified"),
    )
    v6 = _ip_info_v6()(F.when(c.contains(":"), c))
    return v.to(F.when(c.rlike(f"^{IPV4}(/[0-9]{{1,2}})?$"), facts).when(c.contains(":") & v6["ip"].isNotNull(), v6), "struct")


def _geoip(v, a, k):
    """The shape of a result; no database is at hand, so its fields are empty."""
    empty = F.struct(*[F.lit("").alias(n) for n in ("country", "city", "asn", "organisation")])
    return v.to(empty, "struct") if not a else Value(v.col, v.kind, v.adds | {str(a[0]): empty}, v.records)


def _dns(reverse: bool) -> Callable:
    def f(v, a, k):
        @F.pandas_udf("string")
        def look(s: pd.Series) -> pd.Series:
            import socket

            known: dict[str, str] = {}

            def one(x):
                if x is None:
                    return None
                if x not in known:
                    try:
                        known[x] = socket.gethostbyaddr(x)[0] if reverse else socket.gethostbyname(x)
                    except OSError:
                        known[x] = x
                return known[x]

            return s.map(one)

        return v.to(look(v.text), "string")

    return f


def _record(v, a, k):
    return Value(v.col, v.kind, v.adds, v.records | {str(a[1] if len(a) > 1 else a[0]): v.text})


def _raise(v, a, k):
    return v.to(F.raise_error(F.lit(str(a[0]) if a else "raised by the template")).cast("string"), "string")


def _same(v, a, k):
    return v


FUNCTIONS: dict[str, Callable] = {
    "upper": lambda v, a, k: v.to(F.upper(v.text), "string"),
    "lower": lambda v, a, k: v.to(F.lower(v.text), "string"),
    "strip": lambda v, a, k: v.to(strip(v.text), "string"),
    "split": _split,
    "join": _join,
    "replace": lambda v, a, k: v.to(F.replace(v.text, F.lit(str(a[0])), F.lit(str(a[1]) if len(a) > 1 else "")), "string"),
    "IP": lambda v, a, k: v.to(strip(v.text), "string"),
    "mac_eui": _mac_eui,
    "count": _count,
    "record": _record,
    "to": _to,
    "to_list": lambda v, a, k: v.to(F.array(v.col), "array"),
    "to_str": lambda v, a, k: v.to(v.text, "string"),
    "to_int": _to_int,
    "to_float": lambda v, a, k: v.to(strip(v.text).try_cast("double"), "double"),
    "to_ip": lambda v, a, k: v.to(strip(v.text), "string"),
    "to_net": _to_net,
    "to_cidr": _to_cidr,
    "to_unicode": _same,
    "item": _item,
    "let": _let,
    "void": lambda v, a, k: v.to(F.lit(None).cast("string"), "string"),
    "joinmatches": _same,
    "sformat": lambda v, a, k: v.to(F.replace(F.lit(str(a[0])), F.lit("{}"), v.text), "string"),
    "resub": _resub,
    "replaceall": _replaceall,
    "resuball": _resuball,
    "prepend": _prepend,
    "append": _append,
    "copy": _same,
    "raise": _raise,
    "default": _default,
    "unrange": _unrange,
    "uptimeparse": _uptimeparse,
    "truncate": _truncate,
    "print": _same,
    "dns": _dns(False),
    "rdns": _dns(True),
    "ip_info": _ip_info,
    "geoip_lookup": _geoip,
}
#: Functions that the plan puts in place itself.
PLANNED = ("set", "lookup", "rlookup", "gpvlookup", "macro", "chain")


# Lookups in a table that is part of the plan -----------------------------


def rows_of(table: dict[str, Any]) -> list[tuple[str, Any]]:
    return sorted(((str(k), v) for k, v in table.items()), key=lambda kv: kv[0])


def _fields(table: dict[str, Any]) -> list[str]:
    return sorted({str(f) for r in table.values() if isinstance(r, dict) for f in r})


def _literal_map(table: dict[str, Any], fields: list[str]) -> Column:
    items = []
    for k, r in rows_of(table):
        items += [F.lit(k), F.struct(*[F.lit(None if not isinstance(r, dict) or r.get(f) is None else str(r[f])).alias(f) for f in fields]) if fields else F.lit(str(r))]
    return F.create_map(*items)


def lookup(v: Value, table: dict[str, Any], add_field: str | None) -> Value:
    """The row (or value) whose key the value equals; without one the value stays, or the added field is null."""
    if not table:
        return v
    fields = _fields(table)
    hit = F.try_element_at(_literal_map(table, fields), v.text)
    if add_field:
        return Value(v.col, v.kind, v.adds | {add_field: hit}, v.records)
    return v.to(hit, "struct") if fields else v.to(F.coalesce(hit, v.text), "string")


def search(v: Value, table: dict[str, Any], add_field: str | None, fits: Callable[[Column, Column], Column], give_row: bool) -> Value:
    """The least key that fits the value: the key, or its row."""
    if not table:
        return v
    fields = _fields(table)
    keys = F.array(*[F.lit(k) for k, _ in rows_of(table)])
    key = F.get(F.filter(keys, lambda k: fits(v.text, k)), 0)
    hit = F.try_element_at(_literal_map(table, fields), key) if give_row or add_field else key
    if add_field:
        return Value(v.col, v.kind, v.adds | {add_field: hit}, v.records)
    return v.to(hit, "struct") if give_row and fields else v.to(F.coalesce(hit, v.text), "string")


def rlookup(v: Value, table: dict[str, Any], add_field: str | None) -> Value:
    return search(v, table, add_field, lambda c, k: c.contains(k) | F.rlike(c, glob(k)), give_row=False)


def gpvlookup(v: Value, table: dict[str, Any], pattern: str | None) -> Value:
    return search(v, table, None, lambda c, k: F.rlike(k, glob(F.lit(pattern) if pattern else c)), give_row=True)
