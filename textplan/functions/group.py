"""Functions of whole records: filters and rewrites of a DataFrame of records."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .match import FunctionError, lit, strip


def col(name: str) -> Column:
    return F.col(f"`{name}`")


class Records:
    """Records of one group: the frame, the names of their fields, and what functions may look up."""

    def __init__(self, df: DataFrame, fields: list[str], variables: dict[str, Any], recorded: dict[str, str]):
        self.df, self.fields, self.variables = df, list(fields), variables
        #: Recorded variable -> column that carries its value.
        self.recorded = recorded
        self.item: str | None = None

    def where(self, c: Column) -> None:
        self.df = self.df.where(c)

    def put(self, name: str, c: Column) -> None:
        self.df = self.df.withColumn(name, c)
        if name not in self.fields:
            self.fields.append(name)

    def drop(self, *names: str) -> None:
        self.df = self.df.drop(*[n for n in names if n in self.fields])
        self.fields = [f for f in self.fields if f not in names]

    def present(self, name: str) -> Column:
        return col(name).isNotNull() if name in self.fields else F.lit(False)

    def text(self, name: str) -> Column:
        return col(name).cast("string") if name in self.fields else F.lit(None).cast("string")

    def either(self, value: Any) -> Any:
        """An argument that names a template variable stands for it."""
        return self.variables.get(value, value) if isinstance(value, str) else value


def _all(cs: list[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def contains(r: Records, a, k):
    r.where(~_all([~r.present(x) for x in a]))


def containsall(r: Records, a, k):
    r.where(_all([r.present(x) for x in a]))


def exclude(r: Records, a, k):
    r.where(_all([~r.present(x) for x in a]))


def excludeall(r: Records, a, k):
    r.where(~_all([r.present(x) for x in a]))


def equal(r: Records, a, k):
    r.where(F.coalesce(r.text(a[0]) == lit(r.either(a[1])).cast("string"), F.lit(False)))


def contains_val(r: Records, a, k):
    r.where(F.coalesce(r.text(a[0]).contains(lit(r.either(a[1])).cast("string")), F.lit(False)))


def exclude_val(r: Records, a, k):
    r.where(~F.coalesce(r.text(a[0]).contains(lit(r.either(a[1])).cast("string")), F.lit(False)))


def set_(r: Records, a, k):
    """From a recorded or template variable, then the default, then a field, then the text itself."""
    source, target = str(a[0]), str(a[1] if len(a) > 1 else a[0])
    options: list[Column] = []
    if source in r.recorded:
        options.append(col(r.recorded[source]))
    if source in r.variables:
        options.append(lit(r.variables[source]).cast("string"))
    if "default" in k:
        options.append(lit(k["default"]).cast("string"))
    if source in r.fields:
        options.append(r.text(source))
    r.put(target, F.coalesce(*options, F.lit(source)))


def delete(r: Records, a, k):
    r.drop(*a)


def expand(r: Records, a, k):
    """Fields `a.b` become a field b of a struct a."""
    def build(prefix: str, names: list[str]) -> list[Column]:
        heads: dict[str, list[str]] = {}
        for n in names:
            heads.setdefault(n.split(".")[0], []).append(n)
        out = []
        for head, members in heads.items():
            full = f"{prefix}{head}"
            inner = [m[len(head) + 1 :] for m in members if "." in m]
            out.append((F.struct(*build(f"{full}.", inner)) if inner else col(full)).alias(head))
        return out

    dotted = [f for f in r.fields if "." in f]
    for head in dict.fromkeys(f.split(".")[0] for f in dotted):
        own = [f[len(head) + 1 :] for f in dotted if f.split(".")[0] == head]
        r.put(head, F.struct(*build(f"{head}.", own)))
    r.drop(*dotted)


def itemize(r: Records, a, k):
    r.where(r.present(a[0]))
    r.item = str(a[0])


def to_int(r: Records, a, k):
    for f in a or list(r.fields):
        if f not in r.fields:
            continue
        kind = r.df.schema[f].dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType) and k.get("intlist"):
            r.put(f, F.transform(col(f), lambda x: strip(x).try_cast("bigint")))
        elif isinstance(kind, StringType):
            n = strip(col(f)).try_cast("bigint")
            if a:
                r.put(f, n)
            else:  # all fields: those with other text stay text, as a column has one type
                r.put(f, F.coalesce(n.cast("string"), col(f)))


def sformat(r: Records, a, k):
    fmt, target = str(a[0] if a else k["string"]), str(a[1] if len(a) > 1 else k["add_field"])
    c: Column = F.lit(fmt)
    for f in r.fields:
        if "{" + f + "}" in fmt:
            c = F.replace(c, F.lit("{" + f + "}"), F.coalesce(r.text(f), F.lit("{" + f + "}")))
    for name, value in r.variables.items():
        if "{" + name + "}" in fmt and name not in r.fields:
            c = F.replace(c, F.lit("{" + name + "}"), F.lit(str(value)))
    r.put(target, c)


def items2dict(r: Records, a, k):
    both = r.present(a[0]) & r.present(a[1])
    r.put("items", F.when(both, F.create_map(r.text(a[0]), r.text(a[1]))))
    r.drop(a[0], a[1])


def to_ip(r: Records, a, k):
    """Values stay; the arguments must be fields."""


def record(r: Records, a, k):
    r.recorded[str(a[1] if len(a) > 1 else a[0])] = str(a[0])


def problems(r: Records, schema: dict[str, Any]) -> Column:
    """An array of (field, error, message) for a record and a schema of rules by field."""
    found: list[Column] = []

    def add(bad: Column, field: str, error: str, message: str) -> None:
        found.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(error).alias("error"), F.lit(message).alias("message"))))

    def rules(prefix: str, schema: dict[str, Any], has: Callable[[str], bool], get: Callable[[str], Column]) -> None:
        for name, rule in schema.items():
            field = prefix + name
            if not has(name):
                if rule.get("required"):
                    add(F.lit(True), field, "required", "required field")
                continue
            c = get(name)
            text, number = c.cast("string"), c.cast("string").try_cast("double")
            if rule.get("required"):
                add(c.isNull(), field, "required", "required field")
            kind = rule.get("type")
            if kind in ("integer", "int"):
                add(c.isNotNull() & text.try_cast("bigint").isNull(), field, "type", "must be of integer type")
            elif kind in ("float", "number"):
                add(c.isNotNull() & number.isNull(), field, "type", "must be of number type")
            elif kind in ("boolean", "bool"):
                add(c.isNotNull() & ~F.lower(text).isin("true", "false"), field, "type", "must be of boolean type")
            if "min" in rule:
                add(number < float(rule["min"]), field, "min", f"min value is {rule['min']}")
            if "max" in rule:
                add(number > float(rule["max"]), field, "max", f"max value is {rule['max']}")
            if "regex" in rule:
                add(~text.rlike(f"^(?:{rule['regex']})$"), field, "regex", f"value does not match {rule['regex']}")
            if "allowed" in rule:
                add(~text.isin(*map(str, rule["allowed"])), field, "allowed", "unallowed value")
            if "forbidden" in rule:
                add(text.isin(*map(str, rule["forbidden"])), field, "forbidden", "forbidden value")
            if isinstance(rule.get("schema"), dict):
                kind = r.df.select(c.alias("c")).schema["c"].dataType
                inner = set(getattr(kind, "names", []))
                rules(field + ".", rule["schema"], inner.__contains__, lambda n, c=c: c[n])

    rules("", schema, r.fields.__contains__, col)
    empty = F.expr("cast(array() as array<struct<field: string, error: string, message: string>>)")
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else empty


def cerberus(r: Records, a, k):
    r.where(F.size(problems(r, _schema(r, a))) == 0)


def validate(r: Records, a, k):
    r.put("_validation_errors_", problems(r, _schema(r, a)))
    r.put("_validation_valid_", F.size(col("_validation_errors_")) == 0)


def _schema(r: Records, a) -> dict[str, Any]:
    schema = r.either(a[0]) if a else None
    if not isinstance(schema, dict):
        raise FunctionError(f"no schema named {a[0] if a else ''}")
    return schema


FUNCTIONS: dict[str, Callable[[Records, list, dict], None]] = {
    "contains": contains, "containsall": containsall, "exclude": exclude, "excludeall": excludeall, "equal": equal,
    "contains_val": contains_val, "exclude_val": exclude_val, "set": set_, "record": record, "delete": delete, "del": delete,
    "expand": expand, "itemize": itemize, "to_int": to_int, "sformat": sformat, "items2dict": items2dict, "to_ip": to_ip,
    "cerberus": cerberus, "validate": validate,
}
#: Functions given as attributes of a group run in this order, whatever the order in the tag.
ATTRIBUTE_ORDER = ["containsall", "contains", "del", "delete", "exclude", "excludeall", "equal", "to_int", "contains_val", "exclude_val", "sformat", "itemize", "set", "expand", "items2dict", "to_ip", "cerberus", "validate"]
