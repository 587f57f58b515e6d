"""A compiled template: a plan that turns a DataFrame of texts into DataFrames of records.

Everything up to the records is lazy and stays in the DataFrame API: lines,
one pass of anchored expressions over each line, function chains as Columns,
a window that numbers records, and a first-wins aggregation. Python workers
run only for macros, DNS, and the fold of groups with end markers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import group as group_functions
from ..functions import match as match_functions
from ..functions.match import Condition, FunctionError, Value
from ..operators import macros as macro_functions
from ..operators.lines import to_lines
from ..operators.segment import KEYS, Roles, last_so_far, segment
from ..pattern import HOLE, Call, Name, Pattern, PatternError, Variable, compile_line, dynamic_names, looks_around, parse_call, parse_calls
from ..sources.joins import lookup_join
from ..sources.readers import load_input
from ..template import Group, Template, parse, siblings

#: Functions that a group may use and still be read record by record.
STREAMABLE = {"contains", "containsall", "exclude", "excludeall", "equal", "contains_val", "exclude_val", "set", "record", "delete", "del", "to_int", "sformat", "to_ip", "expand", "items2dict", "cerberus", "validate", "macro"}
#: Functions that never turn a text into null.
_NEVER_NULL = {*match_functions.CONDITIONS, "upper", "lower", "strip", "split", "join", "replace", "IP", "mac_eui", "count", "record", "to_list", "to_str", "to_ip", "to_net", "to_unicode", "sformat", "resub", "replaceall", "resuball", "prepend", "append", "copy", "default", "unrange", "truncate", "print", "joinmatches"}
#: Rows of a lookup table that become literals of the plan.
LITERAL_ROWS = 5000
#: Types of fields that a default can fill.
_PLAIN = ("string", "long", "integer", "double", "boolean")
_RESERVED = {"ignore", "_start_", "_end_", "_exact_", "_exact_space_"}


class NotStreamable(ValueError):
    """A group can't be read record by record; `reasons` tells why, by group."""

    def __init__(self, reasons: dict[str, list[str]]):
        super().__init__("; ".join(f"{g}: {', '.join(r)}" for g, r in reasons.items()))
        self.reasons = reasons


@dataclass
class GroupPlan:
    group: Group
    patterns: list[Pattern]
    defaults: dict[str, Any]
    children: list[GroupPlan]
    fields: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.group.name

    @property
    def path(self) -> str:
        return self.group.name if not self.group.anonymous else "_anonymous_*"

    @property
    def roles(self) -> Roles:
        ps = self.patterns
        table = self.group.attrs.get("method") == "table"
        markers = frozenset(p.index for p in ps if p.start)
        ends = frozenset(p.index for p in ps if p.end)
        real = lambda p: any(v.name not in _RESERVED for v in p.variables)
        if table:
            starts = frozenset(p.index for p in ps)
        elif markers and ends:
            starts = markers
        elif markers:
            starts = markers | frozenset(p.index for p in ps if p.index < min(markers) and real(p))
        else:
            starts = frozenset([0])
        joined = any(v.joins for p in ps if p.index in starts for v in p.variables)
        return Roles(max(1, len(ps)), starts, markers, ends, any(p.whole_line and not any(v.joins for v in p.variables) for p in ps), any(p.blank and p.start for p in ps), joined, table)

    @property
    def never_empty(self) -> bool:
        """Whether each record has a field for certain, as each pattern that starts one captures a text that stays one."""
        if any(k in self.group.attrs for k in ("functions", "chain", "macro", "del", "delete", "record")):
            return False
        return self._in_each_start(lambda v: v.name not in (*_RESERVED, "_line_"))

    def always_has(self, name: str) -> bool:
        """Whether each record has a value of this field as captured."""
        changed = any(k in self.group.attrs for k in ("functions", "chain", "macro", "del", "delete", "record"))
        return not changed and self._in_each_start(lambda v: v.name == name)

    def _in_each_start(self, wanted: Callable[[Variable], bool]) -> bool:
        sure = lambda v: v.group and wanted(v) and not v.joins and all(c.name in _NEVER_NULL for c in v.calls)
        ps = [p for p in self.patterns if p.index in self.roles.starts]
        return bool(ps) and all(any(sure(v) for v in p.variables) for p in ps)

    def all_calls(self) -> list[Call]:
        return [c for p in self.patterns for v in p.variables for c in v.calls]


def _compile_group(g: Group, variables: dict[str, Any]) -> GroupPlan:
    patterns, defaults = [], {}
    for line in g.lines:
        p = compile_line(line, len(patterns), variables)
        if len(p.variables) == 1 and p.variables[0].group is None and not HOLE.sub("", line).strip():
            # A line that is nothing but a set() gives each record a default.
            call = next(c for c in p.variables[0].calls if c.name == "set")
            defaults[p.variables[0].name] = _argument(call.args[0], variables)
            continue
        patterns.append(p)
    out = GroupPlan(g, patterns, defaults, [_compile_group(c, variables) for c in g.children])
    out.fields = list(dict.fromkeys(v.name for p in patterns for v in p.variables if v.name not in _RESERVED and (v.name != "_line_" or v.joins)))
    return out


def _argument(x: Any, variables: dict[str, Any]) -> Any:
    if isinstance(x, Name):
        return variables.get(x.text, x.text)
    return x


class Plan:
    """What `compile_template` returns."""

    def __init__(self, template: Template, source: str, variables: dict[str, Any] | None = None, functions: dict[str, dict[str, Callable]] | None = None, lookups: dict[str, Any] | None = None, chunk_lines: int | None = None, strict: bool = False):
        #: Refuse expressions that look around or back.
        self.strict = strict
        #: For inputs too large for one task: lines of a chunk in which records are numbered.
        self.chunk_lines = chunk_lines
        self.template, self.source = template, source
        self.variables: dict[str, Any] = {**template.vars, **(variables or {})}
        self.lookups: dict[str, Any] = {**template.lookups, **(lookups or {})}
        self.functions = {"match": {}, "group": {}, "input": {}, "output": {}, **(functions or {})}
        self.macros = macro_functions.names(template.macros)
        self.groups = [_compile_group(g, self.variables) for g in template.groups]
        self.warnings = list(template.warnings)
        self._check()

    # Compile-time checks ------------------------------------------------

    def _check(self) -> None:
        seen: dict[str, str] = {}
        for g in self.groups:
            plain = g.path.replace("*", "")
            if seen.setdefault(plain, g.path) != g.path:
                raise FunctionError(f"groups {seen[plain]!r} and {g.path!r} are stored at one path")
            self._check_group(g)

    def _check_group(self, g: GroupPlan) -> None:
        known = set(match_functions.FUNCTIONS) | set(match_functions.CONDITIONS) | set(match_functions.PLANNED) | set(self.functions["match"])
        for c in g.all_calls():
            if c.name not in known:
                self.warnings.append(f"no such function: {c.name}")
            if c.name == "macro" and str(_argument(c.args[0], {})) not in self.macros:
                raise macro_functions.MacroError(f"no such macro: {c.args[0]}")
        for p in g.patterns:
            if self.strict and (odd := looks_around(p.regex)):
                raise PatternError(f"line {p.line!r}: {odd} is not allowed in strict mode")
            names = [v.name for v in p.variables]
            for n in {n for n in names if names.count(n) > 1 and n not in _RESERVED}:
                self.warnings.append(f"{n} occurs twice in {p.line!r}; the last one counts")
        yang = g.group.attrs.get("yang")
        if yang and not isinstance(self.variables.get(yang), dict):
            self.warnings.append(f"yang={yang!r} is not checked: YANG modules are not compiled; name a variable with rules, as for validate")
        for c in g.children:
            self._check_group(c)

    @property
    def key_fields(self) -> dict[str, list[str]]:
        """Declared keys by group path; metadata only."""
        out: dict[str, list[str]] = {}

        def walk(g: GroupPlan, prefix: str) -> None:
            path = f"{prefix}.{g.name}".strip(".")
            if "keys" in g.group.attrs:
                out[path] = [k.strip() for k in g.group.attrs["keys"].split(",")]
            for c in g.children:
                walk(c, path)

        for g in self.groups:
            walk(g, "")
        return out

    def why_not_streamable(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for g in self.groups:
            why = []
            if g.children:
                why.append("it has nested groups")
            if any(v.joins for p in g.patterns for v in p.variables):
                why.append("it collects matches")
            if not g.patterns:
                why.append("it has no pattern")
            a = g.group.attrs
            used = [c.name for k in ("functions", "chain") if k in a for c in self._calls(a[k])] + [k for k in a if k in group_functions.FUNCTIONS]
            why += [f"{n} needs more than one record" for n in used if n not in STREAMABLE]
            if "record" in a or "itemize" in a:
                why.append("records are grouped")
            if why:
                out[g.name or "_anonymous_"] = why
        return out

    @property
    def is_streamable(self) -> bool:
        return not self.why_not_streamable()

    def _calls(self, text: str) -> list[Call]:
        value = self.variables.get(text, text)
        return [c for t in (value if isinstance(value, list) else [value]) for c in parse_calls(str(t))]

    # Matching -----------------------------------------------------------

    def _table(self, name: Any) -> Any:
        n = name.text if isinstance(name, Name) else str(name)
        if n not in self.lookups:
            head, *rest = n.split(".")
            if head not in self.lookups:
                raise FunctionError(f"no such lookup table: {n}")
            table = self.lookups[head]
            for part in rest:
                table = table.get(part, {})
            return table
        return self.lookups[n]

    def _small_table(self, table: DataFrame) -> dict[str, Any]:
        """A keyed DataFrame as part of the plan, if it is small; `sources.joins.lookup_join` is for any size."""
        rows = table.select("key", "value").limit(LITERAL_ROWS + 1).collect()
        if len(rows) > LITERAL_ROWS:
            raise FunctionError(f"the lookup table has more than {LITERAL_ROWS} rows; join it with sources.joins.lookup_join")
        return {r["key"]: r["value"].asDict() if hasattr(r["value"], "asDict") else r["value"] for r in rows}

    def _apply(self, v: Value, calls: list[Call]) -> tuple[Value, list[Column]]:
        conditions: list[Column] = []
        for c in calls:
            args, kwargs = [_argument(a, self.variables) for a in c.args], {k: _argument(x, self.variables) for k, x in c.kwargs.items()}
            if c.name == "set":
                x = args[0] if args else None
                v = Value(match_functions.lit(x), match_functions.kind_of(x), v.adds, v.records)
            elif c.name in ("lookup", "rlookup", "gpvlookup"):
                name = c.args[0] if c.args else c.kwargs["name"]
                more = kwargs.get("add_field", kwargs.get("pattern", args[1] if len(args) > 1 else None))
                table = self._table(name)
                if isinstance(table, DataFrame):
                    table = self._small_table(table)
                v = getattr(match_functions, c.name)(v, table, more)
            elif c.name == "macro":
                name = str(args[0])
                run = macro_functions.match_macro(self.macros[name], name, self.variables)(v.text)
                conditions.append(run["keep"])
                v = v.to(run["value"], "string")
            else:
                f = self.functions["match"].get(c.name) or match_functions.CONDITIONS.get(c.name) or match_functions.FUNCTIONS.get(c.name)
                if f is None:
                    continue
                out = f(v, args, kwargs)
                if isinstance(out, Column):
                    out = v.to(out)
                if c.name == "raise":  # only where a value gets past the conditions before it
                    reached = v.text.isNotNull()
                    for x in conditions:
                        reached = reached & x
                    out = v.to(F.when(reached, out.col), "string")
                if isinstance(out, Condition):
                    conditions.append(F.coalesce(out.col, F.lit(False)))
                else:
                    v = out
        return v, conditions

    def _frame_lookup(self, var: Variable) -> tuple[Variable, tuple[str, DataFrame, str | None] | None]:
        """A variable whose last function looks its value up in a large frame, without that function; and the join that takes its place."""
        last = var.calls[-1] if var.calls else None
        if last is None or last.name != "lookup" or var.joins:
            return var, None
        table = self._table(last.args[0] if last.args else last.kwargs["name"])
        if not isinstance(table, DataFrame) or table.limit(LITERAL_ROWS + 1).count() <= LITERAL_ROWS:
            return var, None
        add = last.kwargs.get("add_field", last.args[1] if len(last.args) > 1 else None)
        return Variable(var.name, var.calls[:-1], var.group), (var.name, table, None if add is None else str(add))

    def _variable(self, caps: Column, var: Variable) -> tuple[Value, list[Column]]:
        start = Value(F.get(caps, var.group - 1) if var.group else F.lit(""))
        # A collecting variable's list is made of whole values: joinmatches and what follows it come after.
        names = [c.name for c in var.calls]
        calls = var.calls[: names.index("joinmatches")] if "joinmatches" in names else var.calls
        return self._apply(start, [c for c in calls if not ("joinmatches" in names and c.name == "to_list")])

    def _matches(self, lines: DataFrame, g: GroupPlan) -> tuple[DataFrame, list[str], list[str]]:
        """(input, key, line_no, p, fields...): a row for each line and pattern that fits; its fields; recorded variables."""
        made: list[tuple[Column, dict[str, Column]]] = []
        joins: list[tuple[str, DataFrame, str | None]] = []
        fields: dict[str, None] = dict.fromkeys(g.fields)
        recorded: dict[str, None] = {}
        collected = {v.name for p in g.patterns for v in p.variables if v.joins}
        df = lines
        for p in g.patterns:
            fits = F.col("line").rlike(p.regex)
            if p.literal:
                fits = F.col("line").contains(p.literal) & fits
            if len(g.patterns) == 1:
                df = df.where(fits)
                fits = F.lit(True)
            n = p.groups
            caps = F.split(F.regexp_replace("line", p.regex, "\x01".join(f"${i + 1}" for i in range(n))), "\x01", -1) if n else F.array(F.lit(""))
            df = df.withColumn(f"_c{p.index}", F.when(fits, caps) if len(g.patterns) > 1 else caps)
            values: dict[str, Column] = {}
            keep = F.col(f"_c{p.index}").isNotNull()
            for var in p.variables:
                var, join = self._frame_lookup(var)
                if join:
                    joins.append(join)
                    fields.setdefault(join[2] or join[0])
                v, conditions = self._variable(F.col(f"_c{p.index}"), var)
                c = v.col
                for cond in conditions:
                    if var.joins:
                        c = F.when(cond, c)
                    else:
                        keep = keep & cond
                if var.name in fields:
                    values[var.name] = c
                for name, x in v.adds.items():
                    fields.setdefault(name)
                    values[name] = x
                for name, x in v.records.items():
                    recorded.setdefault(name)
                    values[f"_r:{name}"] = x
            made.append((keep, values))
        columns = [(f"_j:{f}" if f in collected else f, f) for f in fields] + [(f"_r:{r}", f"_r:{r}") for r in recorded]
        rows = [F.when(keep, F.struct(F.lit(p.index).alias("p"), *[values.get(f, F.lit(None)).alias(n) for n, f in columns])) for p, (keep, values) in zip(g.patterns, made, strict=True)]
        if len(rows) == 1:
            (keep, values), p = made[0], g.patterns[0]
            out = df.where(keep).select(*KEYS, "line_no", F.lit(p.index).alias("p"), *[values.get(f, F.lit(None).cast("string")).alias(n) for n, f in columns])
        else:
            found = F.filter(F.array(*rows), lambda m: m.isNotNull())
            if g.roles.table:
                found = F.slice(found, 1, 1)
            else:
                weak = [p.index for p in g.patterns if (p.end or p.whole_line) and not p.start and not any(v.name not in (*_RESERVED, "_line_") for v in p.variables) and not (p.whole_line and not p.end)]
                if weak:
                    found = F.when(F.exists(found, lambda m: ~m["p"].isin(weak)), F.filter(found, lambda m: ~m["p"].isin(weak))).otherwise(found)
            out = df.select(*KEYS, "line_no", F.explode(found).alias("m")).select(*KEYS, "line_no", "m.*")
        for name, table, add in joins:
            out = lookup_join(out, name, table, add)
        return out, list(fields), list(recorded)

    # Records ------------------------------------------------------------

    def _records(self, lines: DataFrame, g: GroupPlan) -> tuple[DataFrame, list[str]]:
        """(input, key, rec, at, fields...) of a group, children included."""
        if not g.patterns:
            return self._wrapper(lines, g)
        matches, fields, recorded = self._matches(lines, g)
        joins = {v.name: v for p in g.patterns for v in p.variables if v.joins}
        roles = g.roles
        if recorded:  # the latest value up to each match
            matches = last_so_far(matches, [f"_r:{r}" for r in recorded], ["input"], ["line_no", "p"], self._chunk)
        rows = segment(matches, roles, self.chunk_lines, together=bool(recorded) and not self.chunk_lines)
        at = F.col("line_no") * roles.patterns + F.col("p")
        if roles.one_line and not joins:
            df = rows.select(*KEYS, "rec", at.alias("at"), F.col("line_no").alias("start_line"), "end_line", *[F.col(f"`{f}`") for f in fields], *[F.col(f"`_r:{r}`") for r in recorded])
        else:
            rows = rows.withColumn("at", at)
            aggs: list[Column] = [F.min("at").alias("at"), F.min("line_no").alias("start_line"), F.max("end_line").alias("end_line")]
            for f in fields:
                if f in joins:
                    c = F.transform(F.array_sort(F.collect_list(F.when(F.col(f"`_j:{f}`").isNotNull(), F.struct("at", F.col(f"`_j:{f}`").alias("v"))))), lambda x: x["v"])
                    names = [x.name for x in joins[f].calls]
                    after = joins[f].calls[names.index("joinmatches") + 1 :]
                    if "to_list" in names[: names.index("joinmatches")]:
                        c = F.when(F.size(c) > 0, c)
                        v, _ = self._apply(Value(c, "array"), after)
                    else:
                        sep = joins[f].joins.args[0] if joins[f].joins.args else "\n"
                        v, _ = self._apply(Value(F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), str(_argument(sep, self.variables)))), "string"), after)
                    aggs.append(v.col.alias(f))
                else:
                    aggs.append(F.min_by(F.col(f"`{f}`"), F.when(F.col(f"`{f}`").isNotNull(), F.col("at"))).alias(f))
            aggs += [F.max_by(F.col(f"`_r:{r}`"), "at").alias(f"_r:{r}") for r in recorded]
            df = rows.groupBy(*KEYS, "rec").agg(*aggs)
        for child in g.children:
            df, fields = self._nest(lines, df, fields, g, child)
        return self._finish(df, fields, recorded, g, lines)

    def _wrapper(self, lines: DataFrame, g: GroupPlan) -> tuple[DataFrame, list[str]]:
        """A group without patterns: the union of its children."""
        out, fields = None, []
        for c in g.children:
            df, own = self._records(lines, c)
            fields += [f for f in own if f not in fields]
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise FunctionError(f"group {g.name!r} has neither patterns nor groups")
        return out, fields

    @property
    def _chunk(self) -> Column | None:
        return F.floor(F.col("line_no") / self.chunk_lines) if self.chunk_lines else None

    def _inside(self, lines: DataFrame, df: DataFrame, g: GroupPlan) -> DataFrame:
        """Lines from each record's start to the next one's (or its end), keyed by the record: no join of intervals but a window."""
        roles = g.roles
        if roles.closed and not (roles.markers and roles.starts - roles.markers):
            # What starts a record is seen in the line itself, so the records need not be made to find their lines.
            begins = [F.when(self._fits(p), F.lit(p.index)) for p in g.patterns if p.index in (roles.markers or roles.starts)]
            at = F.coalesce(*begins) if roles.table or len(begins) == 1 else F.greatest(*begins)
            own = lines.withColumn("_in", F.col("line_no") * roles.patterns + at)
            own = last_so_far(own, ["_in"], KEYS, ["line_no"], self._chunk).where("_in is not null")
            return own.select("input", F.array_append("key", F.col("_in")).alias("key"), "line_no", "line")
        starts = df.select(*KEYS, F.col("start_line").alias("line_no"), F.lit(0).alias("kind"), F.struct("rec", "end_line").alias("_in"))
        own = lines.select(*KEYS, "line_no", F.lit(1).alias("kind"), "line").unionByName(starts, allowMissingColumns=True)
        own = last_so_far(own, ["_in"], KEYS, ["line_no", "kind"], self._chunk).where("kind = 1 and _in is not null and (_in.end_line is null or line_no <= _in.end_line)")
        return own.select("input", F.array_append("key", F.col("_in.rec")).alias("key"), "line_no", "line")

    def _fits(self, p: Pattern) -> Column:
        """Whether a line fits a pattern and the conditions on what it captures."""
        fits = F.col("line").rlike(p.regex)
        if p.literal:
            fits = F.col("line").contains(p.literal) & fits
        for var in p.variables:
            caps = F.split(F.regexp_replace("line", p.regex, "\x01".join(f"${i + 1}" for i in range(p.groups))), "\x01", -1)
            _, conditions = self._variable(caps, self._frame_lookup(var)[0])
            for cond in conditions if not var.joins else []:
                fits = fits & cond
        return F.coalesce(fits, F.lit(False))

    def _nest(self, lines: DataFrame, df: DataFrame, fields: list[str], g: GroupPlan, child: GroupPlan) -> tuple[DataFrame, list[str]]:
        """Records of a nested group, gathered by the record that they are in."""
        own = self._inside(lines, df, g)
        inner, names = self._records(own, child)
        base = child.name.split(".")[-1].replace("*", "")
        item = inner.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*[F.col(f"`{n}`") for n in names]).alias("r")))), lambda x: x["r"]).alias("_nested"))
        parent = df.withColumn("_of", F.array_append("key", F.col("rec")))
        joined = parent.join(item.select(F.col("input").alias("_i"), F.col("key").alias("_k"), "_nested"), (F.col("input") == F.col("_i")) & (F.col("_of") == F.col("_k")), "left").drop("_i", "_k", "_of")
        if base in ("", "_"):  # fields of the first nested record join the parent's, and win
            for n in names:
                c = F.get("_nested", 0)[n]
                joined = joined.withColumn(n, F.coalesce(c, F.col(f"`{n}`")) if n in fields else c)
            return joined.drop("_nested"), fields + [n for n in names if n not in fields]
        return joined.withColumnRenamed("_nested", base), [*[f for f in fields if f != base], base]

    def _finish(self, df: DataFrame, fields: list[str], recorded: list[str], g: GroupPlan, lines: DataFrame) -> tuple[DataFrame, list[str]]:
        a = g.group.attrs
        df, recorded = self._recorded_before(df, recorded, g, lines)
        r = group_functions.Records(df, fields, self.variables, {n: f"_r:{n}" for n in recorded})
        table = group_functions.FUNCTIONS | self.functions["group"]
        if "record" in a and a["record"] in r.fields:
            self._by_value(r, a["record"])
        for name in group_functions.ATTRIBUTE_ORDER + [n for n in self.functions["group"] if n not in group_functions.FUNCTIONS]:
            if name in a:
                call = parse_call(a[name]) if a[name].startswith(f"{name}(") else parse_call(f"{name}({a[name]})") if "'" in a[name] or '"' in a[name] or "=" in a[name] else Call(name, [x.strip() for x in a[name].split(",")])
                table[name](r, [_argument(x, {}) for x in call.args], {k: _argument(x, {}) for k, x in call.kwargs.items()})
        for key in ("chain", "functions"):
            if key in a:
                for call in self._calls(a[key]):
                    if call.name == "macro":
                        self._macro(r, g, [str(_argument(x, {})) for x in call.args])
                    elif call.name in table:
                        table[call.name](r, [_argument(x, {}) for x in call.args], {k: _argument(x, {}) for k, x in call.kwargs.items()})
                    else:
                        self.warnings.append(f"no such group function: {call.name}")
                break
        if "macro" in a:
            self._macro(r, g, [x.strip() for x in a["macro"].split(",")])
        for f, x in g.defaults.items():
            x = match_functions.lit(x)
            r.put(f, F.coalesce(group_functions.col(f), x) if f in r.fields else x)
        if "default" in a:
            d = self.variables.get(a["default"], a["default"])
            for f in d if isinstance(d, dict) else list(r.fields):
                x = F.lit(d[f] if isinstance(d, dict) else d)
                if f not in r.fields:
                    r.put(f, x)
                elif r.df.schema[f].dataType.typeName() in _PLAIN:
                    r.put(f, F.coalesce(group_functions.col(f), x.try_cast(r.df.schema[f].dataType)))
        if isinstance(rules := self.variables.get(a.get("yang", "")), dict) and rules:
            table["validate"](r, [a["yang"]], {})
        some = F.lit(g.never_empty)
        for f in [] if g.never_empty else r.fields:
            kind = r.df.schema[f].dataType.typeName()
            some = some | (F.coalesce(F.size(group_functions.col(f)), F.lit(0)) > 0 if kind == "array" else group_functions.col(f).isNotNull())
        if not g.never_empty:
            r.where(some)
        out = r.df.select(*KEYS, "rec", "at", "start_line", "end_line", *[group_functions.col(f) for f in r.fields])
        absent = self._default_record(g)
        if absent and not lines.isStreaming:  # an unbounded input has no end at which nothing was found
            out = self._with_default_record(out, r.fields, absent, lines)
        return out, r.fields

    def _default_record(self, g: GroupPlan) -> dict[str, Any]:
        """What an input (or a parent's record) without records of this group has in their place; empty: nothing.

        A text as `default=` stands for every variable of the group. Else, if a
        variable of the first pattern has default(), all variables that have
        one take theirs.
        """
        d = g.group.attrs.get("default")
        value = self.variables.get(d, d) if d else None
        variables = [v for p in g.patterns for v in p.variables if v.name not in _RESERVED and v.name != "_line_"]
        if isinstance(value, str):
            return {v.name: value for v in variables}
        first = {v.name for v in g.patterns[0].variables} if g.patterns else set()
        own: dict[str, Any] = {}
        for v in variables:
            for c in v.calls:
                if c.name == "default" and c.args:
                    own.setdefault(v.name, _argument(c.args[0], self.variables))
        return own if first & set(own) else {}

    def _with_default_record(self, records: DataFrame, fields: list[str], absent: dict[str, Any], lines: DataFrame) -> DataFrame:
        """A record of defaults for each input that has none; values that don't fit a field's type are null."""
        values = [(F.lit(absent[f]).try_cast(records.schema[f].dataType) if f in absent and records.schema[f].dataType.typeName() in _PLAIN else F.lit(None).cast(records.schema[f].dataType)).alias(f) for f in fields]
        keys = lines.select(*KEYS).distinct()
        found = records.select(F.col("input").alias("_i"), F.col("key").alias("_k")).distinct()
        none = keys.join(found, F.col("input").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left_anti")
        nowhere = F.lit(None).cast("bigint")
        return records.unionByName(none.select(*KEYS, F.lit(-1).cast("bigint").alias("rec"), F.lit(-1).cast("bigint").alias("at"), nowhere.alias("start_line"), nowhere.alias("end_line"), *values))

    def _recorded_before(self, df: DataFrame, recorded: list[str], g: GroupPlan, lines: DataFrame) -> tuple[DataFrame, list[str]]:
        """Variables that earlier groups recorded and this one names: their last value in each input."""
        if g not in self.groups:
            return df, recorded
        for e in reversed(self.groups[: self.groups.index(g)]):
            names = [str(_argument(c.args[-1], {})) for c in e.all_calls() if c.name == "record"]
            names = [n for n in names if n not in recorded and any(n in text for text in g.group.attrs.values())]
            if names and e.patterns:
                rows, _, _ = self._matches(lines, e)
                at = F.struct("line_no", "p")
                last = rows.groupBy("input").agg(*[F.max_by(F.col(f"`_r:{n}`"), F.when(F.col(f"`_r:{n}`").isNotNull(), at)).alias(f"_r:{n}") for n in names])
                df, recorded = df.join(last, "input", "left"), [*recorded, *names]
        return df, recorded

    def _by_value(self, r: group_functions.Records, by: str) -> None:
        """Records of one value of a field become one; their other fields list their distinct values in order of appearance."""
        others = [f for f in r.fields if f != by]
        ordered = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(group_functions.col(f).isNotNull(), F.struct("at", group_functions.col(f).alias("v"))))), lambda x: x["v"])).alias(f) for f in others]
        r.df = r.df.groupBy("input", "key", group_functions.col(by)).agg(F.min("rec").alias("rec"), F.min("at").alias("at"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), *ordered)

    def _macro(self, r: group_functions.Records, g: GroupPlan, names: list[str]) -> None:
        """Python on whole records. New fields are declared in the group's `fields` attribute, a schema in DDL."""
        for n in names:
            if n not in self.macros:
                raise macro_functions.MacroError(f"no such macro: {n}")
        own = r.df.select(*[group_functions.col(f) for f in r.fields]).schema
        extra = StructType.fromDDL(g.group.attrs["fields"]) if "fields" in g.group.attrs else StructType()
        schema = StructType([*[f for f in own.fields if f.name not in extra.names], *extra.fields])
        run = macro_functions.record_macros([(self.macros[n], n) for n in names], self.variables)
        others = [c for c in r.df.columns if c not in r.fields]
        df = r.df.withColumn("_m", run(F.to_json(F.struct(*[group_functions.col(f) for f in r.fields])))).where("_m is not null")
        df = df.withColumn("_m", F.from_json("_m", schema))
        r.df = df.select(*[group_functions.col(c) for c in others], *[F.col("_m")[f].alias(f) for f in schema.names])
        r.fields = list(schema.names)

    # Results ------------------------------------------------------------

    def inputs(self, spark: SparkSession, passed: DataFrame | dict[str, str] | None = None, fetch: bool = False) -> DataFrame:
        """(input, text, tag): what the template's <input> tags load, and the texts passed, which win over the same name.

        A tag's `load` is text (its own content; also json, yaml or csv), file or directory (`url`:
        paths, comma-separated; `extensions` without dots and `filters`,
        expressions one of which the path must contain), url (only with
        `fetch`) or database (`url`: its address, `query`, `format`: csv or
        json). A file's input is its path, or the tag's name for a tag of one
        file (of a folder with several, each keeps its path). `tag` is the number of the tag; null for texts passed.
        """
        out: DataFrame | None = None
        for i, node in enumerate(self.template.inputs):
            df = load_input(spark, node.attrs, node.text, fetch)
            if df is not None:
                name = F.lit(node.attrs["name"]) if node.attrs.get("load") == "file" and "name" in node.attrs else F.col("input")
                df = df.withColumn("tag", F.lit(i)).withColumn("_name", name)
                out = df if out is None else out.unionByName(df)
        if not isinstance(passed, DataFrame):
            passed = spark.createDataFrame(list((passed or {}).items()), "input string, text string")
        passed = passed.select("input", "text", F.lit(None).cast("int").alias("tag"))
        if out is None:
            return passed
        names = passed.select(F.col("input").alias("_name")).distinct()
        return passed.unionByName(out.join(names, "_name", "left_anti").select("input", "text", "tag"))

    def _prepared(self, inputs: DataFrame, g: GroupPlan) -> DataFrame:
        from ..functions.inputs import apply_inputs, of_tag

        df = inputs if "tag" in inputs.columns else inputs.withColumn("tag", F.lit(None).cast("int"))
        for i, node in enumerate(self.template.inputs):
            groups = [x.strip() for x in node.attrs.get("groups", "all").split(",")]
            if not {"all", g.name, g.name.replace("*", "")} & set(groups):
                df = df.where(~of_tag(i, node))
        df = apply_inputs(self, df.select("input", "text", "tag"))
        if "input" in g.group.attrs:
            wanted = [x.strip() for x in g.group.attrs["input"].split(",")]
            tags = [i for i, node in enumerate(self.template.inputs) if node.attrs.get("name") in wanted]
            df = df.where(F.col("input").isin(*wanted) | F.coalesce(F.col("tag").isin(*tags), F.lit(False)))
        return to_lines(df)

    def group_records(self, inputs: DataFrame, g: GroupPlan) -> tuple[DataFrame, list[str]]:
        return self._records(self._prepared(inputs, g), g)

    def records(self, inputs: DataFrame, path: str | None = None) -> DataFrame:
        """Typed records of the groups with this name (or of the only one): input and the fields, nested groups as arrays."""
        out: DataFrame | None = None
        for g in self.groups:
            if path is not None and g.name.replace("*", "") != path:
                continue
            df, fields = self.group_records(inputs, g)
            df = df.select("input", *[group_functions.col(f) for f in fields])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise FunctionError(f"no group named {path}")
        return out

    def frames(self, inputs: DataFrame) -> dict[str, DataFrame]:
        """Typed records by group path."""
        names = list(dict.fromkeys(g.name.replace("*", "") for g in self.groups if g.group.attrs.get("void", "").lower() not in ("", "true") or "void" not in g.group.attrs))
        return {n: self.records(inputs, n) for n in names}

    def results(self, inputs: DataFrame) -> DataFrame:
        """(input, result): each input's tree of results as JSON."""
        from ..operators.paths import results

        return results(self, inputs)

    def lineage(self, inputs: DataFrame) -> DataFrame:
        """(input, line_no, group, pattern, spans): where each line's variables were captured."""
        from ..operators.lineage import lineage

        return lineage(self, inputs)

    def save(self) -> str:
        """The plan as JSON: its source and variables, compiled again by `load`."""
        return json.dumps({"version": 1, "source": self.source, "variables": self.variables, "lookups": {k: v for k, v in self.lookups.items() if not isinstance(v, DataFrame)}})


def compile_template(text: str, base: str | None = None, **options: Any) -> Plan:
    """Compile a template. Options: variables, functions (by kind), lookups, chunk_lines, strict."""
    return Plan(parse(text, base), text, **options)


def compile_siblings(text: str, base: str | None = None, **options: Any) -> list[Plan]:
    """A plan for each of several <template> tags side by side, with its own attributes; else one."""
    return [compile_template(t, base, **options) for t in siblings(text)]


def load(saved: str, **options: Any) -> Plan:
    d = json.loads(saved)
    return Plan(parse(d["source"]), d["source"], variables=d["variables"], lookups=d["lookups"], **options)


def resolved_path(g: GroupPlan, fields: list[str], variables: dict[str, Any]) -> tuple[list[Column], list[str]]:
    """A group's path, segment by segment, with the variables of its name in place; and those variables."""
    names = [n for n in dynamic_names(g.path) if n in fields]
    w = Window.partitionBy("input").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = []
    for part in g.path.split("."):
        c: Column = F.lit(part)
        for n in dynamic_names(part):
            own = F.col(f"`{n}`").cast("string")
            options = [own if g.always_has(n) else F.last(own, ignorenulls=True).over(w)] if n in fields else []
            options += [F.lit(str(variables[n]))] if n in variables else []
            hole = next(h for h in (f"{{{{ {n} }}}}", f"{{{{{n}}}}}") if h in part)
            c = F.replace(c, F.lit(hole), F.coalesce(*options, F.lit(hole)))
        segments.append(c)
    return segments, names
