"""The object-style interface: templates, inputs and variables are added, then parsed together."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.outputs import apply_outputs
from .plans.plan import Plan, compile_siblings
from .sources.returners import as_python
from .template import validate

DEFAULT_INPUT = "Default_Input"


class Parser:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.texts: dict[str, str] = {}
        self.variables: dict[str, Any] = {}
        self.lookups: dict[str, Any] = {}
        self.functions: dict[str, dict[str, Callable]] = {"match": {}, "group": {}, "input": {}, "output": {}}
        self._templates: list[tuple[str, str | None]] = []

    def add_template(self, text: str, base: str | None = None) -> Parser:
        if found := [p for p in validate(text) if "no group" not in p]:
            raise ValueError("; ".join(found))
        self._templates.append((text, base))
        return self

    def add_input(self, text: str, name: str = DEFAULT_INPUT) -> Parser:
        self.texts[name] = text
        return self

    def add_vars(self, **variables: Any) -> Parser:
        self.variables |= variables
        return self

    def add_lookup(self, name: str, table: dict[str, Any]) -> Parser:
        self.lookups[name] = table
        return self

    def add_function(self, kind: str, name: str, f: Callable) -> Parser:
        """A function of one's own. match: (Value, args, kwargs) -> Column, Value or Condition; group: (Records, args, kwargs); input: (Column, *args) -> Column; output: (data, *args, **kwargs) -> data."""
        self.functions[kind][name] = f
        return self

    def plans(self) -> list[Plan]:
        """One for each template; <template> tags side by side are templates of their own."""
        return [p for t, base in self._templates for p in compile_siblings(t, base, variables=self.variables, lookups=self.lookups, functions=self.functions)]

    def frames(self) -> list[dict[str, DataFrame]]:
        """Typed records by group, for each template."""
        return [p.frames(p.inputs(self.spark, self.texts)) for p in self.plans()]

    def parse(self) -> list[Any]:
        """Results for each template, through its outputs."""
        return [apply_outputs(p, as_python(p.results(p.inputs(self.spark, self.texts)))) for p in self.plans()]
