"""Macros: Python functions of a template, run in Arrow batches on the executors."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class MacroError(ValueError):
    pass


def names(sources: list[str]) -> dict[str, str]:
    """Each function's name and the source that defines it."""
    out: dict[str, str] = {}
    for s in sources:
        try:
            tree = ast.parse(s)
        except SyntaxError as e:
            raise MacroError(f"a macro is no Python: {e}") from e
        out |= {n.name: s for n in tree.body if isinstance(n, ast.FunctionDef)}
    return out


def _load(source: str, name: str, context: dict[str, Any]) -> Callable:
    space: dict[str, Any] = {"re": __import__("re"), "json": json, "_context_": context}
    exec(source, space)  # noqa: S102  the template's author is trusted, as with any function of theirs
    return space[name]


def match_macro(source: str, name: str, context: dict[str, Any]) -> Callable[[Column], Column]:
    """value -> struct(keep, value): False drops the match, None and True leave the value, else the result as text."""

    @F.pandas_udf("keep boolean, value string")
    def run(s: pd.Series) -> pd.DataFrame:
        f = _load(source, name, context)
        keep, value = [], []
        for x in s:
            y = f(x) if x is not None else None
            keep.append(y is not False)
            value.append(x if y is None or isinstance(y, bool) else json.dumps(y) if isinstance(y, (dict, list)) else str(y))
        return pd.DataFrame({"keep": keep, "value": value})

    return run


def record_macros(sources: list[tuple[str, str]], context: dict[str, Any]) -> Callable[[Column], Column]:
    """A record as JSON through several macros in one call; null: the record is dropped."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        fs = [_load(source, name, context) for source, name in sources]
        out = []
        for x in s:
            r: Any = json.loads(x)
            for f in fs:
                y = f(r)
                if y is False:
                    r = None
                    break
                r = r if y is None or y is True else y
            out.append(None if r is None else json.dumps(r))
        return pd.Series(out)

    return run
