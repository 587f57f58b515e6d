"""Functions of whole input texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..pattern import parse_calls
from .match import quote

#: Prompts of six kinds, tried in this order.
PROMPTS = [r"(\w+)[#>]", r"\S+@(\S+)>", r"<(\S+)>", r"\S+:(\S+)#", r"(\S+ \(\S+\)) #", r"\n\S{1,2}:(\S+?)[>#]"]


def hostname(text: Column) -> Column:
    """The host name in the first prompt found, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in PROMPTS])


def extract_commands(text: Column, *commands: str) -> Column:
    """What follows each command at a prompt, up to the next prompt or the end."""
    parts = [F.array_join(F.regexp_extract_all(text, F.lit(rf"(?m)^\S+[#>] *{quote(c)} *\n([\s\S]*?)(?=^\S+[#>]|\z)"), 1), "\n") for c in commands]
    return F.concat_ws("\n", *parts)


FUNCTIONS: dict[str, Callable] = {"extract_commands": extract_commands, "test": lambda c, *a: c}


def of_tag(i: int, node) -> Column:
    """Whether an input came from this tag, or was passed under its name."""
    return F.coalesce(F.col("tag") == i, F.col("input") == node.attrs.get("name", "Default_Input"), F.lit(False))


def apply_inputs(plan, inputs: DataFrame) -> DataFrame:
    """Inputs (input, text, tag) whose tag has functions or macros go through them; a macro that returns False empties the text."""
    for i, node in enumerate(plan.template.inputs):
        c: Column = F.col("text")
        for call in parse_calls(node.attrs.get("functions", "")):
            f = plan.functions["input"].get(call.name) or FUNCTIONS.get(call.name)
            if f is None:
                plan.warnings.append(f"no such input function: {call.name}")
                continue
            c = f(c, *call.args)
        if "extract_commands" in node.attrs:
            c = extract_commands(c, *[x.strip() for x in node.attrs["extract_commands"].split(",")])
        for m in [x.strip() for x in node.attrs.get("macro", "").split(",") if x.strip()]:
            from ..operators.macros import match_macro

            run = match_macro(plan.macros[m], m, plan.variables)(c)
            c = F.when(run["keep"], run["value"]).otherwise(F.lit(""))
        inputs = inputs.withColumn("text", F.when(of_tag(i, node), c).otherwise(F.col("text")))
    return inputs
