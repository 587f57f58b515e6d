"""textplan: template-driven text parsing planned as Spark DataFrames."""

from .api import Parser
from .plans.plan import NotStreamable, Plan, compile_template, load
from .template import Template, TemplateError, parse, validate

__all__ = ["NotStreamable", "Parser", "Plan", "Template", "TemplateError", "compile_template", "load", "parse", "validate"]
