"""Inputs and lookup tables from files, tables and addresses."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..template import load_text


def read_texts(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(input, text): each file under a path as one input, named by its path. Files of up to 2 GB."""
    r = spark.read.option("recursiveFileLookup", recursive)
    if extensions:
        r = r.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("input"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(input, key, line_no, line) of files of any size, split over tasks; line_no counts along each file.

    A first pass counts the lines of each block of a file; a line's number is
    the count of the blocks before its own and its place within it. Both
    passes split the files alike, and a task reads its lines in order.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("input"), F.col("_metadata.file_block_start").alias("block"), row.alias("n"), F.regexp_replace("value", r"[\r \t]+$", "").alias("line"))
    blocks = lines.groupBy("input", "block").agg(F.count("*").alias("size"), F.min("n").alias("first"))
    before = Window.partitionBy("input").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return lines.join(blocks, ["input", "block"]).select("input", F.expr("cast(array() as array<bigint>)").alias("key"), (F.col("before") + F.col("n") - F.col("first")).alias("line_no"), "line")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_yaml(path: str) -> Any:
    return load_text(Path(path).read_text(), "yaml")


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database with a driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_database(spark: SparkSession, url: str, query: str, kind: str = "csv", **options: str) -> DataFrame:
    """(input, text): a query's result as one text, a line of CSV or JSON for each row, in the order of the lines."""
    return as_one_text(read_query(spark, url, query, **options), url, kind)


def as_one_text(df: DataFrame, name: str, kind: str = "csv") -> DataFrame:
    """Rows as lines of one input. For results of a size to be one text."""
    lines = as_text(df, kind).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    return lines.select(F.lit(name).alias("input"), "text")


def load_input(spark: SparkSession, attrs: dict[str, str], text: str, fetch: bool = False) -> DataFrame | None:
    """(input, text) of an <input> tag; None for one without text or address.

    json and yaml hold one text, a list of texts or texts by name; csv is text as it is.
    """
    kind, name = attrs.get("load", "text"), attrs.get("name")
    address = [x.strip() for x in attrs.get("url", "").split(",") if x.strip()]
    if kind in ("json", "yaml") and text.strip():
        data = load_text(text, kind)
        named = data.items() if isinstance(data, dict) else [(name or "Default_Input", data)] if isinstance(data, str) else [(f"{name or 'Default_Input'}-{i}", x) for i, x in enumerate(data)]
        return spark.createDataFrame([(str(k), x if isinstance(x, str) else json.dumps(x)) for k, x in named], "input string, text string")
    if kind in ("text", "json", "yaml", "csv"):
        return spark.createDataFrame([(name or "Default_Input", text.strip("\n"))], "input string, text string") if text.strip() else None
    if kind in ("file", "directory", "url", "database") and not address:
        raise ValueError(f"<input load={kind!r}> has no url")
    if kind == "url":
        return read_urls(spark.createDataFrame([(a,) for a in address], "url string"), allow=fetch)
    if kind == "database":
        options = {k: v for k, v in attrs.items() if k in ("driver", "user", "password")}
        found = read_database(spark, address[0], attrs["query"], attrs.get("format", "csv"), **options)
        return found.withColumn("input", F.lit(name)) if name else found
    if kind not in ("file", "directory"):
        raise ValueError(f"no such way to load an input: {kind}")
    listed = lambda k: [x.strip() for x in attrs.get(k, "").split(",") if x.strip()]
    out: DataFrame | None = None
    for path in address:
        found = read_texts(spark, path, listed("extensions") if kind == "directory" else None)
        out = found if out is None else out.unionByName(found)
    if filters := listed("filters"):
        out = out.where(F.greatest(F.lit(False), *[F.col("input").rlike(f) for f in filters]))
    # The lines of several files under one name would be numbered alike and mix; a folder's files keep their paths.
    return out.withColumn("input", F.lit(name)) if name and kind == "file" and len(address) == 1 and len(out.inputFiles()) == 1 else out


def as_text(df: DataFrame, kind: str = "csv") -> DataFrame:
    """Rows as lines of text, as a query's result is parsed."""
    return df.select(F.to_csv(F.struct("*")).alias("line") if kind == "csv" else F.to_json(F.struct("*")).alias("line"))


def read_urls(addresses: DataFrame, timeout: float = 30, allow: bool = False) -> DataFrame:
    """(input, text) fetched from a column `url`; off unless allowed."""
    if not allow:
        raise PermissionError("fetching addresses is off; pass allow=True")

    def go(batches):
        import urllib.request

        for t in batches:
            texts = []
            for u in t["url"]:
                with urllib.request.urlopen(u, timeout=timeout) as r:  # noqa: S310
                    if r.status != 200:
                        raise OSError(f"{u}: status {r.status}")
                    texts.append(r.read().decode())
            yield t.assign(input=t["url"], text=texts)[["input", "text"]]

    return addresses.select("url").mapInPandas(go, "input string, text string")


def lookup_table(df: DataFrame, key: str, value: str | None = None, many: bool = False) -> DataFrame:
    """A keyed table: key and value (or a list of values, or the whole row)."""
    k = F.col(key).cast("string").alias("key")
    if value is None:
        return df.select(k, F.struct(*df.columns).alias("value")).dropDuplicates(["key"])
    if many:
        return df.groupBy(k).agg(F.array_sort(F.collect_list(value)).alias("value"))
    return df.groupBy(k).agg(F.min(value).alias("value"))


def load_lookups(data: str, kind: str = "json", name: str | None = None, key: str | None = None) -> dict[str, Any]:
    """Named tables from one text: many in a map of tables (json, yaml), or one under `name`."""
    tables = json.loads(data) if kind == "json" else load_text(data, kind, key)
    return {name: tables} if name else tables


def merge_lookups(*tables: dict[str, Any]) -> dict[str, Any]:
    """Later tables replace earlier ones of the same name."""
    out: dict[str, Any] = {}
    for t in tables:
        out |= t
    return out
