"""Lookups in tables that are DataFrames: joins, broadcast only when their size is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.match import glob

#: Rows of a lookup table that may be broadcast.
BROADCAST_ROWS = 100_000
#: Least characters of a glob by which it finds the texts to try.
GRAM = 3


def _small(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def lookup_join(records: DataFrame, field: str, table: DataFrame, add_field: str | None = None) -> DataFrame:
    """A left join of records on table.key; the value replaces the field, or goes to `add_field`.

    A table beyond BROADCAST_ROWS is joined by sort and merge, which AQE splits where a key is hot.
    """
    t = table.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    t = F.broadcast(t) if _small(table) else t
    out = records.join(t, F.col(f"`{field}`").cast("string") == F.col("_key"), "left")
    if add_field:
        return out.withColumn(add_field, F.col("_value")).drop("_key", "_value")
    return out.withColumn(field, F.coalesce(F.col("_value").cast("string"), F.col(f"`{field}`").cast("string"))).drop("_key", "_value")


def _grams(text: Column, size: Column | int) -> Column:
    """Hashes of all runs of `size` characters of a text."""
    last = F.length(text) - size + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.substring(text, i, size)))
    return F.when(last > 0, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def _meetings(globs: DataFrame, glob_of: str, texts: DataFrame, text_of: str) -> DataFrame:
    """Pairs of globs and texts to try: every pair that fits is among them."""
    runs = F.array_sort(F.split(glob_of, "[*?]+"), lambda a, b: F.length(b) - F.length(a))
    globs = globs.withColumn("_run", F.get(runs, 0)).where("_run is not null")
    n = F.length("_run")
    globs = globs.withColumn("_size", F.when(n < GRAM, 0).when(n == GRAM, GRAM).otherwise(F.expr("shiftleft(1, length(bin(length(_run))) - 1)")))
    found = {r["_size"]: r["count"] for r in globs.groupBy("_size").count().collect()}
    n_loose = found.pop(0, 0)
    loose = globs.where("_size = 0").drop("_run", "_size")
    sure = globs.where("_size > 0")
    held = sure.select("_run", "_size").distinct().select("_run", F.explode(F.array_distinct(_grams(F.col("_run"), F.col("_size")))).alias("_gram"))
    rarest = held.join(held.groupBy("_gram").count(), "_gram").groupBy("_run").agg(F.min_by("_gram", F.struct("count", "_gram")).alias("_gram"))
    sure = sure.join(rarest, "_run").drop("_run", "_size")
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(text_of), size) for size in sorted(found) or [GRAM]])))
    pairs = texts.withColumn("_gram", F.explode(grams)).join(F.broadcast(sure) if sum(found.values()) <= BROADCAST_ROWS else sure, "_gram").drop("_gram")
    if not n_loose:
        return pairs
    if n_loose <= BROADCAST_ROWS:
        return pairs.unionByName(texts.crossJoin(F.broadcast(loose)))
    if _small(texts):
        return pairs.unionByName(loose.crossJoin(F.broadcast(texts)))
    raise ValueError(f"more than {BROADCAST_ROWS} globs have less than {GRAM} fixed characters on end, and as many texts are searched")


def search_join(records: DataFrame, field: str, table: DataFrame, add_field: str, keys_are_globs: bool = True) -> DataFrame:
    """The value of the least key that the field contains or matches as a glob (or that matches the field, if that is the glob).

    Each distinct value of the field is searched once. A glob's longest fixed
    text must stand in what it matches, so a run of its characters (as many as
    the largest power of two that it holds; GRAM of three) is looked up among
    all runs of that length of the texts: an equi-join at any size, and only
    pairs that meet there are tried. Of the runs that a glob has, that which
    the fewest other globs hold is taken, so a common beginning or end brings
    no pairs. Globs with less than GRAM characters of fixed text are tried on
    every text; as they say little, at most BROADCAST_ROWS of them, or of the
    texts, may exist.
    """
    asked = records.select(F.col(f"`{field}`").cast("string").alias("_asked")).where("_asked is not null").distinct()
    keys = table.select(F.col("key").alias("_key"), F.col("value").alias("_found"))
    pairs, text_of, glob_of = (_meetings(keys, "_key", asked, "_asked"), "_asked", "_key") if keys_are_globs else (_meetings(asked, "_asked", keys, "_key"), "_key", "_asked")
    fits = F.rlike(F.col(text_of), glob(F.col(glob_of)))
    if keys_are_globs:
        fits = F.col(text_of).contains(F.col(glob_of)) | fits
    hits = pairs.where(fits).groupBy("_asked").agg(F.min_by("_found", "_key").alias(add_field))
    return records.drop(add_field).join(hits, F.col(f"`{field}`").cast("string") == F.col("_asked"), "left").drop("_asked")


def count_up_to(ascending: str, place: Column, n: int) -> Column:
    """How many of the at most n values of a sorted array are not above `place`: a search by halves, as each row asks."""
    steps = [1 << i for i in reversed(range(n.bit_length()))] or [1]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda below, step: F.when(F.get(ascending, below + step - 1) <= place, below + step).otherwise(below))


def as_of(records: DataFrame, order: str, value: str, by: str = "input") -> DataFrame:
    """Each record with the latest value so far of a column that is null in most: what recorded variables are.

    Records are cut into chunks of about equal size by (by, order), so that no
    task holds a whole input; each chunk's last value is carried to the next
    ones through a table of one row a chunk.
    """
    spark = records.sparkSession
    place = F.struct(F.col(f"`{by}`").alias("by"), F.col(f"`{order}`").alias("order"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Where chunks start, a value each, fixed on the driver: each record's chunk depends on its own place only.
    firsts = records.select(place.alias("place")).repartitionByRange(n, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place")).select("place")
    found = firsts.agg(F.sort_array(F.collect_list("place"))).collect()[0][0]
    starts = spark.createDataFrame([(found,)], StructType([StructField("_starts", ArrayType(firsts.schema["place"].dataType))]))
    rows = records.crossJoin(F.broadcast(starts)).withColumn("_chunk", count_up_to("_starts", place, len(found))).drop("_starts")
    last = F.max_by(F.col(f"`{value}`"), F.when(F.col(f"`{value}`").isNotNull(), place))
    before = Window.partitionBy("_by").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(F.col(f"`{by}`").alias("_by"), F.col("_chunk")).agg(last.alias("_last"))
    chunks = chunks.select("_by", F.col("_chunk").alias("_of"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    mine = Window.partitionBy(f"`{by}`", "_chunk").orderBy(f"`{order}`").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(chunks, F.col(f"`{by}`").eqNullSafe(F.col("_by")) & (F.col("_chunk") == F.col("_of")))
    return out.withColumn(value, F.coalesce(F.last(F.col(f"`{value}`"), ignorenulls=True).over(mine), F.col("_carried"))).select(records.columns)
