"""One query for each operator of the template engine, over text rendered from the tables, and its SQL.

The SQL always computes from the tables' columns, never from the rendered
text. `v` in a line's SQL is the value that the line renders; value
expressions are SQL that both sides understand.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import inputs as input_functions
from .functions import outputs as output_functions
from .operators.lines import to_lines
from .operators.segment import evenly
from .plans.plan import LITERAL_ROWS, compile_template
from .registry import QUERIES, SQL, dealt, query, table
from .sources.joins import as_of, lookup_join, search_join
from .sources.readers import as_text, lookup_table
from .sources.scratch import shared_dir
from .streaming.stream import stream_frame

# Whole templates ---------------------------------------------------------

LI_FLAT = '<group name="lines">\norder {{ orderkey | to_int }} part {{ partkey | to_int }} qty {{ qty | to_int }} flag {{ flag }}\n</group>'


def number(name: str):
    return F.col(name).cast("bigint").cast("string")


def lineitem_line():
    return F.concat(F.lit("order "), number("l_orderkey"), F.lit(" part "), number("l_partkey"), F.lit(" qty "), number("l_quantity"), F.lit(" flag "), "l_returnflag")


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of text for each line item."""
    t = dealt(spark, sf_dir, "lineitem")
    return t.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("input"), lineitem_line().alias("text"))


@query("flat_records", "SELECT l_returnflag AS flag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = compile_template(LI_FLAT).records(lineitem_lines(spark, sf_dir))
    return records.groupBy("flag").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"), F.sum("partkey").alias("parts"))


def customer_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stanza of up to three lines for each customer, one text a nation."""
    t = table(spark, sf_dir, "customer")
    stanza = F.concat_ws("\n", F.format_string("customer %d", "c_custkey"), F.format_string(" segment %s", "c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.format_string(" balance %d", F.floor("c_acctbal"))), F.lit("!"))
    return t.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", stanza.alias("s")))), lambda x: x["s"]), "\n").alias("text")).select(F.col("c_nationkey").cast("string").alias("input"), "text")


STANZAS = '<group name="customers*">\ncustomer {{ custkey | to_int }}\n segment {{ segment | ORPHRASE }}\n balance {{ balance | to_int }}\n</group>'
_STANZA_SQL = "SELECT c_custkey AS custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS balance FROM customer"


@query("stanza_records", _STANZA_SQL)
def stanza_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_template(STANZAS).records(customer_stanzas(spark, sf_dir)).select("custkey", "segment", "balance")


@query("default_records", "SELECT c_custkey AS custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE -1 END AS balance, 'crm' AS origin FROM customer")
def default_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = STANZAS.replace('<group name="customers*">', '<vars>\nd = {"balance": -1}\n</vars>\n<group name="customers*" default="d">\n{{ origin | set("crm") }}')
    return compile_template(t).records(customer_stanzas(spark, sf_dir)).select("custkey", "segment", "balance", "origin")


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines, one text a customer."""
    lines = evenly(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey").groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit(" line "), x["l_linenumber"].cast("string"), F.lit(" part "), x["l_partkey"].cast("string"))), "\n").alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_custkey", "o_orderkey", F.concat_ws("\n", F.concat(F.lit("order "), number("o_orderkey"), F.lit(" status "), "o_orderstatus"), "lines").alias("s"))
    return evenly(orders, "o_custkey").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "s"))), lambda x: x["s"]), "\n").alias("text")).select(F.col("o_custkey").cast("string").alias("input"), "text")


TREE = '<group name="orders*">\norder {{ orderkey | to_int }} status {{ status }}\n<group name="lines*">\n line {{ line | to_int }} part {{ part | to_int }}\n</group>\n</group>'


@query("nested_groups", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderstatus AS status, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = compile_template(TREE).records(order_trees(spark, sf_dir))
    return r.select(F.col("input").cast("bigint").alias("custkey"), "orderkey", "status", F.explode_outer("lines").alias("l")).select("custkey", "orderkey", "status", "l.line", "l.part")


@query("itemize_parts", "SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders")
def itemize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="orders*" itemize="orderkey">\norder {{ orderkey | to_int }} status {{ status }}\n</group>'
    r = compile_template(t).results(order_trees(spark, sf_dir))
    return r.select(F.col("input").cast("bigint").alias("custkey"), F.explode(F.from_json("result", "orders array<bigint>")["orders"]).alias("orderkey"))


@query("result_tree", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderstatus AS status FROM orders")
def result_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="by.{{ orderkey }}">\norder {{ orderkey }} status {{ status }}\n</group>'
    r = compile_template(t).results(order_trees(spark, sf_dir))
    return r.select(F.col("input").cast("bigint").alias("custkey"), F.explode(F.from_json("result", "by map<string, struct<status: string>>")["by"]).alias("k", "v")).select("custkey", F.col("k").cast("bigint").alias("orderkey"), "v.status")


@query("join_matches", "SELECT l_orderkey AS orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def join_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="o">\norder {{ orderkey | to_int }} status {{ status }}\n line {{ ignore }} part {{ parts | joinmatches(",") }}\n</group>'
    return compile_template(t).records(order_trees(spark, sf_dir)).where("parts is not null").select("orderkey", "parts")


@query("join_matches_list", "SELECT l_orderkey AS orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def join_matches_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="o">\norder {{ orderkey | to_int }} status {{ status }}\n line {{ ignore }} part {{ parts | to_list | joinmatches }}\n</group>'
    r = compile_template(t).records(order_trees(spark, sf_dir)).where("parts is not null")
    return r.select("orderkey", F.size("parts").cast("bigint").alias("n"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("total"))


@query("start_end_blocks", "SELECT o_orderkey AS orderkey, (SELECT CAST(min(l_partkey) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey)) AS part FROM orders")
def start_end_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = order_trees(spark, sf_dir).withColumn("text", F.concat(F.regexp_replace("text", r"(?m)^order (\d+) status \w+$", "end\n line 0 part 0\nbegin $1"), F.lit("\nend")))
    t = '<group name="o">\nbegin {{ orderkey | _start_ | to_int }}\n line {{ ignore }} part {{ part | to_int }}\nend {{ _end_ }}\n</group>'
    return compile_template(t).records(text).select("orderkey", "part")


@query("start_markers", "SELECT o_orderkey AS orderkey, o_orderstatus AS status, (SELECT count(*) > 0 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines FROM orders")
def start_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="o">\norder {{ orderkey | to_int }} status {{ status }} {{ _start_ }}\n line {{ line }} part {{ part }}\n</group>'
    return compile_template(t).records(order_trees(spark, sf_dir)).select("orderkey", "status", F.col("line").isNotNull().alias("has_lines"))


@query("table_method", "SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part FROM lineitem")
def table_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table; each keeps the order recorded before it."""
    t = '<group name="t*" method="table" set="\'orderkey\'">\norder {{ o | to_int | record("orderkey") }} status {{ s }}\n line {{ line | to_int }} part {{ part | to_int }}\n</group>'
    r = compile_template(t).records(order_trees(spark, sf_dir)).where("line is not null")
    return r.select(F.col("orderkey").cast("bigint").alias("orderkey"), "line", "part")


@query("group_alternatives", "SELECT 'order' AS kind, o_orderkey AS number FROM orders UNION ALL SELECT 'line', l_partkey FROM lineitem")
def group_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="x*">\n{{ kind | set("order") }}\norder {{ number | to_int }} status {{ ignore }}\n</group>\n<group name="x*">\n{{ kind | set("line") }}\n line {{ ignore }} part {{ number | to_int }}\n</group>'
    return compile_template(t).records(order_trees(spark, sf_dir), "x").select("kind", "number")


@query("group_by_value", "SELECT o_custkey AS custkey, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="o" record="status">\norder {{ orderkey | to_int }} status {{ status }}\n</group>'
    r = compile_template(t).records(order_trees(spark, sf_dir))
    return r.select(F.col("input").cast("bigint").alias("custkey"), "status", F.size("orderkey").cast("bigint").alias("n"))


@query("braces_in_text", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def braces_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dealt(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("input"), F.col("props").alias("text"))
    return compile_template('<group name="e">\n{"k": {{ k | DIGIT | to_int }}}\n</group>').records(t).select(F.col("input").cast("bigint").alias("event_id"), "k")


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    one = F.concat(F.col("role"), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("s")))), lambda x: x["s"]), "\n").alias("text")).select(F.col("conv_id").cast("string").alias("input"), "text")


@query("dialog_lines", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n FROM (SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant', 'system')) GROUP BY 1")
def dialog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="d*">\n{{ role | re("(user|assistant|system)") }}: {{ ignore(".*") }}\n</group>'
    r = compile_template(t).group_records(dialogs(spark, sf_dir), compile_template(t).groups[0])[0]
    return r.groupBy("input").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("n")).select(F.col("input").cast("bigint").alias("conv_id"), "roles", "n")


@query("document_lines", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("input"), "text")
    return to_lines(t).groupBy("input").agg(F.count("*").alias("n")).select(F.col("input").cast("bigint").alias("doc_id"), "n")


@query("macro_records", "SELECT c_custkey AS custkey, length(c_mktsegment) > 8 AS long, lower(substr(c_mktsegment, 1, 2)) AS short FROM customer WHERE c_custkey % 5 <> 0")
def macro_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = """<macro>
def short(x):
    return x[:2].lower()

def mark(r):
    if int(r["custkey"]) % 5 == 0:
        return False
    r["long"] = len(r["segment"]) > 8
    return r
</macro>
<group name="c" macro="mark" fields="long boolean">
customer {{ custkey | to_int }} {{ segment }} {{ short | macro("short") }}
</group>"""
    c = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.format_string("customer %d %s %s", "c_custkey", "c_mktsegment", "c_mktsegment").alias("text"))
    return compile_template(t).records(c).select("custkey", "long", "short")


@query("lineage_spans", "SELECT c_custkey AS custkey, CAST(9 AS INTEGER) AS start, CAST(9 + length(CAST(c_custkey AS VARCHAR)) AS INTEGER) AS stop FROM customer")
def lineage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.format_string("customer %d", "c_custkey").alias("text"))
    r = compile_template('<group name="c">\ncustomer {{ n }}\n</group>').lineage(c)
    return r.select(F.col("input").cast("bigint").alias("custkey"), F.col("spans")["n"]["start"].alias("start"), F.col("spans")["n"]["stop"].alias("stop"))


def as_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, dealt out like a batch; a stream reads folders, so the file is picked by its name."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parqu*").repartition(spark.sparkContext.defaultParallelism)


def streamed(df: DataFrame, name: str, **trigger) -> DataFrame:
    """What a stream writes to files until its source is read, read back. State with a timeout takes `once`, as it never runs out of batches."""
    path = f"{shared_dir(df.sparkSession)}/textplan/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(**trigger or {"availableNow": True}).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("stream_parity", "SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_returnflag AS flag FROM lineitem")
def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat template over a file stream, written to files."""
    texts = as_stream(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("input"), lineitem_line().alias("text"))
    lines = to_lines(texts).drop("key")
    return streamed(stream_frame(compile_template(LI_FLAT), lines).select("orderkey", "partkey", "flag"), "stream-parity")


@query("stream_stanzas", "SELECT c_custkey AS custkey, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_custkey % 3 = 0")
def stream_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several lines from a stream: state holds the open record, then group functions filter and convert.

    Each stanza is followed by the start of one without a segment, so that what stays open in state is nothing that counts.
    """
    c = as_stream(spark, sf_dir, "customer").withColumn("input", F.col("c_nationkey").cast("string"))
    stanza = F.array(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.concat(F.lit(" nation "), F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" segment "), "c_mktsegment")), F.lit("!"), F.lit("customer 0"))
    lines = c.select("input", F.posexplode(stanza).alias("n", "line"), "c_custkey").where("line is not null").select("input", (F.col("c_custkey") * 5 + F.col("n")).alias("line_no"), "line")
    t = '<group name="c*" contains="segment" functions="to_int(\'nation\')">\ncustomer {{ custkey | _start_ | to_int }}\n nation {{ nation }}\n segment {{ segment | ORPHRASE }}\n! {{ _end_ }}\n</group>'
    return streamed(stream_frame(compile_template(t), lines, timeout="1 hour"), "stream-stanzas", once=True).select("custkey", "segment", "nation")


# Lookups, inputs, outputs -------------------------------------------------

CUSTOMER = "customer {{ custkey | to_int }} "


def customer_lines(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat(F.format_string("customer %d ", "c_custkey"), F.expr(value)).alias("text"))


def nations(spark: SparkSession, sf_dir: str) -> dict[str, Any]:
    rows = table(spark, sf_dir, "nation").limit(LITERAL_ROWS + 1).collect()
    if len(rows) > LITERAL_ROWS:
        raise ValueError(f"nation has more than {LITERAL_ROWS} rows; join it with lookup_join")
    return {str(r.n_nationkey): {"name": r.n_name, "region": str(r.n_regionkey)} for r in rows}


@query("lookup_rows", "SELECT c_custkey AS custkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compile_template(f'<group name="c">\n{CUSTOMER}{{{{ n | lookup("nation", add_field="row") }}}}\n</group>', lookups={"nation": nations(spark, sf_dir)})
    return p.records(customer_lines(spark, sf_dir, "cast(c_nationkey as string)")).select("custkey", "row.name", "row.region")


@query("lookup_values", "SELECT c_custkey AS custkey, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey")
def lookup_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compile_template(f'<group name="c">\n{CUSTOMER}{{{{ n | lookup("nation") }}}}\n</group>', lookups={"nation": {k: r["name"] for k, r in nations(spark, sf_dir).items()}})
    return p.records(customer_lines(spark, sf_dir, "cast(c_nationkey as string)")).select("custkey", "n")


@query("lookup_table_join", "SELECT o_orderkey AS orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def lookup_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dealt(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("input"), F.format_string("order %d of %d", "o_orderkey", "o_custkey").alias("text"))
    r = compile_template('<group name="o">\norder {{ orderkey | to_int }} of {{ cust }}\n</group>').records(o)
    return lookup_join(r, "cust", lookup_table(table(spark, sf_dir, "customer"), "c_custkey", "c_name"), "name").select("orderkey", "name")


@query("lookup_many_values", "SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def lookup_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("input"), F.format_string("region %d", "r_regionkey").alias("text"))
    r = compile_template('<group name="r">\nregion {{ region | to_int }}\n</group>').records(r)
    many = lookup_table(table(spark, sf_dir, "nation"), "n_regionkey", "n_name", many=True)
    return lookup_join(r, "region", many, "names").select(F.col("region").cast("int").alias("region"), F.array_join("names", ",").alias("names"))


_SEGMENTS = {"AUTO*": "car", "BUILD": "house", "MACH*Y": "tool"}


@query("reverse_lookup", "SELECT c_custkey AS custkey, CASE WHEN c_mktsegment LIKE 'AUTO%' THEN 'AUTO*' WHEN c_mktsegment LIKE '%BUILD%' THEN 'BUILD' WHEN c_mktsegment LIKE 'MACH%Y' THEN 'MACH*Y' ELSE c_mktsegment END AS s FROM customer")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compile_template(f'<group name="c">\n{CUSTOMER}{{{{ s | rlookup("segments") }}}}\n</group>', lookups={"segments": _SEGMENTS})
    return p.records(customer_lines(spark, sf_dir, "c_mktsegment")).select("custkey", "s")


@query("reverse_lookup_join", "SELECT c_custkey AS custkey, CASE WHEN c_mktsegment LIKE 'AUTO%' THEN 'car' WHEN c_mktsegment LIKE '%BUILD%' THEN 'house' WHEN c_mktsegment LIKE 'MACH%Y' THEN 'tool' END AS kind FROM customer")
def reverse_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = compile_template(f'<group name="c">\n{CUSTOMER}{{{{ s }}}}\n</group>').records(customer_lines(spark, sf_dir, "c_mktsegment"))
    keys = spark.createDataFrame(list(_SEGMENTS.items()), "key string, value string")
    return search_join(r, "s", keys, "kind").select("custkey", "kind")


@query("pattern_lookup", "SELECT c_custkey AS custkey, (SELECT min(n_name) FROM nation WHERE n_name LIKE '%' || CAST(c_nationkey AS VARCHAR) AND n_name IS NOT NULL) AS n FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_name LIKE '%' || CAST(c_nationkey AS VARCHAR))")
def pattern_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = {r["name"]: r["name"] for r in nations(spark, sf_dir).values()}
    p = compile_template(f'<group name="c">\n{CUSTOMER}{{{{ n | prepend("*") | gpvlookup("names") }}}}\n</group>', lookups={"names": by_name})
    return p.records(customer_lines(spark, sf_dir, "cast(c_nationkey as string)")).where("not startswith(n, '*')").select("custkey", "n")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each event, one text for each user: every tenth event gives a mark first."""
    e = table(spark, sf_dir, "events")
    line = F.concat_ws("\n", F.when(F.col("event_id") % 10 == 0, F.format_string("mark %d", "event_id")), F.format_string("event %d", "event_id"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("s")))), lambda x: x["s"]), "\n").alias("text")).select(F.col("user_id").cast("string").alias("input"), "text")


@query("recorded_values", "SELECT event_id, coalesce(CAST(max(CASE WHEN event_id % 10 = 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR), 'none') AS mark FROM events")
def recorded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What record() leaves for later lines of an input, taken up by set()."""
    t = '<group name="e*" method="table" functions="set(\'last\', \'mark\', default=\'none\')">\nmark {{ m | record("last") | void }}\nevent {{ event_id | to_int }}\n</group>'
    r = compile_template(t).records(event_lines(spark, sf_dir)).where("event_id is not null")
    return r.select("event_id", "mark")


@query("recorded_values_all", "SELECT event_id, max(CASE WHEN event_id % 10 = 0 THEN event_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mark FROM events")
def recorded_values_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An as-of value over one input of all events, in chunks."""
    e = dealt(spark, sf_dir, "events").select(F.lit("all").alias("input"), "event_id", F.expr("case when event_id % 10 = 0 then event_id end").alias("mark"))
    return as_of(e, "event_id", "mark").select("event_id", "mark")


@query("extract_commands", "SELECT c_custkey AS custkey, 'seg ' || c_mktsegment AS out FROM customer")
def extract_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat(F.lit("r1#show clock\n12:00\nr1#show seg\nseg "), "c_mktsegment", F.lit("\nr1#exit")).alias("text"))
    return c.select(F.col("input").cast("bigint").alias("custkey"), F.regexp_replace(input_functions.extract_commands(F.col("text"), "show seg"), r"\n+$", "").alias("out"))


@query("prompt_hostname", "SELECT c_custkey AS custkey, 'r' || CAST(c_custkey AS VARCHAR) AS host FROM customer")
def prompt_hostname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_lines(spark, sf_dir, "'x\nr' || c_custkey || '#show'").select(F.col("input").cast("bigint").alias("custkey"), input_functions.hostname(F.col("text")).alias("host"))


@query("output_table", "SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment, coalesce(CASE WHEN c_custkey % 3 = 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END, '-') AS balance FROM customer")
def output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_functions.table(stanza_records(spark, sf_dir), missing="-")


@query("output_csv", "SELECT CAST(n_nationkey AS VARCHAR) || ',' || n_name || ',' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def output_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("output_graph", "SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION SELECT 'region ' || CAST(n_regionkey AS VARCHAR) FROM nation")
def output_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.format_string("region %d", "n_regionkey").alias("b"))
    return output_functions.graph_frames(n, "a", "b")[0]


@query("output_traverse", "SELECT o_orderkey AS orderkey FROM orders")
def output_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = compile_template(TREE).records(order_trees(spark, sf_dir)).select(F.struct(F.struct("orderkey").alias("b")).alias("a"))
    return r.select(output_functions.traverse_column(F.col("a"), "b.orderkey").alias("orderkey"))


@query("output_dict_to_list", "SELECT n_regionkey AS region, n_name AS key, n_nationkey AS value FROM nation")
def output_dict_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select(F.col("n_regionkey").alias("region"), F.explode(output_functions.entries_to_list(F.col("m"))).alias("e")).select("region", "e.key", "e.value")


# Group functions ----------------------------------------------------------

_GROUP_SQL = "SELECT c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS d, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS m FROM customer"


def _group_query(name: str, tag: str, sql: str, fields: list[str], select: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = dealt(spark, sf_dir, "customer")
        text = t.select(F.col("c_custkey").cast("string").alias("input"), F.concat_ws("\n", F.format_string("n %d", "c_custkey"), F.when(F.col("c_custkey") % 3 == 0, F.format_string(" d %s", "c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.format_string(" m %d", "c_nationkey"))).alias("text"))
        variables = {"seg": "BUILDING", "rules": {"m": {"required": True, "type": "integer", "max": 10}, "d": {"allowed": ["BUILDING", "MACHINERY"]}}}
        plan = compile_template(f'<group name="g" {tag}>\nn {{{{ n | to_int }}}}\n d {{{{ d }}}}\n m {{{{ m }}}}\n</group>', variables=variables)
        return plan.records(text).selectExpr(*(select or fields))

    query(name, sql.format(base=f"({_GROUP_SQL})"))(run)


for _name, _tag, _where in [
    ("contains", 'contains="d"', "d IS NOT NULL"),
    ("contains_any", 'contains="d, m"', "d IS NOT NULL OR m IS NOT NULL"),
    ("containsall", 'containsall="d, m"', "d IS NOT NULL AND m IS NOT NULL"),
    ("exclude", 'exclude="d"', "d IS NULL"),
    ("excludeall", 'excludeall="d, m"', "NOT (d IS NOT NULL AND m IS NOT NULL)"),
    ("equal", "equal=\"d, 'BUILDING'\"", "d = 'BUILDING'"),
    ("contains_val", "contains_val=\"d, 'ILD'\"", "d LIKE '%ILD%'"),
    ("contains_val_var", "functions=\"contains_val('d', 'seg')\"", "d LIKE '%BUILDING%'"),
    ("exclude_val", "exclude_val=\"d, 'ILD'\"", "d IS NULL OR d NOT LIKE '%ILD%'"),
    ("chain", "functions=\"contains('d') | exclude('m')\"", "d IS NOT NULL AND m IS NULL"),
    ("cerberus", "functions=\"cerberus('rules')\"", "m IS NOT NULL AND CAST(m AS BIGINT) <= 10 AND (d IS NULL OR d IN ('BUILDING', 'MACHINERY'))"),
    ("to_ip", "functions=\"to_ip('m')\"", "true"),
]:
    _group_query(f"group_{_name}", _tag, f"SELECT n, d, m FROM {{base}} WHERE {_where}", ["n", "d", "m"])
for _name, _tag, _select, _fields in [
    ("to_int", "functions=\"to_int('m')\"", "n, d, CAST(m AS BIGINT) AS m", ["n", "d", "m"]),
    ("delete", "functions=\"delete('d')\"", "n, m", ["n", "m"]),
    ("del", 'del="m"', "n, d", ["n", "d"]),
    ("set", "functions=\"set('seg', 'd2') | set('nothing', 'x', default='y')\"", "n, 'BUILDING' AS d2, 'y' AS x", ["n", "d2", "x"]),
    ("record", "functions=\"record('m', 'kept') | set('kept', 'x')\"", "n, coalesce(m, 'kept') AS x", ["n", "x"]),
    ("sformat", "functions=\"sformat('{n}/{seg}', 'id')\"", "n, CAST(n AS VARCHAR) || '/BUILDING' AS id", ["n", "id"]),
]:
    _group_query(f"group_{_name}", _tag, f"SELECT {_select} FROM {{base}}", _fields)


_OK = "m IS NOT NULL AND CAST(m AS BIGINT) <= 10 AND (d IS NULL OR d IN ('BUILDING', 'MACHINERY'))"
_group_query("group_validate", "functions=\"validate('rules')\"", f"SELECT n, {_OK} AS ok FROM {{base}}", ["n"], ["n", "`_validation_valid_` as ok"])


@query("group_items2dict", "SELECT c_custkey AS n, c_mktsegment AS k, c_name AS v FROM customer")
def group_items2dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="g" functions="items2dict(\'k\', \'v\')">\ncustomer {{ n | to_int }} {{ k }} {{ v }}\n</group>'
    r = compile_template(t).records(customer_lines(spark, sf_dir, "c_mktsegment || ' ' || c_name"))
    return r.select("n", F.explode("items").alias("k", "v"))


@query("group_expand", "SELECT c_custkey AS n, c_mktsegment AS b, c_name AS c FROM customer")
def group_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="g" functions="expand()">\ncustomer {{ n | to_int }} {{ a.b }} {{ a.x.c }}\n</group>'
    return compile_template(t).records(customer_lines(spark, sf_dir, "c_mktsegment || ' ' || c_name")).select("n", "a.b", "a.x.c")


# Match functions ----------------------------------------------------------

_IP = "'10.' || CAST(c_custkey % 250 AS STRING) || '.' || CAST(c_nationkey AS STRING) || '.7'"
_UP = "CAST(c_custkey % 9 AS STRING) || ' weeks, ' || CAST(c_nationkey AS STRING) || ' days, 3 hours'"
_NUM = "CAST(c_custkey * 7 AS STRING)"
_MAC = "'00' || CAST(10 + c_nationkey AS STRING) || '.ABCD.12' || CAST(10 + c_nationkey AS STRING)"


def _match_query(name: str, calls: str, sql: str, value: str = "c_mktsegment", where: str = "true", line: str = "v {{ x | ORPHRASE%s }}", out: str = "x") -> None:
    """calls: what follows the pipe; sql: the result from v; out: SQL of the record's field x."""
    template = '<group name="g">\n' + line % (f" | {calls}" if calls else "") + "\n</group>"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat(F.lit("v "), F.expr(value)).alias("text"))
        return compile_template(template, variables={"suffix": "ING", "fix": ["append('!')", "lower"]}).records(text).select(F.col("input").cast("bigint").alias("id"), F.expr(out).alias("x"))

    query(f"match_{name}", f"SELECT id, {sql} AS x FROM (SELECT c_custkey AS id, {value.replace('AS STRING', 'AS VARCHAR')} AS v FROM customer) WHERE {where}")(run)


for _n, _c, _w in [
    ("contains", 'contains("ILD", "ACH")', "v LIKE '%ILD%' OR v LIKE '%ACH%'"),
    ("contains_re", 'contains_re("I.D")', "regexp_matches(v, 'I.D')"),
    ("startswith", 'startswith("AUTO")', "v LIKE 'AUTO%'"),
    ("startswith_re", 'startswith_re("[AB]U")', "regexp_matches(v, '^[AB]U')"),
    ("endswith", "endswith(suffix)", "v LIKE '%ING'"),
    ("endswith_re", 'endswith_re("[YE]")', "regexp_matches(v, '[YE]$')"),
    ("notstartswith", 'notstartswith("AUTO")', "v NOT LIKE 'AUTO%'"),
    ("notstartswith_re", 'notstartswith_re("[AB]U")', "NOT regexp_matches(v, '^[AB]U')"),
    ("notendswith", 'notendswith("ING")', "v NOT LIKE '%ING'"),
    ("notendswith_re", 'notendswith_re("[YE]")', "NOT regexp_matches(v, '[YE]$')"),
    ("exclude", 'exclude("ILD")', "v NOT LIKE '%ILD%'"),
    ("exclude_re", 'exclude_re("I.D")', "NOT regexp_matches(v, 'I.D')"),
    ("equal", 'equal("BUILDING")', "v = 'BUILDING'"),
    ("notequal", 'notequal("BUILDING")', "v <> 'BUILDING'"),
]:
    _match_query(_n, _c, "v", where=_w)
for _n, _c, _w, _v in [
    ("isdigit", "isdigit", "regexp_matches(v, '^[0-9]+$')", "CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE CAST(c_custkey AS STRING) END"),
    ("notdigit", "notdigit", "NOT regexp_matches(v, '^[0-9]+$')", "CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE CAST(c_custkey AS STRING) END"),
    ("greaterthan", "greaterthan(500)", "CAST(v AS DOUBLE) > 500", _NUM),
    ("lessthan", "lessthan(500.5)", "CAST(v AS DOUBLE) < 500.5", _NUM),
    ("is_ip", "is_ip", "id % 300 <= 255", "'10.1.1.' || CAST(c_custkey % 300 AS STRING)"),
    ("cidr_match", 'cidr_match("10.64.0.0/11")', "id % 250 BETWEEN 64 AND 95", _IP),
]:
    _match_query(_n, _c, "v", _v, _w)
for _n, _c, _s, _v, _o in [
    ("upper", "lower | upper", "upper(v)", "c_mktsegment", "x"),
    ("lower", "lower", "lower(v)", "c_mktsegment", "x"),
    ("split", 'split("I")', "array_to_string(string_split(v, 'I'), '+')", "c_mktsegment", "array_join(x, '+')"),
    ("join", 'split("I") | join(":")', "replace(v, 'I', ':')", "c_mktsegment", "x"),
    ("replace", 'replace("I", "ii")', "replace(v, 'I', 'ii')", "c_mktsegment", "x"),
    ("ip", "IP", "v", _IP, "x"),
    ("mac_eui", "mac_eui", "lower(substr(b, 1, 2) || ':' || substr(b, 3, 2) || ':' || substr(b, 5, 2) || ':' || substr(b, 7, 2) || ':' || substr(b, 9, 2) || ':' || substr(b, 11, 2))", _MAC, "x"),
    ("count", "count", "CAST(strlen(v) AS BIGINT)", "c_mktsegment", "x"),
    ("set", 'set("fixed")', "'fixed'", "c_mktsegment", "x"),
    ("to", 'to("int")', "CAST(v AS BIGINT)", _NUM, "x"),
    ("to_list", "to_list", "v", "c_mktsegment", "x[0]"),
    ("to_str", "to_int | to_str", "v", _NUM, "x"),
    ("to_int", 'let("k", "1") | to_int', "CASE WHEN id % 2 = 0 THEN NULL ELSE id END", "CASE WHEN c_custkey % 2 = 0 THEN '1.5' ELSE CAST(c_custkey AS STRING) END", "x"),
    ("to_float", "to_float", "CAST(v AS DOUBLE)", "CAST(c_custkey AS STRING) || '.25'", "x"),
    ("to_ip", "to_ip", "v", _IP, "x"),
    ("to_net", "to_net", "CASE WHEN id % 2 = 0 THEN v ELSE v || '/32' END", f"CASE WHEN c_custkey % 2 = 0 THEN {_IP} || '/24' ELSE {_IP} END", "x"),
    ("to_cidr", "to_cidr", "CASE WHEN id % 2 = 0 THEN 22 ELSE 24 END", "CASE WHEN c_custkey % 2 = 0 THEN '255.255.252.0' ELSE '10.0.0.1/24' END", "cast(x as int)"),
    ("to_unicode", "to_unicode", "v", "c_mktsegment", "x"),
    ("item", "item(-1)", "right(v, 1)", "c_mktsegment", "x"),
    ("item_list", 'split("I") | item(0)', "split_part(v, 'I', 1)", "c_mktsegment", "x"),
    ("let", 'let("n", "7")', "7", "c_mktsegment", "cast(n as int)"),
    ("void", 'let("y", "k") | void', "CAST(NULL AS VARCHAR)", "c_mktsegment", "x"),
    ("sformat", 'sformat("<{}>")', "'<' || v || '>'", "c_mktsegment", "x"),
    ("resub", 'resub("I", "_")', "regexp_replace(v, 'I', '_')", "c_mktsegment", "x"),
    ("resub_all", 'resub("[IO]", "_", 0)', "regexp_replace(v, '[IO]', '_', 'g')", "c_mktsegment", "x"),
    ("replaceall", 'replaceall("-", "I", "O")', "replace(replace(v, 'I', '-'), 'O', '-')", "c_mktsegment", "x"),
    ("resuball", 'resuball("-", "[IO]", "U+")', "regexp_replace(regexp_replace(v, '[IO]', '-', 'g'), 'U+', '-', 'g')", "c_mktsegment", "x"),
    ("prepend", 'prepend("p-")', "'p-' || v", "c_mktsegment", "x"),
    ("append", 'append("-s")', "v || '-s'", "c_mktsegment", "x"),
    ("append_list", 'to_list | append("s")', "v || ',s'", "c_mktsegment", "array_join(x, ',')"),
    ("copy", "copy", "v", "c_mktsegment", "x"),
    ("print", "print", "v", "c_mktsegment", "x"),
    ("unrange", 'unrange("-", ",")', "CAST(id AS VARCHAR) || ',7,8,9'", "CAST(c_custkey AS STRING) || ',7-9'", "x"),
    ("uptimeparse", "uptimeparse", "CAST((id % 9) * 604800 + CAST(regexp_extract(v, '([0-9]+) days', 1) AS BIGINT) * 86400 + 10800 AS BIGINT)", _UP, "x"),
    ("uptimeparse_dict", 'uptimeparse(format="dict")', "CAST(id % 9 AS VARCHAR) || ',3'", _UP, "concat_ws(',', x.weeks, x.hours)"),
    ("truncate", "truncate(4)", "substr(v, 1, 4)", "c_mktsegment", "x"),
    ("chain", 'chain("fix")', "lower(v || '!')", "c_mktsegment", "x"),
    ("ip_info", "ip_info", "v || ',4,true,false'", _IP, "concat_ws(',', x.ip, x.version, x.is_private, x.is_loopback)"),
    ("geoip_lookup", 'geoip_lookup("g")', "''", _IP, "g.country"),
    ("word", "WORD", "v", "c_mktsegment", "x"),
    ("record", 'record("r")', "v", "c_mktsegment", "x"),
]:
    _match_query(_n, _c, _s, _v, out=_o)
SQL["match_mac_eui"] = SQL["match_mac_eui"].replace("SELECT c_custkey AS id, ", "SELECT *, replace(v, '.', '') AS b FROM (SELECT c_custkey AS id, ").replace(" FROM customer)", " FROM customer))")
_match_query("strip", "strip", "v", "c_mktsegment", line='v{{ x | re(".*")%s }}')
_match_query("default", "", "CASE WHEN id % 2 = 0 THEN 'none' ELSE v END", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END", line='v{{ x | re(".*") | strip | default("none")%s }}')
for _n, _v in [("digit", _NUM), ("ipv4", _IP), ("prefix", f"{_IP} || '/24'"), ("ipv6", "'fe80:1:2:3:4:5:6:' || CAST(1000 + c_custkey % 9000 AS STRING)"), ("prefixv6", "'fe80:1:2:3:4:5:6:' || CAST(1000 + c_custkey % 9000 AS STRING) || '/64'"), ("mac", _MAC), ("phrase", "c_mktsegment || ' of ' || c_name"), ("row", "c_mktsegment || '   of  ' || c_name"), ("orphrase", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' b' END")]:
    _builtin = {"ipv4": "IP"}.get(_n, _n.upper())
    _match_query(f"builtin_{_n}", "", "v", _v, line="v {{ x | " + _builtin + "%s }}")
_match_query("builtin_re", "", "substr(v, 1, 3)", "c_mktsegment", line='v {{ x | re("(AUT|BUI|MAC|FUR|HOU)") }}{{ ignore(".*") }}%s')
