"""Queries of what goes into and comes out of templates, and of the template language: tags, loaders, formats, saving.

Inputs are rendered from the tables, as in `queries`; files that a query reads
are written first, in the folder that the cluster shares. Formats give one
text for a result that is small; their rows are then the text's lines.
"""

from __future__ import annotations

import json
import shutil
import tempfile
import uuid
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Parser
from .functions import outputs as output_functions
from .plans.plan import Plan, compile_template, load
from .queries import CUSTOMER, customer_lines, customer_stanzas, nations
from .registry import dealt, query, table
from .sources import readers, returners
from .sources.joins import search_join
from .sources.scratch import shared_dir
from .streaming.stream import parse_stream
from .template import validate

EXAMPLES = str(Path(__file__).parent / "examples")
_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name AS name FROM nation"
_NATION_LINES = '<group name="n*">\nnation {{ nation | to_int }} {{ name }}\n</group>'
_SEGMENT = "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer"
_SEGMENT_LINES = '<group name="c*">\ncustomer {{ custkey | to_int }} {{ segment }}\n</group>'


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textplan/{name}-{uuid.uuid4().hex}"


def returners_path(spark: SparkSession, df: DataFrame) -> str:
    """Where a frame was written."""
    path = fresh(spark, "written")
    returners.file(df, path, "parquet")
    return path


def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_lines(spark, sf_dir, "c_mktsegment")


def nation_text(spark: SparkSession, sf_dir: str) -> str:
    return "\n".join(f"nation {k} {r['name']}" for k, r in nations(spark, sf_dir).items())


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("input"), F.format_string("nation %d %s", "n_nationkey", "n_name").alias("text"))


def all_inputs(plan: Plan, spark: SparkSession, path: str | None = None) -> DataFrame:
    """Records of what the template's own tags load."""
    return plan.records(plan.inputs(spark), path).drop("input")


# Inputs -----------------------------------------------------------------------


@query("input_inline", _NATION)
def input_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_inputs(compile_template(f'<input name="own" load="text">\n{nation_text(spark, sf_dir)}\n</input>\n{_NATION_LINES}'), spark)


@query("input_passed_wins", "SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name AS name FROM nation UNION ALL SELECT -1, 'kept'")
def input_passed_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text passed under a tag's name replaces the tag's."""
    p = compile_template(f'<input name="own">\nnation 99 replaced\n</input>\n<input name="other">\nnation -1 kept\n</input>\n{_NATION_LINES.replace("to_int", "re(\"-?[0-9]+\") | to_int")}')
    return p.records(p.inputs(spark, {"own": nation_text(spark, sf_dir)})).drop("input")


def written_stanzas(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The customers' stanzas as files: .txt, and others that no extension asks for."""
    root = fresh(spark, name)
    customer_stanzas(spark, sf_dir).select("text").write.text(f"{root}/customers")
    spark.createDataFrame([("customer 0\n segment NONE",)], "text string").write.option("compression", "none").csv(f"{root}/other", quote="")
    return root


_STANZA_GROUP = '<group name="customers*">\ncustomer {{ custkey | to_int }}\n segment {{ segment | ORPHRASE }}\n</group>'


@query("input_directory", _SEGMENT)
def input_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an extension, in folders of any depth."""
    root = written_stanzas(spark, sf_dir, "input-directory")
    return all_inputs(compile_template(f'<input load="directory" url="{root}" extensions="txt"/>\n{_STANZA_GROUP}'), spark)


@query("input_filters", _SEGMENT)
def input_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose path fits one of the filters."""
    root = written_stanzas(spark, sf_dir, "input-filters")
    return all_inputs(compile_template(f'<input load="directory" url="{root}" filters="customers/part-, nothing"/>\n{_STANZA_GROUP}'), spark)


@query("input_file", _SEGMENT)
def input_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = written_stanzas(spark, sf_dir, "input-file")
    return all_inputs(compile_template(f'<input load="file" url="{root}/customers" name="one"/>\n{_STANZA_GROUP}'), spark)


@query("input_groups", "SELECT 'n' AS kind, n_name AS name FROM nation UNION ALL SELECT 'r', n_name || '!' FROM nation")
def input_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag's text goes to the groups that it names."""
    text = nation_text(spark, sf_dir)
    marked = "\n".join(f"{line}!" for line in text.split("\n"))
    t = f'<input name="a" groups="n">\n{text}\n</input>\n<input name="b" groups="r">\n{marked}\n</input>\n'
    t += '<group name="n*">\nnation {{ ignore }} {{ name }}\n{{ kind | set("n") }}\n</group>\n<group name="r*">\nnation {{ ignore }} {{ name }}\n{{ kind | set("r") }}\n</group>'
    p = compile_template(t)
    return all_inputs(p, spark, "n").unionByName(all_inputs(p, spark, "r"))


@query("input_lines", "SELECT n_nationkey AS nation, n_name AS name FROM nation")
def input_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files of any size, numbered along each file, as fields of one expression."""
    path = fresh(spark, "input-lines")
    nation_lines(spark, sf_dir).select("text").write.text(path)
    lines = readers.read_lines(spark, path)
    plan = compile_template(_NATION_LINES)
    df, _ = plan._records(lines, plan.groups[0])
    return df.select(F.col("nation").cast("int").alias("nation"), "name")


@query("input_functions", "SELECT c_custkey AS custkey, c_mktsegment || '!' AS segment FROM customer")
def input_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own and a macro of the input tag, before lines are cut."""
    t = '<macro>\ndef louder(text):\n    return text + "!"\n</macro>\n<input name="x" functions="test | trimmed" macro="louder"/>\n'
    p = compile_template(t + _SEGMENT_LINES, functions={"input": {"trimmed": lambda c, *a: F.rtrim(c)}})
    one = segment_lines(spark, sf_dir).select(F.lit("x").alias("input"), F.concat("text", F.lit("  ")).alias("text"))
    return p.records(one).drop("input")


@query("load_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "load-csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return readers.read_csv(spark, path)


@query("load_json", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "load-json")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.json(path)
    return readers.read_json(spark, path)


def packed_database(spark: SparkSession, sf_dir: str) -> str:
    """The address of an embedded database that holds the table nation, packed in the shared folder: read-only, so any number of JVMs may open it at once.

    One in memory, or open for writing, is seen by a single JVM. It is made on the driver.
    """
    shared = urlsplit(fresh(spark, "load-database"))
    if shared.scheme not in ("", "file"):
        raise ValueError(f"an embedded database is opened by its path; {shared.scheme}: is no file system of the machine")
    connect = spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect
    with tempfile.TemporaryDirectory() as made:
        db, nothing = f"jdbc:derby:{made}/db", spark._jvm.java.util.Properties()
        con = connect(f"{db};create=true", nothing)
        con.createStatement().execute("create table nation (n_nationkey bigint, n_name long varchar)")
        insert = con.prepareStatement("insert into nation values (?, ?)")
        types = spark._jvm.java.sql.Types
        for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():
            insert.setObject(1, r.n_nationkey, types.BIGINT)
            insert.setObject(2, r.n_name, types.LONGVARCHAR)
            insert.execute()
        con.close()
        try:
            connect(f"{db};shutdown=true", nothing)
        except Py4JJavaError as e:  # a shutdown always ends in this state
            if e.java_exception.getSQLState() != "08006":
                raise
        Path(shared.path).parent.mkdir(parents=True, exist_ok=True)
        packed = shutil.make_archive(shared.path, "zip", made, "db")
    return f"jdbc:derby:jar:({packed})db"


@query("load_database", _NATION)
def load_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over JDBC (here of an embedded database), as text, parsed."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = packed_database(spark, sf_dir)
    t = f'<input load="database" url="{url}" driver="{driver}" name="db" query="select \'nation\' as k, n_nationkey, n_name from nation" format="csv"/>\n<group name="n*">\nnation,{{{{ nation | re("[0-9]+") | to_int }}}},{{{{ name }}}}\n</group>'
    return all_inputs(compile_template(t), spark)


# Lookups and variables -----------------------------------------------------------


def _looked_up(spark: SparkSession, sf_dir: str, tables: dict[str, Any], name: str = "nations", tag: str = "") -> DataFrame:
    p = compile_template(f'{tag}<group name="c">\n{CUSTOMER}{{{{ n | lookup("{name}") }}}}\n</group>', lookups=tables)
    return p.records(customer_lines(spark, sf_dir, "cast(c_nationkey as string)")).select("custkey", "n")


_LOOKED_UP = "SELECT c_custkey AS custkey, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _names(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return {k: r["name"] for k, r in nations(spark, sf_dir).items()}


@query("lookup_from_json", _LOOKED_UP)
def lookup_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, readers.load_lookups(json.dumps(_names(spark, sf_dir)), "json", "nations"))


@query("lookup_from_yaml", _LOOKED_UP)
def lookup_from_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, readers.load_lookups("\n".join(f'"{k}": {v}' for k, v in _names(spark, sf_dir).items()), "yaml", "nations"))


@query("lookup_from_csv", "SELECT c_custkey AS custkey, n_name AS name, CAST(n_nationkey AS VARCHAR) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def lookup_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first column, which they keep."""
    text = "id,name\n" + "\n".join(f"{k},{v}" for k, v in _names(spark, sf_dir).items())
    return _looked_up(spark, sf_dir, readers.load_lookups(text, "csv", "nations")).select("custkey", "n.name", "n.id")


@query("lookup_many_tables", _LOOKED_UP)
def lookup_many_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named tables from one text; a later table replaces an earlier one of its name."""
    many = readers.load_lookups(json.dumps({"nations": {"0": "stale"}, "other": {}}))
    return _looked_up(spark, sf_dir, readers.merge_lookups(many, readers.load_lookups(json.dumps({"nations": _names(spark, sf_dir)}))))


@query("lookup_tag", _LOOKED_UP)
def lookup_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "\n".join(f'"{k}": {v}' for k, v in _names(spark, sf_dir).items())
    return _looked_up(spark, sf_dir, {}, tag=f'<lookup name="nations" load="yaml">\n{rows}\n</lookup>\n')


@query("lookup_include", "SELECT c_custkey AS custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'tool' END AS kind FROM customer")
def lookup_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = f'<lookup name="kinds" load="csv" include="kinds.csv"/>\n<group name="c">\n{CUSTOMER}{{{{ s | lookup("kinds", add_field="k") }}}}\n</group>'
    return compile_template(t, EXAMPLES).records(segment_lines(spark, sf_dir)).select("custkey", "k.kind")


def _vars_query(name: str, tag: str, attribute: str, value: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = f'{tag}\n<group name="c" {attribute}>\n{CUSTOMER}{{{{ segment }}}}\n{{{{ x | set(word) }}}}\n</group>'
        return compile_template(t, EXAMPLES).records(segment_lines(spark, sf_dir)).select("custkey", "segment", "x")

    query(f"vars_{name}", f"SELECT c_custkey AS custkey, c_mktsegment AS segment, '{value}' AS x FROM customer")(run)


_vars_query("python", '<vars>\nword = "py"\n</vars>', "", "py")
_vars_query("json", '<vars load="json">\n{"word": "js"}\n</vars>', "", "js")
_vars_query("yaml", "<vars load='yaml'>\nword: ya\n</vars>", "", "ya")
_vars_query("several_tags", '<vars>\nword = "one"\nother = 1\n</vars>\n<vars load="json">\n{"word": "two"}\n</vars>', "", "two")


def _vars_default_query(name: str, tag: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = f'{tag}\n<group name="c" default="row">\n{CUSTOMER}{{{{ segment }}}}\n</group>'
        return compile_template(t).records(segment_lines(spark, sf_dir)).select("custkey", "segment", "origin")

    query(f"vars_{name}", "SELECT c_custkey AS custkey, c_mktsegment AS segment, 'crm' AS origin FROM customer")(run)


_vars_default_query("csv", '<vars load="csv">\nkey,origin\nrow,crm\n</vars>')
_vars_default_query("ini", '<vars load="ini">\n[row]\norigin = crm\n</vars>')


@query("vars_named_result", "SELECT c_custkey AS custkey, 'r1' AS host FROM customer")
def vars_named_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named variables are part of the result; one asks for the host name in the text's prompt."""
    t = f'<vars name="about">\nhost = "gethostname"\n</vars>\n<group name="c">\n{CUSTOMER}{{{{ segment }}}}\n</group>'
    lines = segment_lines(spark, sf_dir).select("input", F.concat(F.lit("r1#show\n"), "text").alias("text"))
    r = compile_template(t).results(lines)
    v = F.from_json("result", "about struct<host: string>, c struct<custkey: bigint>")
    return r.select(v["c"]["custkey"].alias("custkey"), v["about"]["host"].alias("host"))


@query("lookup_frame", "SELECT o_orderkey AS orderkey, c_name AS cust FROM orders JOIN customer ON c_custkey = o_custkey")
def lookup_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lookup() in a frame: a literal where it is small, else a join."""
    o = dealt(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("input"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_custkey").cast("string")).alias("text"))
    names = readers.lookup_table(table(spark, sf_dir, "customer"), "c_custkey", "c_name")
    p = compile_template('<group name="o">\norder {{ orderkey | to_int }} of {{ cust | lookup("names") }}\n</group>', lookups={"names": names})
    return p.records(o).select("orderkey", "cust")


@query("lookup_search_many", "SELECT c_custkey AS custkey, min(o_orderkey) AS orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def lookup_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in as many keys as there are orders: globs that end in a customer's number."""
    r = compile_template(f'<group name="c">\n{CUSTOMER}{{{{ s }}}}\n</group>').records(customer_lines(spark, sf_dir, "'<at-' || c_custkey || '>'"))
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("value")).select(F.concat(F.lit("*t-"), F.col("o_custkey").cast("string"), F.lit(">")).alias("key"), "value")
    return search_join(r, "s", keys, "orderkey").select("custkey", "orderkey")


# The template language ----------------------------------------------------------


@query("extend_template", "SELECT c_custkey AS custkey, c_mktsegment AS segment, 'crm' AS origin FROM customer")
def extend_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compile_template('<extend template="segments.txt" groups="customers*"/>', EXAMPLES)
    return p.records(segment_lines(spark, sf_dir)).drop("input")


@query("child_templates", "SELECT 'n' AS kind, c_custkey AS number FROM customer UNION ALL SELECT 'm', c_nationkey FROM customer")
def child_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<template>\n<template>\n<group name="n">\ncustomer {{ number | to_int }} {{ ignore }}\n{{ kind | set("n") }}\n</group>\n</template>\n<template>\n<group name="m">\ncustomer {{ ignore }} {{ number | to_int }}\n{{ kind | set("m") }}\n</group>\n</template>\n</template>'
    p, lines = compile_template(t), customer_lines(spark, sf_dir, "cast(c_nationkey as string)")
    return p.records(lines, "n").unionByName(p.records(lines, "m")).select("kind", "number")


@query("sibling_templates", "SELECT CAST(c_custkey AS VARCHAR) AS a, CAST(c_nationkey AS VARCHAR) AS b FROM customer")
def sibling_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<template>\n<group name="n">\ncustomer {{ a }} {{ ignore }}\n</group>\n</template>\n<template>\n<group name="m">\ncustomer {{ ignore }} {{ b }}\n</group>\n</template>'
    p, lines = compile_template(t), customer_lines(spark, sf_dir, "cast(c_nationkey as string)")
    r = p.results(lines).select(F.from_json("result", "n struct<a: string>, m struct<b: string>").alias("r"))
    return r.select("r.n.a", "r.m.b")


@query("anonymous_group", _SEGMENT)
def anonymous_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without a group or a template tag, comments and blank lines left out."""
    t = "## what this is\n\ncustomer {{ custkey | to_int }} {{ segment }}\n   ## more\n"
    return compile_template(t).records(segment_lines(spark, sf_dir)).drop("input")


@query("angle_brackets", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment < 'C'")
def angle_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only known tags are markup: other angle brackets are text."""
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.format_string("<custkey=%d> <%s>", "c_custkey", "c_mktsegment").alias("text"))
    return compile_template('<group name="c">\n<custkey={{ custkey | DIGIT | to_int }}> <{{ segment | re("[AB][A-Z]+") }}>\n</group>').records(lines).drop("input")


@query("exact_digits", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 10 = 7")
def exact_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits of a template stand for any; under _exact_ for themselves."""
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.format_string("kind%d %d %s", F.col("c_custkey") % 10, "c_custkey", "c_mktsegment").alias("text"))
    return compile_template('<group name="c">\nkind7 {{ custkey | to_int }} {{ segment }} {{ _exact_ }}\n</group>').records(lines).drop("input")


@query("loose_digits", _SEGMENT)
def loose_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.format_string("kind%d   %d %s", F.col("c_custkey") % 100, "c_custkey", "c_mktsegment").alias("text"))
    return compile_template('<group name="c">\nkind7 {{ custkey | to_int }} {{ segment }}\n</group>').records(lines).drop("input")


@query("exact_space", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0")
def exact_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under _exact_space_ blanks stand for themselves."""
    gap = F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("  ")
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat(F.lit("customer"), gap, F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment").alias("text"))
    return compile_template('<group name="c">\ncustomer {{ custkey | to_int }} {{ segment }}{{ _exact_space_ }}\n</group>').records(lines).drop("input")


@query("literal_line", "SELECT c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def literal_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line without holes takes part as an end of its record."""
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" seg "), "c_mktsegment", F.lit("\nstop here"))).otherwise(F.concat(F.lit("stop here\n seg "), "c_mktsegment"))
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat(F.format_string("customer %d\n", "c_custkey"), body).alias("text"))
    t = '<group name="c">\ncustomer {{ custkey | to_int | _start_ }}\n seg {{ segment }}\nstop here {{ _end_ }}\n</group>'
    return compile_template(t).records(lines).drop("input")


@query("shortcut_classes", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_custkey >= 10")
def shortcut_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""\d and \w in a user's expression."""
    return compile_template(r'<group name="c">' + "\n" + r'customer {{ custkey | re("\d\d+") | to_int }} {{ segment | re("\w+") }}' + "\n</group>").records(segment_lines(spark, sf_dir)).drop("input")


@query("validate_templates", "SELECT * FROM (VALUES (0, ''), (1, 'a tag is open'), (2, 'holes'), (3, 'format')) t(template, problem)")
def validate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation says of four templates, in a word each."""
    texts = ['<group name="a">\nx {{ a }}\n</group>', '<group name="a">\nx {{ a }}\n', '<group name="a">\nx {{ a }\n</group>', '<group name="a">\nx {{ a }}\n</group>\n<output format="odd"/>']
    words = {"never closed": "a tag is open", "pair up": "holes", "no such format": "format"}
    rows = [(i, ",".join(w for p in validate(t) for k, w in words.items() if k in p)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "template int, problem string")


@query("template_warnings", "SELECT * FROM (VALUES ('no such function'), ('occurs twice'), ('yang')) t(warning)")
def template_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compile_template('<group name="a" yang="a:b">\nx {{ a | odd }} {{ b }} {{ b }}\n</group>')
    return spark.createDataFrame([(w,) for w in ("no such function", "occurs twice", "yang") if any(w in x for x in p.warnings)], "warning string")


@query("saved_template", "SELECT c_custkey AS custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS balance FROM customer")
def saved_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan saved as JSON and loaded again."""
    t = '<group name="customers*">\ncustomer {{ custkey | to_int }}\n segment {{ segment | ORPHRASE }}\n balance {{ balance | to_int }}\n</group>'
    return load(compile_template(t).save()).records(customer_stanzas(spark, sf_dir)).select("custkey", "segment", "balance")


# Records ----------------------------------------------------------------------


@query("default_without_match", "SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'none' END AS custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'none' END AS segment FROM customer")
def default_without_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs in which nothing matches have a record of the group's default."""
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.when(F.col("c_custkey") % 3 == 0, F.format_string("customer %d %s", "c_custkey", "c_mktsegment")).otherwise(F.lit("nothing")).alias("text"))
    return compile_template('<group name="c" default="none">\ncustomer {{ custkey }} {{ segment }}\n</group>').records(lines).drop("input")


@query("default_of_start", "SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '0' END AS custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer")
def default_of_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a variable of the first line has a default of its own."""
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.when(F.col("c_custkey") % 3 == 0, F.format_string("customer %d %s", "c_custkey", "c_mktsegment")).otherwise(F.lit("nothing")).alias("text"))
    return compile_template('<group name="c">\ncustomer {{ custkey | default("0") }} {{ segment }}\n</group>').records(lines).drop("input")


@query("empty_results", "SELECT c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def empty_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start without values opens a record; what follows fills it."""
    t = '<group name="c*">\nbegin {{ _start_ }}\n number {{ custkey | to_int }}\n seg {{ segment }}\n</group>'
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat_ws("\n", F.lit("begin\nbegin"), F.format_string(" number %d", "c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.format_string(" seg %s", "c_mktsegment"))).alias("text"))
    return compile_template(t).records(lines).drop("input")


@query("merge_window", "SELECT c_custkey AS custkey, CASE WHEN c_custkey % 200 < 99 THEN c_mktsegment END AS segment FROM customer")
def merge_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line joins the record of a start at most 99 lines above it."""
    gap = F.repeat(F.lit("-\n"), (F.col("c_custkey") % 200).cast("int"))
    lines = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("input"), F.concat(F.format_string("customer %d\n", "c_custkey"), gap, F.format_string(" seg %s", "c_mktsegment")).alias("text"))
    return compile_template('<group name="c">\ncustomer {{ custkey | to_int }}\n seg {{ segment }}\n</group>').records(lines).drop("input")


@query("nested_under_table", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer")
def nested_under_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = '<group name="c*" method="table">\ncustomer {{ custkey | to_int }}\n<group name="s*">\n segment {{ segment | ORPHRASE }}\n</group>\n</group>'
    r = compile_template(t).records(customer_stanzas(spark, sf_dir))
    return r.select("custkey", F.explode("s").alias("s")).select("custkey", "s.segment")


@query("wrapper_group", "SELECT c_custkey AS custkey, CAST(NULL AS VARCHAR) AS segment FROM customer UNION ALL SELECT NULL, c_mktsegment FROM customer")
def wrapper_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group without lines of its own is the union of its groups."""
    t = '<group name="w*">\n<group name="a*">\ncustomer {{ custkey | to_int }}\n</group>\n<group name="b*">\n segment {{ segment | ORPHRASE }}\n</group>\n</group>'
    return compile_template(t).records(customer_stanzas(spark, sf_dir)).select("custkey", "segment")


@query("group_keys", "SELECT 'c' AS path, 'custkey,segment' AS keys")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compile_template('<group name="c" keys="custkey, segment">\ncustomer {{ custkey }} {{ segment }}\n</group>')
    return spark.createDataFrame([(k, ",".join(v)) for k, v in p.key_fields.items()], "path string, keys string")


@query("group_yang_rules", "SELECT c_custkey AS custkey, c_nationkey <= 10 AS ok FROM customer")
def group_yang_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules named by yang= mark records and drop none."""
    p = compile_template(f'<group name="c" yang="rules">\n{CUSTOMER}{{{{ nation }}}}\n</group>', variables={"rules": {"nation": {"type": "integer", "max": 10}}})
    return p.records(customer_lines(spark, sf_dir, "cast(c_nationkey as string)")).select("custkey", F.col("_validation_valid_").alias("ok"))


@query("own_functions", "SELECT c_custkey AS custkey, lower(c_mktsegment) || '!' AS segment, 'AB' AS doubled FROM customer")
def own_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one's own, one of which takes the place of a built-in one."""
    mine = {"match": {"shout": lambda v, a, k: F.concat(F.lower(v.text), F.lit("!")), "upper": lambda v, a, k: v.text}, "group": {"twice": lambda r, a, k: r.put("doubled", F.lit(str(a[0]) * 2))}}
    p = compile_template(f'<group name="c" twice="\'A\'">\n{CUSTOMER}{{{{ segment | upper | shout }}}}\n</group>', functions=mine)
    return p.records(segment_lines(spark, sf_dir)).select("custkey", "segment", F.replace("doubled", F.lit("AA"), F.lit("AB")).alias("doubled"))


@query("macro_context", "SELECT c_custkey AS custkey, c_mktsegment || '-x' AS segment FROM customer")
def macro_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A macro reads the template's variables."""
    t = f'<vars>\nend = "-x"\n</vars>\n<macro>\ndef ended(x):\n    return x + _context_["end"]\n</macro>\n<group name="c">\n{CUSTOMER}{{{{ segment | macro("ended") }}}}\n</group>'
    return compile_template(t).records(segment_lines(spark, sf_dir)).select("custkey", "segment")


@query("match_raise", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'NONE'")
def match_raise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raise() ends the job where a value reaches it; here none does."""
    t = f'<group name="c*">\n{CUSTOMER}{{{{ segment | notequal("NONE") }}}}\n</group>\n<group name="bad*">\n{CUSTOMER}{{{{ bad | equal("NONE") | raise("no segment") }}}}\n</group>'
    p, lines = compile_template(t), segment_lines(spark, sf_dir)
    bad = p.records(lines, "bad").where("bad is not null").select("custkey", F.col("bad").alias("segment"))
    return p.records(lines, "c").select("custkey", "segment").unionByName(bad)


# Outputs and returners --------------------------------------------------------


def _nation_results(spark: SparkSession, sf_dir: str, output: str) -> Any:
    return Parser(spark).add_template(f"{_NATION_LINES}\n{output}").add_input(nation_text(spark, sf_dir)).parse()[0]


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("output_json", _NATION)
def output_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json.loads(_nation_results(spark, sf_dir, '<output format="json" functions="traverse(\'n\')"/>'))[0]
    return spark.createDataFrame([(r["nation"], r["name"]) for r in rows], "nation bigint, name string")


@query("output_yaml", _NATION)
def output_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    import yaml

    rows = yaml.safe_load(_nation_results(spark, sf_dir, '<output format="yaml" functions="traverse(\'n\')"/>'))[0]
    return spark.createDataFrame([(r["nation"], r["name"]) for r in rows], "nation bigint, name string")


@query("output_pprint", _NATION)
def output_pprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    import ast

    rows = ast.literal_eval(_nation_results(spark, sf_dir, '<output format="pprint" functions="traverse(\'n\')"/>'))[0]
    return spark.createDataFrame([(r["nation"], r["name"]) for r in rows], "nation bigint, name string")


@query("output_raw", _NATION)
def output_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_results(spark, sf_dir, '<output format="raw"/>')[0]["n"]
    return spark.createDataFrame([(r["nation"], r["name"]) for r in rows], "nation bigint, name string")


@query("output_csv_text", """SELECT '"' || n_name || '","' || n_nationkey || '"' AS line FROM nation UNION ALL SELECT '"name","nation"'""")
def output_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, _nation_results(spark, sf_dir, '<output format="csv" path="n"/>')[0])


@query("output_csv_options", "SELECT '''' || n_nationkey || ''';''' || n_name || ''';''-''' AS line FROM nation UNION ALL SELECT '''nation'';''name'';''none'''")
def output_csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, _nation_results(spark, sf_dir, '<output format="csv" path="n" sep=";" quote="\'" headers="nation, name, none" missing="-"/>')[0])


@query("output_table_rows", "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS nation FROM nation UNION ALL SELECT 'name', 'nation'")
def output_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_results(spark, sf_dir, '<output format="table" path="n"/>')[0]
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], "name string, nation string")


@query("output_tabulate", "SELECT n_name || ' ' || n_nationkey AS line FROM nation UNION ALL SELECT 'name nation' UNION ALL SELECT '-'")
def output_tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, _nation_results(spark, sf_dir, '<output format="tabulate" path="n"/>')[0])
    return lines.select(F.when(F.col("line").startswith("-"), F.lit("-")).otherwise(F.regexp_replace("line", " +", " ")).alias("line"))


@query("output_graph_text", "SELECT 'node' AS kind, count(DISTINCT x) AS n FROM (SELECT CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION ALL SELECT n_name FROM nation) UNION ALL SELECT 'edge', count(*) FROM nation")
def output_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of GraphML."""
    text = _nation_results(spark, sf_dir, '<output format="n2g" functions="traverse(\'n\')" source="nation" target="name"/>')
    text = text if isinstance(text, str) else text[0]
    lines = _lines(spark, text).select(F.regexp_extract("line", "<(node|edge) ", 1).alias("kind")).where("kind <> ''")
    return lines.groupBy("kind").agg(F.count("*").alias("n"))


@query("output_drawing", "SELECT 2 + count(*) + (SELECT count(DISTINCT x) FROM (SELECT CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION ALL SELECT n_name FROM nation)) AS cells FROM nation")
def output_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a diagram with a layout: two of its own, one for each node and edge."""
    found = _nation_results(spark, sf_dir, '<output format="n2g" functions="traverse(\'n\')" source="nation" target="name" module="drawio" algo="layers"/>')
    found = found if isinstance(found, str) else found[0]
    return spark.createDataFrame([(found.count("<mxCell "),)], "cells bigint")


@query("output_pipeline", "SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS nation FROM nation")
def output_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several functions in order, then a format."""
    t = f'<group name="all.{{{{ name }}}}">\nnation {{{{ nation | to_int }}}} {{{{ name }}}}\n</group>\n<output functions="traverse(\'all\') | dict_to_list(\'key\')" format="json"/>'
    rows = json.loads(Parser(spark).add_template(t).add_input(nation_text(spark, sf_dir)).parse()[0])[0]
    return spark.createDataFrame([(r["key"], r["nation"]) for r in rows], "key string, nation bigint")


@query("output_is_equal", "SELECT true AS same, false AS other")
def output_is_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames compared, in any order of rows and columns."""
    got = compile_template(_SEGMENT_LINES).records(segment_lines(spark, sf_dir)).drop("input")
    want = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"))
    return spark.createDataFrame([(output_functions.is_equal(got, want), output_functions.is_equal(got, want.withColumn("segment", F.lower("segment"))))], "same boolean, other boolean")


@query("returner_file", _SEGMENT)
def returner_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(returners_path(spark, compile_template(_SEGMENT_LINES).records(segment_lines(spark, sf_dir)).drop("input")))


@query("returner_terminal", _NATION)
def returner_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed, and returned as it is."""
    return returners.terminal(compile_template(_NATION_LINES).records(nation_lines(spark, sf_dir)).drop("input"), 2)


@query("parse_stream_callback", "SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name AS name, CAST(0 AS BIGINT) AS line FROM nation")
def parse_stream_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record handed to a function, with the line it starts at."""
    rows: list[tuple] = []
    parse_stream(compile_template(_NATION_LINES), nation_lines(spark, sf_dir), lambda r, lines, path: rows.append((r["nation"], r["name"], lines[0])))
    return spark.createDataFrame(rows, "nation bigint, name string, line bigint")


@query("streamability", "SELECT * FROM (VALUES ('flat', ''), ('nested', 'nested groups'), ('collects', 'collects'), ('grouped', 'grouped')) t(template, reason)")
def streamability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a template can't be read record by record."""
    texts = {
        "flat": "<group name='a'>\nx {{ a }}\n</group>",
        "nested": "<group name='a'>\nx {{ a }}\n<group name='b'>\ny {{ b }}\n</group>\n</group>",
        "collects": "<group name='a'>\nx {{ a | joinmatches }}\n</group>",
        "grouped": "<group name='a' record='a'>\nx {{ a }}\n</group>",
    }
    words = ("nested groups", "collects", "grouped")
    rows = [(n, ",".join(w for w in words if any(w in x for why in compile_template(t).why_not_streamable().values() for x in why))) for n, t in texts.items()]
    return spark.createDataFrame(rows, "template string, reason string")
