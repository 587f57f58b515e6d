"""Templates against records written by hand."""

import pytest

from textplan import NotStreamable, Parser, compile_template, load, validate
from textplan.sources.returners import as_python

INTERFACES = """
interface {{ interface }}
 ip address {{ ip | IP }}/{{ mask | to_int }}
 description {{ description | ORPHRASE }}
"""
CONFIG = """hostname r1
interface Loopback0
 ip address 192.168.0.1/24
 description Router id loopback
!
interface Vlan100
 ip address 10.0.0.1/30
!
interface Vlan200
 description Alone
"""


def rows(spark, template, text, path=None, **options):
    plan = compile_template(template, **options)
    df = plan.inputs(spark, {"a": text} if isinstance(text, str) else text)
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None and k != "input"} for r in plan.records(df, path).collect()]


def tree(spark, template, text, **options):
    plan = compile_template(template, **options)
    return as_python(plan.results(plan.inputs(spark, {"a": text} if isinstance(text, str) else text)))


def key(x):
    return sorted(x, key=str)


def test_stanzas(spark):
    got = rows(spark, INTERFACES, CONFIG)
    assert key(got) == key([
        {"interface": "Loopback0", "ip": "192.168.0.1", "mask": 24, "description": "Router id loopback"},
        {"interface": "Vlan100", "ip": "10.0.0.1", "mask": 30},
        {"interface": "Vlan200", "description": "Alone"},
    ])


def test_first_match_wins_and_members_stay_near(spark):
    text = "interface A\n description one\n description two\n" + "!\n" * 120 + " description far\ninterface B\n"
    assert key(rows(spark, INTERFACES, text)) == [{"interface": "A", "description": "one"}, {"interface": "B"}]


def test_nested_groups_and_tree(spark):
    template = """<group name="devices*">
hostname {{ hostname }}
<group name="interfaces">
interface {{ interface }}
 ip address {{ ip }}/{{ mask }}
</group>
</group>"""
    text = CONFIG + "hostname r2\ninterface Eth1\n ip address 1.1.1.1/8\n"
    got = rows(spark, template, text)
    assert key(got)[0]["hostname"] == "r1" and [x["interface"] for x in key(got)[0]["interfaces"]] == ["Loopback0", "Vlan100", "Vlan200"]
    (t,) = tree(spark, template, text)
    assert t["devices"][1] == {"hostname": "r2", "interfaces": {"interface": "Eth1", "ip": "1.1.1.1", "mask": "8"}}
    merged = template.replace('name="interfaces"', 'name="_"')
    assert key(rows(spark, merged, "hostname r2\ninterface Eth1\n"))[0] == {"hostname": "r2", "interface": "Eth1"}


def test_start_and_end(spark):
    template = """<group name="t">
begin {{ n | _start_ | to_int }}
value {{ v | to_int }}
end {{ _end_ }}
</group>"""
    text = "value 1\nbegin 1\nvalue 2\nvalue 3\nend\nvalue 9\nnoise\nbegin 2\nend\nbegin 3\nvalue 4\n"
    assert key(rows(spark, template, text)) == [{"n": 1, "v": 2}, {"n": 2}, {"n": 3, "v": 4}]
    starts = '<group name="entry*">\nmac {{ mac | _start_ }}\nip {{ ip }}\n</group>'
    text = "\n".join(f"mac a{i}\nip 1.1.1.{i}" for i in range(3))
    assert key(rows(spark, starts, text)) == [{"mac": f"a{i}", "ip": f"1.1.1.{i}"} for i in range(3)]
    late = '<group name="x">\npre {{ a }}\nmac {{ mac }} {{ _start_ }}\nip {{ ip }}\n</group>'
    assert key(rows(spark, late, "pre 1\nmac 2\nip 3\nip 4\nmac 5\n")) == key([{"a": "1"}, {"mac": "2", "ip": "3"}, {"mac": "5"}])


def test_window_and_fold_agree(spark):
    import random

    from textplan.operators.segment import Fold, Roles, segment

    r = random.Random(1)
    matches = []
    for k in range(60):
        line = 0
        for _ in range(40):
            line += r.choice([1, 1, 2, 150])
            matches.append((str(k), [], line, r.randint(0, 3)))
    df = spark.createDataFrame(matches, "input string, key array<bigint>, line_no bigint, p int")
    for roles in (Roles(4, frozenset([0])), Roles(4, frozenset([0]), frozenset([0])), Roles(4, frozenset([0, 1]), frozenset([1]))):
        assert roles.closed
        got = sorted((x["input"], x.line_no, x.p, x.rec) for x in segment(df, roles).collect())
        assert got == sorted((x["input"], x.line_no, x.p, x.rec) for x in segment(df, roles, chunk_lines=37).collect())
        want = []
        for k in range(60):
            fold = Fold(roles)
            for _, _, line, p in [m for m in matches if m[0] == str(k)]:
                rec = fold.step(p, line, {}, False, [])
                if rec is not None:
                    want.append((str(k), line, p, rec))
        assert got == sorted(want)


def test_table_and_conditions(spark):
    template = """<group name="t*" method="table">
{{ id | DIGIT | to_int | greaterthan(2) }} {{ name | upper }} {{ state | exclude("dow") }}
x {{ name }}
</group>"""
    got = rows(spark, template, "1 a up\n3 b up\n4 c down\nx d\n5 e up\n")
    assert key(got) == key([{"id": 3, "name": "B", "state": "up"}, {"name": "d"}, {"id": 5, "name": "E", "state": "up"}])


def test_joinmatches(spark):
    template = """<group name="v">
interface {{ interface }}
 vlans {{ vlans | joinmatches(",") }}
 port {{ ports | to_list | joinmatches }}
</group>"""
    got = rows(spark, template, "interface A\n vlans 1,2\n vlans 3\n port x\n port y\ninterface B\n vlans 4\n")
    assert key(got) == key([{"interface": "A", "vlans": "1,2,3", "ports": ["x", "y"]}, {"interface": "B", "vlans": "4"}])


def test_line_collects(spark):
    template = '<group name="d">\nlog {{ n }} {{ _start_ }}\n{{ _line_ | contains("!") | joinmatches }}\n</group>'
    got = rows(spark, template, "log 1\na!\nb\nc!\nlog 2\nd!\n")
    assert key(got) == key([{"n": "1", "_line_": "a!\nc!"}, {"n": "2", "_line_": "d!"}])


@pytest.mark.parametrize("attr,want", [
    ('contains="d"', [1, 3]), ('containsall="d, m"', [1]), ('exclude="d"', [2]), ('excludeall="d, m"', [2, 3]),
    ("equal=\"n, '2'\"", [2]), ("contains_val=\"d, 'th'\"", [3]), ("exclude_val=\"d, 'th'\"", [1, 2]),
    ("functions=\"contains('d') | exclude('m')\"", [3]), ('record="n"', [1, 2, 3]),
])
def test_group_filters(spark, attr, want):
    template = f'<group name="g" {attr}>\nn {{{{ n }}}}\n d {{{{ d }}}}\n m {{{{ m }}}}\n</group>'
    got = rows(spark, template, "n 1\n d one\n m x\nn 2\nn 3\n d three\n")
    assert sorted(int(r["n"]) for r in got) == want


def test_group_functions(spark):
    t = lambda fs: f'<vars>\nsite = "ams"\n</vars>\n<group name="g" functions="{fs}">\nn {{{{ n }}}}\n a {{{{ a.b }}}} {{{{ a.c }}}}\n k {{{{ k }}}} {{{{ v }}}}\n</group>'
    text = "n 1\n a 2 3\n k x y\n"
    assert rows(spark, t("expand() | to_int('n')"), text) == [{"n": 1, "a": {"b": "2", "c": "3"}, "k": "x", "v": "y"}]
    assert rows(spark, t("items2dict('k', 'v') | del('a.b', 'a.c')"), text) == [{"n": "1", "items": {"x": "y"}}]
    assert rows(spark, t("set('site') | sformat('{n}-{site}', 'id') | delete('a.b') | delete('a.c') | delete('k') | delete('v')"), text) == [{"n": "1", "site": "ams", "id": "1-ams"}]
    assert tree(spark, '<group name="ids" itemize="n">\nn {{ n }}\n</group>', "n 1\nn 2\n") == [{"ids": ["1", "2"]}]


def test_validation(spark):
    template = """<vars>
rules = {"n": {"required": True, "type": "integer", "min": 2}, "s": {"allowed": ["up", "down"]}}
</vars>
<group name="g" functions="validate('rules')">
n {{ n }} {{ s }}
</group>"""
    got = rows(spark, template, "n 1 up\nn 2 off\nn 3 down\n")
    assert [[e["error"] for e in r["_validation_errors_"]] for r in sorted(got, key=lambda r: r["n"])] == [["min"], ["allowed"], []]
    assert [r["n"] for r in rows(spark, template.replace("validate", "cerberus"), "n 1 up\nn 2 off\nn 3 down\n")] == ["3"]


def test_defaults_and_set(spark):
    template = '<group name="g">\n{{ kind | set("router") }}\nn {{ n }}\n d {{ d | default("none") }}\n up {{ up | set(True) }}\n</group>'
    got = rows(spark, template, "n 1\n d x\n up\nn 2\n")
    assert key(got) == key([{"n": "1", "d": "x", "up": True, "kind": "router"}, {"n": "2", "kind": "router"}])
    assert rows(spark, '<group name="g" default="-">\nn {{ n }}\n d {{ d }}\n</group>', "n 1\n") == [{"n": "1", "d": "-"}]


def test_recorded_values(spark):
    template = '<group name="g" set="\'host\'">\nhost {{ host | record("host") }}\nn {{ n }} {{ _start_ }}\n</group>'
    got = rows(spark, template, "host a\nn 1\nn 2\nhost b\nn 3\n")
    assert {r["n"]: r["host"] for r in got if "n" in r} == {"1": "a", "2": "b", "3": "b"}  # host b is a member of record 2


def test_lookups(spark):
    template = """<lookup name="sites" load="csv">
key,city,floor
r1,Ams,2
r2,Ber,3
</lookup>
<lookup name="words" load="python">
{"core*": "C", "edge": "E"}
</lookup>
<group name="g">
host {{ host | lookup("sites", add_field="site") }} {{ role | rlookup("words") }} {{ glob | gpvlookup("words", "ed?e") }}
</group>"""
    (got,) = rows(spark, template, "host r2 core17 zzz\n")
    assert got == {"host": "r2", "site": {"key": "r2", "city": "Ber", "floor": "3"}, "role": "core*", "glob": "E"}
    assert rows(spark, '<lookup name="t" load="json">{"1": "one"}</lookup>\n<group name="g">\nn {{ n | lookup("t") }}\n</group>', "n 1\nn 2\n") in ([{"n": "one"}, {"n": "2"}], [{"n": "2"}, {"n": "one"}])


def test_macros(spark):
    template = """<macro>
def short(x):
    return x[:2]

def odd(x):
    return int(x) % 2 == 1

def mark(record):
    if record["n"] == "5":
        return False
    record["long"] = len(record["w"]) > 1
    return record
</macro>
<group name="g" macro="mark" fields="long boolean">
n {{ n | macro("odd") }} {{ w | macro("short") }}
</group>"""
    assert key(rows(spark, template, "n 1 abc\nn 2 abc\nn 3 x\nn 5 y\n")) == key([{"n": "1", "w": "ab", "long": True}, {"n": "3", "w": "x", "long": False}])


def test_dynamic_paths_and_modes(spark):
    template = '<group name="devices.{{ host }}.interfaces.{{ intf }}">\n{{ host }} {{ intf }} {{ status }}\n</group>'
    assert tree(spark, template, "r1 Gi0/1 up\nr1 Gi0/2 down\nr2 Gi0/1 up\n") == [{"devices": {"r1": {"interfaces": {"Gi0/1": {"status": "up"}, "Gi0/2": {"status": "down"}}}, "r2": {"interfaces": {"Gi0/1": {"status": "up"}}}}}]
    two = {"a": "n 1\n", "b": "n 2\n", "c": "none\n"}
    assert tree(spark, '<group name="x">\nn {{ n }}\n</group>', two) == [{"x": {"n": "1"}}, {"x": {"n": "2"}}, {}]
    assert tree(spark, '<template results="per_template">\n<group name="x*">\nn {{ n }}\n</group>\n</template>', two) == [{"x": [{"n": "1"}, {"n": "2"}]}]
    assert tree(spark, "n {{ n }}\n", "n 1\nn 2\n") == [[{"n": "1"}, {"n": "2"}]]
    assert tree(spark, '<vars name="about">\nby = "me"\n</vars>\n<group name="x">\nn {{ n }}\n</group>', "n 1\n") == [{"x": {"n": "1"}, "about": {"by": "me"}}]
    with pytest.raises(ValueError):
        compile_template('<group name="x">\nn {{ n }}\n</group>\n<group name="x*">\nm {{ m }}\n</group>')


def test_alternatives_of_one_name(spark):
    template = '<group name="x">\nn {{ n }}\n</group>\n<group name="x">\nm {{ m }}\n</group>'
    assert key(rows(spark, template, "n 1\nm 2\n", "x")) == key([{"n": "1"}, {"m": "2"}])


def test_streamability_and_saving(spark):
    plan = compile_template(INTERFACES)
    assert plan.is_streamable and load(plan.save()).groups[0].fields == plan.groups[0].fields
    nested = compile_template('<group name="a">\nn {{ n }}\n<group name="b">\nm {{ m }}\n</group>\n</group>')
    assert not nested.is_streamable and "a" in nested.why_not_streamable()
    from textplan.streaming.stream import parse_stream

    with pytest.raises(NotStreamable):
        parse_stream(nested, nested.inputs(spark, {"a": "n 1"}), print)
    seen = []
    n = parse_stream(plan, plan.inputs(spark, {"a": CONFIG}), lambda r, lines, path: seen.append((r["interface"], lines[0])))
    assert n == 3 and seen == [("Loopback0", 1), ("Vlan100", 5), ("Vlan200", 8)]


def test_structured_streaming(spark, tmp_path):
    from textplan.streaming.stream import stream_records

    lines = [("a", i, x) for i, x in enumerate((CONFIG + "interface Last\n").split("\n"))]
    spark.createDataFrame(lines, "input string, line_no long, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("input string, line_no long, line string").parquet(str(tmp_path / "in"))
    for template, want in ((INTERFACES, 3), ("interface {{ interface }}\n", 4)):
        q = stream_records(compile_template(template), source).writeStream.format("memory").queryName(f"s{want}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{want}")).trigger(once=True).start()
        assert q.awaitTermination(60)
        assert spark.table(f"s{want}").count() == want  # the last record of the stateful one is still open


def test_extend_inputs_outputs(spark, tmp_path):
    (tmp_path / "vlan.txt").write_text('<group name="vlans">\nvlan {{ vlan }}\n name {{ name }}\n</group>\n<group name="other">\nx {{ x }}\n</group>')
    template = '<input name="one">\nvlan 7\n name seven\n</input>\n<extend template="vlan.txt" groups="vlans"/>\n<output format="csv" path="vlans"/>'
    p = Parser(spark)
    p._templates.append((template, str(tmp_path)))
    assert p.parse() == [['"name","vlan"\n"seven","7"']]
    assert Parser(spark).add_template('<group name="t">\na {{ a }}\n</group>\n<output functions="traverse(\'t\')" format="json"/>').add_input("a 1\na 2\n").parse() == ['[\n    [\n        {\n            "a": "1"\n        },\n        {\n            "a": "2"\n        }\n    ]\n]']
    assert validate("<group name='a'>\nx {{ a }}\n") and validate('<group name="a">\nx {{ a }}\n</group>') == []


def test_lineage(spark):
    plan = compile_template(INTERFACES)
    got = {r.line_no: r for r in plan.lineage(plan.inputs(spark, {"a": CONFIG})).collect()}
    assert not got[0].matched and got[1].spans["interface"].asDict() == {"start": 10, "stop": 19} and got[2].pattern == 1


def test_custom_functions(spark):
    from pyspark.sql import functions as F

    p = Parser(spark).add_template('<group name="g" twice="n">\nn {{ n | shout }}\n</group>').add_input("n a\n")
    p.add_function("match", "shout", lambda v, args, kwargs: F.concat(v.text, F.lit("!"))).add_function("group", "twice", lambda r, args, kwargs: r.put(args[0], F.repeat(r.text(args[0]), 2)))
    assert p.parse() == [[{"g": {"n": "a!a!"}}]]


def test_files(spark, tmp_path):
    from textplan.sources.readers import load_lookups, lookup_table, merge_lookups, read_csv, read_json, read_lines, read_texts
    from textplan.sources.returners import file

    for n in ("a.txt", "b.txt", "c.cfg"):
        (tmp_path / "in" / n).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / n).write_text(CONFIG * 40)
    assert compile_template(INTERFACES).records(read_texts(spark, str(tmp_path / "in"), ["txt"])).count() == 240
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = read_lines(spark, str(tmp_path / "in" / "a.txt"))
        got = sorted((r.line_no, r.line) for r in lines.collect())
        assert got == list(enumerate(x.rstrip() for x in (CONFIG * 40).rstrip("\n").split("\n")))
        plan = compile_template(INTERFACES, chunk_lines=50)
        assert plan._records(lines, plan.groups[0])[0].count() == 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    file("a,b\n1,x\n2,y\n", str(tmp_path / "t.csv"))
    table = lookup_table(read_csv(spark, str(tmp_path / "t.csv")), "a", "b")
    assert {r.key: r.value for r in table.collect()} == {"1": "x", "2": "y"}
    file(table, str(tmp_path / "t.json"))
    assert read_json(spark, str(tmp_path / "t.json"), "key string, value string").count() == 2
    assert merge_lookups(load_lookups('{"t": {"1": 1}}'), load_lookups("key,v\n1,2\n", "csv", "t")) == {"t": {"1": {"key": "1", "v": "2"}}}


def test_plan_stays_in_the_jvm(spark):
    for template in (INTERFACES, '<group name="t*" method="table">\na {{ a | to_int }}\n</group>'):
        plan = compile_template(template)
        text = plan.records(plan.inputs(spark, {"a": CONFIG}))._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text
    flat = plan.records(spark.range(5).selectExpr("string(id) input", "string(id) text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in flat  # records of one line are made without a shuffle


def test_outputs():
    from textplan.functions import outputs as o

    data = {"a": {"x": {"n": 1}, "y": {"n": 2, "m": 3}}}
    assert o.traverse(data, "a.y.n") == 2 and o.traverse([data, data], "a.x") == [{"n": 1}, {"n": 1}] and o.traverse(data, "no") == {}
    assert o.dict_to_list(data, "k", "a") == {"a": [{"k": "x", "n": 1}, {"k": "y", "n": 2, "m": 3}]}
    assert o.table_rows(data, "a", key="k", missing="-") == [["k", "m", "n"], ["x", "-", 1], ["y", 3, 2]]
    assert o.to_csv([{"a": 1}]) == '"a"\n"1"' and o.tabulate([{"a": 1, "b": "xx"}]) == "a  b\n-  --\n1  xx"
    assert '<edge source="p" target="q"/>' in o.n2g([{"source": "p", "target": "q"}]) and o.to_yaml({"a": [1]}) == "a:\n- 1\n"
    with pytest.raises(o.FunctionError):
        o.traverse(data, "no", strict=True)


def test_syslog(spark):
    import socket

    from textplan.sources.returners import syslog

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(20)
        syslog(spark.createDataFrame([(1,)], "n int"), "127.0.0.1", s.getsockname()[1])
        assert s.recv(1000) == b'<622>{"n":1}'


@pytest.mark.parametrize("line,text,want", [
    ('v {{ x | raise("no") }}', "v 1", None), ('v {{ x | resub("(a)(b)", "\\2\\1", 2) }}', "v abxabxab", {"x": "baxbaxab"}),
    ('v {{ x | let("b", "True") }}', "v 1", {"x": "1", "b": True}), ("v {{ x | unrange }}", "v 1,5-3", {"x": "1"}), ("v {{ x | item(9) }}", "v abc", {"x": "c"}),
    ("v {{ x | to_cidr }}", "v 255.255.255.128", {"x": 25}), ('v {{ x | cidr_match("10.0.0.0/33") }}', "v 10.0.0.1", "none"), ("v {{ x | mac_eui }}", "v 0007.1122.7A", {"x": "00:07:11:22:7a:00"}),
    ('{{ x | _exact_ }} 12', "a 12", {"x": "a"}), ("v {{ x }} 12", "v a 345", {"x": "a"}), ("v {{ ignore }} {{ x | PHRASE }}", "v a b c", {"x": "b c"}), ('v {{ ignore("\\d+") }} {{ x }}', "v a b", "none"),
    ("v {{ x }} tail", "v 1   tail  ", {"x": "1"}), ("v {{ x | dns }}", "v localhost", {"x": "127.0.0.1"}), ("## note\nv {{ x }}", "v 1", {"x": "1"}), ("v [{{ x }}] (a|b)", "v [1] (a|b)", {"x": "1"}),
])
def test_match_cases(spark, line, text, want):
    template = f'<group name="g">\n{line}\n</group>'
    if want is None:
        with pytest.raises(Exception, match="no"):
            rows(spark, template, text)
    else:
        assert rows(spark, template, text) == ([] if want == "none" else [want])


def test_hostname_and_records_of_earlier_groups(spark):
    template = '<vars name="about">\n{"host": "gethostname"}\n</vars>\n<group name="x">\nn {{ n | record("last") }}\n</group>\n<group name="y*" functions="set(\'last\', \'seen\')">\nm {{ m }}\n</group>'
    assert tree(spark, template, "sw1#show\nn 1\nn 2\nm 3\n") == [{"x": [{"n": "1"}, {"n": "2"}], "y": [{"m": "3", "seen": "2"}], "about": {"host": "sw1"}}]


def test_lookup_of_a_frame(spark):
    table = spark.createDataFrame([("a", "one"), ("b", "two")], "key string, value string")
    assert rows(spark, '<group name="g">\nn {{ n | lookup("t") }}\n</group>', "n b\n", lookups={"t": table}) == [{"n": "two"}]


def test_as_of_in_chunks(spark):
    import random

    from textplan.sources.joins import as_of

    r = random.Random(5)
    rows = [(i % 3 and "one", k, k if r.random() < 0.05 else None) for i in range(3) for k in r.sample(range(10**6), 200)] + [("one", None, -1), (None, None, -2)]
    rows = [("one" if a else None, k, v) for a, k, v in rows]
    out = as_of(spark.createDataFrame(rows, "`in` string, k long, v long"), "k", "v", by="in")
    assert out.columns == ["in", "k", "v"]
    want, now = [], {}
    for a, k, v in sorted(rows, key=lambda x: (x[0] or "", -1 if x[1] is None else x[1])):
        now[a] = v if v is not None else now.get(a)
        want.append((a, k, now[a]))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # No window over an input's records: they are dealt by chunk too.
    windows = [w for w in plan.splitlines() if "Window" in w]
    assert any("_last" in w for w in windows) and all("_chunk" in w or "_of" in w for w in windows)


def test_streamed_stanzas_take_group_functions(spark, tmp_path):
    import json

    from textplan.plans.plan import NotStreamable
    from textplan.streaming.stream import stream_records

    text = "n 1\n d x\nn 2\nn 3\n d y\n m z\nn 4\n d q\n"
    lines = [("a", i, x) for i, x in enumerate((text + "n 5\n").split("\n"))]
    spark.createDataFrame(lines, "input string, line_no long, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("input string, line_no long, line string").parquet(str(tmp_path / "in"))
    body = "\nn {{ n | to_int }}\n d {{ d }}\n m {{ m }}\n</group>"
    plan = compile_template('<group name="c" contains="d" exclude="m" default="none">' + body)
    q = stream_records(plan, source).writeStream.format("memory").queryName("stanzas").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert q.awaitTermination(60)
    got = [json.loads(r.record) for r in spark.table("stanzas").orderBy("at").collect()]
    # The last record is still open; what a batch gives of the others is the same.
    want = [{k: v for k, v in r.asDict().items() if k != "input" and v is not None} for r in plan.records(spark.createDataFrame([("a", text)], "input string, text string")).orderBy("n").collect()]
    assert got == want and [r["n"] for r in got] == [1, 4]
    with pytest.raises(NotStreamable):
        stream_records(compile_template('<group name="c" set="\'last\'">\nn {{ n | record("last") }}\n d {{ d }}\n</group>'), source)


def test_ip_info_of_both_versions(spark):
    rows = ["10.0.0.1/8", "2001:db8::1", "FE80::1/64", "::1", "::", "ff02::1", "2001:db8::/129", "a:b", "none"]
    df = spark.createDataFrame([(str(i), f"ip {x}") for i, x in enumerate(rows)], "input string, text string")
    got = {r.input: r.x for r in compile_template('<group name="i">\nip {{ x | ip_info }}\n</group>').records(df).select("input", "x").collect()}
    assert (got["0"].ip, got["0"].version, got["0"].is_private) == ("10.0.0.1", 4, True)
    assert (got["1"].ip, got["1"].compressed, got["1"].exploded, got["1"].version, got["1"].max_prefixlen) == ("2001:db8::1", "2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001", 6, 128)
    assert got["2"].ip == "fe80::1" and got["2"].is_link_local and got["3"].is_loopback and got["4"].is_unspecified and got["5"].is_multicast
    assert not got["1"].is_multicast and all(got.get(i) is None for i in "678")


def test_nations_are_whole_or_refused(spark, tmp_path):
    from textplan.plans.plan import LITERAL_ROWS
    from textplan.queries import nations

    for n in (1001, LITERAL_ROWS + 1):
        spark.range(n).selectExpr("id n_nationkey", "cast(id as string) n_name", "id n_regionkey").write.mode("overwrite").parquet(str(tmp_path / "nation.parquet"))
        if n <= LITERAL_ROWS:
            assert len(nations(spark, str(tmp_path))) == n
        else:
            with pytest.raises(ValueError):
                nations(spark, str(tmp_path))


def test_default_records(spark):
    results = lambda t, **texts: as_python(compile_template(t).results(compile_template(t).inputs(spark, texts)))
    assert results('<group name="g" default="none">\na {{ x }}\n b {{ y }}\n</group>', one="zzz", two="a 1") == [{"g": {"x": "none", "y": "none"}}, {"g": {"x": "1", "y": "none"}}]
    # A variable of the first pattern has a default: all that have one take theirs.
    assert results('<group name="g">\na {{ x | default("0") }} {{ z }}\n b {{ y | default("none") }}\n</group>', one="zzz") == [{"g": {"x": "0", "y": "none"}}]
    assert results('<group name="g">\na {{ x }}\n b {{ y | default("none") }}\n</group>', one="zzz") == [{}]
    # Typed fields keep their type.
    rows = compile_template('<group name="g" default="7">\na {{ x | to_int }} {{ y }}\n</group>').records(spark.createDataFrame([("i", "zzz"), ("j", "a 1 b")], "input string, text string"))
    assert sorted((r.input, r.x, r.y) for r in rows.collect()) == [("i", 7, "7"), ("j", 1, "b")]
    # Of a nested group: a parent without one has the default.
    assert results('<group name="p*">\na {{ x }}\n<group name="c" default="none">\n b {{ y }}\n</group>\n</group>', one="a 1\n b 2\na 3") == [{"p": [{"x": "1", "c": {"y": "2"}}, {"x": "3", "c": {"y": "none"}}]}]


def test_wired_inputs(spark, tmp_path):
    for n in ("a.txt", "b.txt", "sub/c.txt", "d.cfg"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(f"v {n[-5]}\nw {n[-5]}")
    g = '<group name="g">\nv {{ v }}\n</group>\n<group name="h">\nw {{ w }}\n</group>'

    def values(tags, path="g", **kw):
        plan = compile_template(tags + g)
        return sorted(r[1] for r in plan.records(plan.inputs(spark, **kw), path).collect())

    assert values(f'<input load="file" url="{tmp_path}/a.txt" name="one"/>') == ["a"]
    assert values(f'<input load="directory" url="{tmp_path}" extensions="txt"/>') == ["a", "b", "c"]
    assert values(f'<input load="directory" url="{tmp_path}" filters="/[ad][.], sub"/>') == ["a", "c", "d"]
    only = f'<input load="directory" url="{tmp_path}" extensions="txt" groups="h"/>\n<input name="two" load="text" groups="g">\nv x\nw y\n</input>'
    assert values(only) == ["x"] and values(only, "h") == ["a", "b", "c"]
    assert values(f'<input load="file" url="{tmp_path}/a.txt" name="one"/>', passed={"one": "v passed"}) == ["passed"]
    with pytest.raises(ValueError, match="no url"):
        values('<input load="file"/>')
    with pytest.raises(ValueError, match="no such way"):
        values('<input load="gnmi" url="x"/>')
    with pytest.raises(PermissionError):
        values('<input load="url" url="http://127.0.0.1:1/"/>')


def test_yang_rules(spark):
    t = '<group name="g" yang="rules">\nn {{ n }}\n</group>'
    plan = compile_template(t, variables={"rules": {"n": {"type": "integer"}}})
    assert plan.warnings == [] and compile_template(t).warnings and "rules" in compile_template(t).warnings[0]
    got = plan.records(spark.createDataFrame([("i", "n 1"), ("j", "n x")], "input string, text string"))
    assert sorted((r.n, r._validation_valid_) for r in got.collect()) == [("1", True), ("x", False)]


def test_lineage_of_every_piece(spark):
    """Spans are where Python's own matching of the line finds them."""
    import re

    t = 'a{{ x }} is  {{ y | ORPHRASE }} of {{ ignore }} {{ z | re("(1|2)+") }}\n{{ w | WORD }} end\nplain line'
    plan = compile_template(t)
    text = "ab is é f g of skip 1212\nabc is d of k 2\tx\nfür end  \nplain line\nnone of it here"
    got = plan.lineage(plan.inputs(spark, {"a": text})).collect()
    ps = plan.groups[0].patterns
    for r in got:
        if r.matched:
            m = re.match(ps[r.pattern].regex.replace("(?d)", ""), r.line)
            assert {k: (s.start, s.stop) for k, s in r.spans.items()} == {v.name: m.span(v.group) for v in ps[r.pattern].variables if v.group}
    assert [r.matched for r in sorted(got, key=lambda r: r.line_no)] == [True, False, True, True, False]


def test_strict_mode():
    from textplan.pattern import PatternError

    for bad in (r"(?=x)y", r"(?<!x)y", r"(a)\1", "a++"):
        t = f'<group name="g">\nv {{{{ x | re("{bad}") }}}}\n</group>'
        with pytest.raises(PatternError):
            compile_template(t, strict=True)
    assert compile_template('<group name="g">\nv {{ x | re("(?:a|b)+") }} {{ y | PHRASE }}\n</group>', strict=True)
    assert compile_template('<group name="g">\nv {{ x | re("(?=x)x") }}\n</group>').groups


def test_unrange_and_truncate_bounds(spark):
    def one(calls, text):
        plan = compile_template(f"v {{{{ x | ORPHRASE | {calls} }}}}")
        return plan.records(plan.inputs(spark, {"a": f"v {text}"})).collect()[0].x

    assert one('unrange("-", ",")', "1,3-5,1-9999999999,7") == "1,3,4,5,1-9999999999,7"
    assert [one(f"truncate({n})", "éaß") for n in (1, 2, 3, 4, 5, 9)] == ["", "é", "éa", "éa", "éaß", "éaß"]


@pytest.mark.parametrize("name", ["start_markers", "start_end_blocks"])
def test_tasks_that_sort_lines_grow_with_the_tables(spark, monkeypatch, name):
    """Their number follows the bytes of the tables, and is not cut again by the shuffle's; the empty key adds no second shuffle."""
    import re

    from tests.oracle import DATA
    from textplan import queries
    from textplan.operators import segment

    monkeypatch.setattr(segment, "TASK_BYTES", 1 << 12)
    plan = queries.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_num = [(c, int(n)) for c, n in re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert [c for c, _ in by_num] == ["input", "o_custkey", "o_orderkey"] and min(n for _, n in by_num) > 4, by_num
    assert plan.count("Exchange hashpartitioning(input") == (2 if name == "start_end_blocks" else 1)


def test_fold_of_batches_equals_its_steps(spark):
    """Members that join an open record without a step get the record that a step gives them."""
    import random

    from textplan.operators.segment import Fold, Roles, segment

    r = random.Random(3)
    for roles in (Roles(4, frozenset({0}), frozenset({0}), frozenset({3})), Roles(4, frozenset({1, 2}), frozenset({2}), frozenset({3})), Roles(4, frozenset({0, 3}), frozenset({0}), frozenset({3}))):
        rows = [(i, line, p) for i in "ab" for line in range(60) for p in sorted(r.sample(range(4), r.choice([0, 1, 1, 1, 2])))]
        want = []
        for name in "ab":
            fold, own = Fold(roles), [x for x in rows if x[0] == name]
            for j, (_, line, p) in enumerate(own):
                ahead = [(q, q in roles.ends | roles.markers) for _, at, q in own[j + 1 :] if at == line]
                rec = fold.step(p, line, {}, False, ahead)
                want += [(name, line, p, rec)] if rec is not None else []
        df = spark.createDataFrame(rows, "input string, line_no long, p int").selectExpr("input", "cast(array() as array<bigint>) as key", "line_no", "p")
        assert sorted((x.input, x.line_no, x.p, x.rec) for x in segment(df, roles).collect()) == want


def test_place_among_chunk_starts_is_searched_by_halves(spark):
    """A row asks for a few of the chunks' starts, however many there are."""
    import bisect

    from pyspark.sql import functions as F

    from textplan.sources.joins import as_of, count_up_to

    for starts in ([], [3], [None, 1, 1, 4], [0, 2, 4, 6, 8, 10, 12]):
        df = spark.createDataFrame([(v, starts) for v in [None, *range(-1, 14)]], "v int, s array<int>")
        got = {r.v: r.n for r in df.select("v", count_up_to("s", F.col("v"), len(starts)).alias("n")).collect() if r.v is not None}
        known = [x for x in starts if x is not None]
        if None not in starts:
            assert got == {v: bisect.bisect_right(known, v) for v in range(-1, 14)}
        df = spark.createDataFrame([(v, starts) for v in [None, *range(-1, 14)]], "v int, s array<int>").select("v", F.transform("s", lambda x: F.struct(x.alias("v"))).alias("s"))
        got = {r.v: r.n for r in df.select("v", count_up_to("s", F.struct("v"), len(starts)).alias("n")).collect()}
        assert got == {v: sum(x is None or v is not None and x <= v for x in starts) for v in [None, *range(-1, 14)]}
    out = as_of(spark.range(100).selectExpr("'a' as input", "id as k", "if(id % 7 = 0, id, null) as v"), "k", "v")
    assert "filter(_starts" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.k: r.v for r in out.collect()} == {k: k // 7 * 7 for k in range(100)}


def test_search_join_by_fixed_text(spark):
    import fnmatch

    from textplan.sources.joins import search_join

    values = ["AUTOMOBILE", "BUILDING", "MACHINERY", "ab", "a", None, "xyz", "ABCDEF", "AUTOMOBILE"]
    keys = ["AUTO*", "BUILD", "M*RY", "a", "?b", "nothing", "*CDE?", "z*"]
    records = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, v string")
    table = spark.createDataFrame([(k, k.lower() + "!") for k in keys], "key string, value string")
    got = {r.n: r.hit for r in search_join(records, "v", table, "hit").collect()}
    for i, v in enumerate(values):
        fits = sorted(k for k in keys if v is not None and (k in v or fnmatch.fnmatchcase(v, k)))
        assert got[i] == (fits[0].lower() + "!" if fits else None), v
    # The other way: the field is the glob, the keys are the texts.
    globs = spark.createDataFrame([(0, "AUT*"), (1, "*"), (2, "x?z"), (3, "q*"), (4, None)], "n int, v string")
    texts = spark.createDataFrame([(v, v) for v in values if v], "key string, value string").distinct()
    got = {r.n: r.hit for r in search_join(globs, "v", texts, "hit", keys_are_globs=False).collect()}
    assert got == {0: "AUTOMOBILE", 1: "ABCDEF", 2: "xyz", 3: None, 4: None}


@pytest.mark.parametrize("broadcast", [100_000, 10])
def test_search_join_tries_few_pairs_of_globs_alike(spark, monkeypatch, broadcast):
    """Globs with one beginning and one end: by their first three characters, each text met over a hundred of them."""
    from textplan.sources import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    n, pairs = 1200, joins._meetings
    monkeypatch.setattr(joins, "_meetings", lambda *a: tried.append(pairs(*a)) or tried[-1])
    tried = []
    records = spark.range(n).selectExpr("id", "'<at-' || id || '>' as v")
    table = spark.range(n).selectExpr("'*t-' || id || '>' as key", "id as value")
    assert all(r.id == r.hit for r in joins.search_join(records, "v", table, "hit").collect())
    assert n <= tried[0].count() <= 4 * n


def test_named_folder_of_several_files(spark, tmp_path):
    """Lines of each file keep together, and a text passed under the tag's name replaces them all."""
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("\n".join(f"c {n}\n s {n}" for n in range(i * 10, i * 10 + 10)))
    plan = compile_template(f'<input load="file" url="{tmp_path}" name="one" groups="g"/>\n<group name="g*" input="one">\nc {{{{ a | to_int }}}}\n s {{{{ b | to_int }}}}\n</group>')
    assert sorted((r.a, r.b) for r in plan.records(plan.inputs(spark)).collect()) == [(n, n) for n in range(30)]
    assert [(r.input, r.a) for r in plan.records(plan.inputs(spark, {"one": "c 7"})).collect()] == [("one", 7)]
    one = compile_template(f'<input load="file" url="{tmp_path}/1.txt" name="one"/>\n<group name="g*">\nc {{{{ a }}}}\n</group>')
    assert {r.input for r in one.records(one.inputs(spark)).collect()} == {"one"}


def test_lookup_in_a_large_frame(spark, monkeypatch):
    from textplan.plans import plan as plans
    from textplan.sources.readers import lookup_table

    monkeypatch.setattr(plans, "LITERAL_ROWS", 1)
    table = lookup_table(spark.createDataFrame([("1", "one"), ("2", "two")], "k string, v string"), "k", "v")
    plan = compile_template('<group name="g*">\nv {{ x | lookup("t") }} {{ y | lookup("t", add_field="name") }}\nw {{ z }}\n</group>', lookups={"t": table})
    got = as_python(plan.results(plan.inputs(spark, {"a": "v 1 2\nw 3\nv 9 9"})))
    assert got == [{"g": [{"name": "two", "x": "one", "y": "2", "z": "3"}, {"x": "9", "y": "9"}]}]


def test_drawings_and_workbooks(tmp_path):
    import zipfile
    from xml.etree import ElementTree

    from textplan.functions.outputs import excel, layout, n2g

    data = [{"source": "a", "target": "b"}, {"source": "b", "target": "c<"}, {"source": "a", "target": None}]
    for algo in ("", "grid", "circle", "layers"):
        for module in ("yed", "drawio"):
            root = ElementTree.fromstring(n2g(data, module=module, algo=algo))
            kinds = [e.tag.split("}")[-1] for e in root.iter()]
            assert (kinds.count("node"), kinds.count("edge")) == (3, 2) if module == "yed" else kinds.count("mxCell") == 2 + 3 + 2
    places = layout([{"id": x} for x in "abc"], [{"source": "a", "target": "b"}, {"source": "b", "target": "c"}, {"source": "c", "target": "a"}], "layers")
    assert len(set(places.values())) == 3
    with zipfile.ZipFile(excel(data, str(tmp_path / "x.xlsx"))) as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        texts = [e.text or "" for e in sheet.iter() if e.tag.endswith("}t")]
        assert texts == ["source", "target", "a", "b", "b", "c<", "a", "None"] and len(z.namelist()) == 5


def test_chunks_of_one_input_change_nothing(spark):
    """Nested groups, recorded values and starts carried over chunks, for groups of each kind."""
    import random

    r = random.Random(8)
    text = "\n".join(r.choice(["p %d" % i, "p %d k" % i, " c %d" % i, "  d %d" % i, "m %d" % i, "!", "x"]) for i in range(120))
    heads = ["p {{ a }}", "p {{ a }} {{ _start_ }}", "p {{ a }} {{ k | equal(\"k\") }}", "p {{ a | record(\"last\") }}\nm {{ b }}"]
    for head in heads:
        for attrs in ("", 'method="table"', "functions=\"set('last', 'l', default='-')\""):
            t = f'<group name="g*" {attrs}>\n{head}\n<group name="c*">\n c {{{{ c }}}}\n<group name="d*">\n  d {{{{ d }}}}\n</group>\n</group>\n</group>'
            plans = [compile_template(t, chunk_lines=n) for n in (None, 7)]
            one, many = [as_python(p.results(p.inputs(spark, {"a": text}))) for p in plans]
            assert one == many, (head, attrs)


def test_template_checks(spark):
    from textplan.functions.group import FUNCTIONS
    from textplan.pattern import PatternError
    from textplan.template import check_template, parse

    t = parse('<input load="gnmi"/><input load="json"/>\n<group name="g" functions="contains(\'a\') | odd(1">\na {{ a }}\n<group name="h" chain="what | delete(\'x\')">\nb {{ b }}\n</group>\n</group>\n<output format="odd" returner="nowhere"/>\n<macro>\ndef (\n</macro>')
    found = " ".join(check_template(t, tuple(FUNCTIONS)))
    assert all(x in found for x in ("load: gnmi", "pair up", "no such function: what", "format: odd", "returner: nowhere", "macro:")) and "json" not in found
    assert check_template(parse('<group name="g">\na {{ a }}\n</group>')) == []
    # The engine's own expressions are known, and its errors found, when the template is compiled.
    assert compile_template(r'<group name="g">' + "\n" + r'a {{ a | re("\p{Lu}+") }}' + "\n</group>").groups
    with pytest.raises(PatternError):
        compile_template('<group name="g">\na {{ a | re("(") }}\n</group>')


def test_sibling_templates_keep_their_attributes(spark):
    t = '<template results="per_template">\n<group name="a*">\na {{ x }}\n</group>\n</template>\n<template>\n<group name="b">\nb {{ y }}\n</group>\n</template>'
    p = Parser(spark).add_template(t).add_input("a 1\nb 2", "one").add_input("a 3", "two")
    assert p.parse() == [[{"a": [{"x": "1"}, {"x": "3"}]}], [{"b": {"y": "2"}}, {}]]


def test_inputs_in_formats(spark):
    g = '\n<group name="g*">\nv {{ v }}\n</group>'
    values = lambda tag: sorted(r.v for r in (lambda p: p.records(p.inputs(spark)).collect())(compile_template(tag + g)))
    assert values('<input load="json">\n["v 1", "v 2\\nv 3"]\n</input>') == ["1", "2", "3"]
    assert values('<input load="yaml">\none: v 1\ntwo: |\n  v 2\n  v 3\n</input>') == ["1", "2", "3"]
    assert values('<input load="csv">\nv 1\n</input>') == ["1"]


def test_streams_equal_batches_for_each_function(spark, tmp_path):
    """A group of several lines for every function that may be streamed."""
    import json

    from textplan.plans.plan import STREAMABLE, NotStreamable
    from textplan.streaming.stream import stream_frame, stream_records

    calls = {
        "contains": 'contains="d"', "containsall": 'containsall="d, m"', "exclude": 'exclude="m"', "excludeall": 'excludeall="d, m"',
        "equal": "equal=\"d, 'x'\"", "contains_val": "contains_val=\"d, 'x'\"", "exclude_val": "exclude_val=\"d, 'x'\"",
        "set": "functions=\"set('v', 's', default='z')\"", "record": "functions=\"record('d', 'kept') | set('kept', 's')\"", "delete": "functions=\"delete('d')\"",
        "del": 'del="m"', "to_int": "functions=\"to_int('m')\"", "sformat": "functions=\"sformat('{n}/{d}', 'id')\"", "to_ip": "functions=\"to_ip('m')\"",
        "expand": 'functions="expand()"', "items2dict": "functions=\"items2dict('d', 'm')\"", "cerberus": "functions=\"cerberus('rules')\"",
        "validate": "functions=\"validate('rules')\"", "macro": 'macro="mark" fields="long boolean"',
    }
    assert set(calls) == STREAMABLE
    macro = '<macro>\ndef mark(r):\n    r["long"] = len(r.get("d", "")) > 1\n    return r.get("m") != "9"\n</macro>\n'
    macro = macro.replace('return r.get("m") != "9"', 'return r if r.get("m") != "9" else False')
    groups = [f'<group name="{n}" {tag} default="none">\nn {{{{ n | to_int }}}}\n d {{{{ {"a.b" if n == "expand" else "d"} }}}}\n m {{{{ m }}}}\n</group>' for n, tag in calls.items()]
    plan = compile_template(macro + "\n".join(groups), variables={"v": "seven", "rules": {"m": {"type": "integer", "max": 5}, "d": {"required": True}}})
    assert plan.is_streamable
    text = "n 1\n d x\nn 2\nn 3\n d y\n m 3\nn 4\n d xx\n m 9\n"
    spark.createDataFrame([("a", i, x) for i, x in enumerate((text + "n 5\n").split("\n"))], "input string, line_no long, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("input string, line_no long, line string").parquet(str(tmp_path / "in"))
    inputs = spark.createDataFrame([("a", text)], "input string, text string")
    with pytest.raises(NotStreamable, match="query each"):
        stream_records(plan, source)
    queries = {n: stream_frame(plan, source, n).writeStream.format("memory").queryName(f"each_{n}").outputMode("append").option("checkpointLocation", str(tmp_path / n)).trigger(once=True).start() for n in calls}
    order = lambda df: sorted(str(r) for r in df.collect())
    for n, q in queries.items():
        assert q.awaitTermination(120), n
        batch, stream = plan.records(inputs, n), spark.table(f"each_{n}").drop("at")
        assert batch.columns == stream.columns and order(batch) == order(stream), n
        assert 0 < stream.count() <= 4, n
