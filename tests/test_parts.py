"""Functions, loads, rows, formats, grids, documents, storage, streams."""

import datetime as dt
import json

import pytest

from planwright.engine import Engine
from planwright.errors import PlanError
from planwright.functions.formats import read_format, write_number
from planwright.functions.library import LIBRARY, aggregate_values, call, operate
from planwright.functions.values import Val, blank, compare, literal, same
from planwright.operators import grid, rows
from planwright.sources import delimited, document, records, store
from planwright.streaming import feeds


@pytest.fixture(scope="module")
def value(spark):
    def run(v: Val):
        err = v.err if v.err is not None else None
        cols = [v.col.alias("v")] + ([err.alias("e")] if err is not None else [])
        r = spark.range(1).select(*cols).first()
        return f"#{r['e']}" if err is not None and r["e"] else r["v"]

    return run


@pytest.mark.parametrize("name,args,want", [
    ("ROUND", (2.5,), 3), ("ROUND", (-2.5,), -3), ("ROUND", (123.456, -1), 120), ("ROUNDUP", (-1.1,), -2), ("TRUNC", (-1.9,), -1), ("MROUND", (7, 5), 5),
    ("MOD", (-5, 3), 1), ("MOD", (5, 0), "#NUM"), ("SQRT", (-1,), "#NUM"), ("LN", (0,), "#NUM"), ("LOG", (100,), 2), ("LOG", (8, 2), 3), ("DIVIDE", (1, 0), "#DIV0"), ("POWER", (2, 3), 8),
    ("LEFT", ("abc",), "a"), ("LEFT", ("abc", -1), "ab"), ("RIGHT", ("abc", 2), "bc"), ("MID", ("abcd", 2, 2), "bc"), ("TRIM", ("  a   b ",), "a b"), ("LEN", ("abc",), 3), ("EXACT", ("a", "A"), False),
    ("ENDSWITH", ("Hello", "LO"), True), ("VALUE", ("12a",), "#TYPE"), ("VALUE", (" 12 ",), 12), ("STRING", (3.0,), "3"), ("REPLACE", ("abcd", 2, 2, "x"), "axd"), ("SUBSTITUTE", ("aaa", "a", "b"), "bbb"), ("SUBSTITUTE", ("aaa", "", "b"), "aaa"),
    ("ISBLANK", ("",), True), ("ISTEXT", ("a",), True), ("ISNUMBER", (1,), True), ("ISLOGICAL", (True,), True), ("COALESCE", (None, "", "x"), "x"), ("IF", (False, 1), 0), ("IF", (True,), True), ("NOT", (0,), True),
    ("YEAR", ("2024-02-29",), 2024), ("WEEKDAY", ("2024-01-07",), 1), ("EOMONTH", ("2024-01-31", 1), 19782), ("SOMONTH", ("2024-03-15", -1), 19754), ("DATE", (2024, 13, 1), 20089), ("DAYS", ("3/1/2024", "2024-02-01"), 29),
    ("DATEOP", ("2024-01-31", 1, "month"), 19784), ("DATEDIF", ("2023-05-10", "2024-05-09", "y"), 0), ("DATEDIF", ("2023-05-10", "2024-05-10", "m"), 12), ("YEAR", ("nonsense",), "#TYPE"), ("YEARFRAC", ("2024-01-01", "2024-12-31"), 1.0), ("DATEISO", (19723,), "2024-01-01"),
    ("PMT", (0, 10, 100), -10), ("SLN", (100, 10, 9), 10), ("SYD", (100, 10, 5, 1), 30), ("DDB", (1000, 100, 5, 1), 400), ("DDB", (1000, 100, 5, 5), 29.6), ("GROWTH", (100, 0.1, 2), 121), ("NPER", (0, -10, 100), 10),
])
def test_functions(value, name, args, want):
    got = value(call(name, [literal(a) for a in args]))
    assert got == pytest.approx(want, abs=1e-9) if isinstance(want, (int, float)) and not isinstance(want, bool) else got == want


def test_finance_identities(value):
    p = value(call("PMT", [literal(x) for x in (0.01, 24, 1000)]))
    assert value(call("RATE", [literal(x) for x in (24, p, 1000)])) == pytest.approx(0.01, abs=1e-9)
    assert value(call("FV", [literal(x) for x in (0.01, 24, p, 1000)])) == pytest.approx(0, abs=1e-6)
    parts = sum(value(call("PPMT", [literal(x) for x in (0.01, k, 24, 1000)])) for k in (1, 12, 24))
    assert parts < 0
    assert value(aggregate_values("IRR", [literal(x) for x in (-100, 60, 60)])) == pytest.approx(0.130662386, abs=1e-8)
    assert value(aggregate_values("IRR", [literal(x) for x in (1, 1)])) == "#NUM"


def test_operators_and_equality(value):
    lit = literal
    assert value(operate("+", [blank(), lit(2)])) == 2 and value(operate("&", [lit(1.0), lit("x")])) == "1x"
    assert value(operate("+", [lit("abc"), lit(1)])) == "#TYPE" and value(operate("/", [lit(1), blank()])) == "#DIV0"
    assert value(operate("and", [lit(False), operate("/", [lit(1), lit(0)])])) is False
    assert value(call("IFERROR", [operate("/", [lit(1), lit(0)]), lit(7)])) == 7 and value(call("ISERROR", [operate("/", [lit(1), lit(0)])])) is True
    for a, b, want in (("A", "a", True), (1, 1 + 1e-12, True), ("1", 1, True), (None, 0, True), (None, "", True), (None, False, True), ("x", 1, False), ("", 0, True)):
        assert value(Val("bool", same(lit(a), lit(b)))) is want, (a, b)
    assert value(compare("<", lit("apple"), lit("Banana"))) is True


def test_aggregates_of_values(value):
    vs = [literal(x) for x in (3, None, 1, 2)]
    for name, want in (("SUM", 6), ("AVG", 2), ("COUNT", 3), ("COUNTA", 3), ("COUNTBLANK", 1), ("MIN", 1), ("MAX", 3), ("MEDIAN", 2), ("FIRST", 3), ("LAST", 2), ("LISTAGG", "3, 1, 2"), ("COUNTD", 3)):
        assert value(aggregate_values(name, vs)) == want, name
    assert value(aggregate_values("SUM", [blank()])) == 0 and value(aggregate_values("AVG", [blank()])) is None
    assert len(LIBRARY) > 60


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_delimited(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,Cost Center,Cost Center,Amount ($),Share,When,Ok\nr1,eng,x,"$1,234.50",12%,2026-01-05,yes\n\nr2,"a ""b""",y,-3,5%,1/31/2026,no\nr3,ops,z,,,,\n')
    df = delimited.read_delimited(spark, path)
    assert df.columns[:4] == ["id", "cost_center", "cost_center_2", "amount"]
    assert df.count() == 3
    t = delimited.infer_types(df)
    assert (t["amount"], t["share"], t["when"], t["ok"], t["cost_center"]) == ("number", "number", "date", "bool", "text")
    r = {x["id"]: x for x in df.select("id", delimited.coerce(df["amount"], "number").alias("a"), delimited.coerce(df["share"], "number").alias("s"), delimited.coerce(df["when"], "date").alias("w")).collect()}
    assert r["r1"]["a"] == 1234.5 and abs(r["r1"]["s"] - 0.12) < 1e-12 and r["r2"]["w"] == dt.date(2026, 1, 31) and r["r3"]["a"] is None
    assert delimited.id_column(df, t) == "id"


def test_loads(spark, tmp_path):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "depts", {}, [{"id": "eng"}, {"id": "ops"}])
    read = lambda name, text: delimited.read_delimited(spark, write(tmp_path, name, text))
    a = read("a.csv", "id,dept,amount\na,eng,1\nb,ops,2\n")
    plan = delimited.load(e, "m", "costs", a)
    assert plan.refs == {"dept": "depts"} and plan.inserted == 2
    with pytest.raises(PlanError) as x:
        delimited.load(e, "m", "costs", a, "append")
    assert x.value.code == "LOAD_DUPLICATE_ID"
    b = read("b.csv", "id,amount\nb,5\nc,6\n")
    assert vars(delimited.load(e, "m", "costs", b, "upsert", dry_run=True))["updated"] == 1
    plan = delimited.load(e, "m", "costs", b, "upsert")
    assert (plan.inserted, plan.updated, plan.changed) == (1, 1, 1)
    got = {r["id"]: (r["dept"], r["amount"]) for r in e.table("m", "costs").collect()}
    assert got == {"a": ("eng", 1.0), "b": ("ops", 5.0), "c": (None, 6.0)}
    plan = delimited.load(e, "m", "costs", read("c.csv", "id,amount\nc,7\n"), "replace")
    assert plan.deleted == 2 and e.table("m", "costs").count() == 1
    for text, code in (("id,dept\nx,nowhere\n", "LOAD_UNKNOWN_REF"), ("id,amount\nx,abc\n", "LOAD_BAD_VALUE"), ("amount\n1\n", "LOAD_NO_ID"), ("id,other\nx,1\n", "LOAD_NO_COLUMNS")):
        with pytest.raises(PlanError) as x:
            delimited.load(e, "m", "costs", read(f"{code}.csv", text), "upsert")
        assert x.value.code == code
    delimited.load(e, "m", "costs", read("d.csv", "id,other\nc,9\n"), "upsert", add_fields=True)
    assert e.get_field("m", "costs", "c", "other") == 9


def test_deletes_null_out_and_order(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "names", {}, [{"id": i} for i in "abcd"])
    e.create_table("m", "quotes", {"name": "ref:names", "px": "number"}, [{"name": n, "px": i + 1} for i, n in enumerate("abcd")])
    e.create_pivot("m", "p", [("name", "names")])
    e.set_rules("m", "p", "value = SUM(quotes.px)")
    e.delete_rows("m", "names", ["b"])
    assert e.get_field("m", "quotes", "2", "name") is None
    got = e.cells("m", "p").toPandas()
    assert sorted(got["value"]) == [1, 3, 4]
    with pytest.raises(PlanError):
        e.drop_table("m", "names")
    with pytest.raises(PlanError) as x:
        e.insert_rows("m", "quotes", [{"id": "9", "name": "zz"}])
    assert x.value.code == "DATA_UNKNOWN_REF"


def test_tracked(spark):
    e = Engine(spark, who="ann")
    e.create_model("m")
    e.create_table("m", "t", {"x": "number"}, [{"id": "a", "x": 1}], tracked=True)
    e.who = "bob"
    e.set_cell("m", "t", "a", "x", 2)
    r = e.table("m", "t").first()
    assert (r["added_by"], r["changed_by"], r["x"]) == ("ann", "bob", 2.0)


def test_rows(spark):
    t = spark.createDataFrame([("1", 0, "Ann", "x", 5.0), ("2", 1, "bob", "Y", None), ("3", 2, "Cid", "x", 9.0)], "id string, _ord long, name string, dept string, amount double")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(rows.find_rows(t, sort="-amount")) == ["3", "1", "2"] and ids(rows.find_rows(t, sort="amount")) == ["1", "3", "2"]
    assert ids(rows.find_rows(t, {"dept": "X", "amount": {"gte": 6}})) == ["3"] and ids(rows.find_rows(t, q="BO")) == ["2"]
    assert ids(rows.find_rows(t, {"dept": {"in": ["y", "x"]}}, sort="dept,-name", offset=1, limit=1)) == ["1"]
    with pytest.raises(PlanError):
        rows.find_rows(t, {"nope": 1})


@pytest.mark.parametrize("v,fmt,want", [
    (1234567.8, "currency", "$1,234,568"), (0.1219, "percent", "12.2%"), (42, "int", "42"), (-5, "currency:EUR", "-€5"), (9.85, "0.0", "9.9"), (12.345, None, "12.35"),
    (3, '0.0"x"', "3.0x"), (1234.5, "[$CHF]#,##0.0", "CHF 1,234.5"), (19723, "date", "2024-01-01"), (4, None, "4"), (0.5, "??", "0.5"),
])
def test_formats(v, fmt, want):
    assert write_number(v, read_format(fmt)) == want


DOC = {
    "model": "d", "periods": {"start": "2025-01", "count": 3, "grain": "year", "histUntil": "2025-12-31"},
    "tables": [{"id": "drivers", "fields": {"value": "number"}, "rows": [{"id": "g", "value": 0.2}]}],
    "pivots": [{"id": "pl", "lines": [{"id": "revenue", "name": "Revenue", "format": "currency"}, {"id": "margin", "name": "Margin", "format": "percent"}], "dims": [("period", "periods")],
                "inputs": [{"line": "revenue", "values": {"fy2025": 100}}], "rules": ["revenue[frame=fcst] = PREV(revenue) * (1 + SUM(drivers.value))", "margin = 0.25"]}],
    "outputs": [{"pivot": "pl", "title": "P&L"}],
}


def test_document_and_grid(spark):
    e = Engine(spark)
    out = document.apply(e, DOC)["pl"]
    assert "| Revenue" in out and "$144" in out and "25.0%" in out and "FY2027" in out
    again = json.loads(json.dumps(DOC))
    again["tables"][0]["rows"][0]["value"] = 0.5
    assert "$225" in document.apply(e, again)["pl"]
    assert document.decode_link(document.encode_link(again)) == again
    g = grid.query(e, "d", "pl", ["line"], ["period"], filters={"line": ["margin", "revenue"]})
    assert [r[0] for r in g.rows] == ["margin", "revenue"]
    g = grid.query(e, "d", "pl", ["line"], ["period"], sort={"by": "fy2025", "desc": True}, top=1)
    assert g.rows == [("revenue",)]
    assert json.loads(grid.window_json(g))["values"] == [100.0, 150.0, 225.0]
    with pytest.raises(PlanError) as x:
        grid.query(e, "d", "pl", ["line"], [])
    assert x.value.code == "QUERY_UNPINNED_DIM"
    for bad in ([], {"model": "x", "nope": 1}, {"model": "x", "pivots": [{"id": "p"}]}):
        with pytest.raises(PlanError):
            document.normalize(bad)


def test_snapshot_and_log(spark, tmp_path):
    e = Engine(spark)
    document.apply(e, DOC)
    store.save(e, str(tmp_path / "snap"))
    again = store.open_snapshot(spark, str(tmp_path / "snap"))
    at = {"line": "revenue", "period": "fy2027"}
    assert again.get("d", "pl", at) == pytest.approx(e.get("d", "pl", at))
    path = str(tmp_path / "ops.jsonl")
    log = store.Log(Engine(spark), path)
    log.run("create_model", "m", {"tolerance": 0.01, "max_iterations": 40})
    log.run("create_table", "m", "l", {}, [{"id": "a"}, {"id": "b"}])
    log.run("create_pivot", "m", "p", [{"id": "line", "table": "l"}], line_dim="line")
    log.run("set_rules", "m", "p", "a = 0.5 * b + 10\nb = a")
    with open(path, "a") as f:
        f.write('{"seq": 5, "op"')
    other = Engine(spark)
    assert store.replay(other, path) == 4 and abs(other.get("m", "p", {"line": "a"}) - 20) < 0.1
    assert [r["seq"] for r in store.history(spark, path, 2).collect()] == [4, 3]


def test_records(spark):
    body = json.dumps({"data": [{"date": "2027-01-31", "rev": "300000", "eps": "7.1", "n": {"x": 5}}]})
    b = spark.createDataFrame([(body,)], "body string")
    fields = {"fiscal_year": ("date", "year"), "revenue": ("rev", "number"), "eps": ("eps", "number"), "x": ("n.x", "number")}
    got = records.map_records(records.json_records(b, "data"), fields, 1000, ("eps", "x"), "T_{fiscal_year}")
    r = got.first()
    assert (r["revenue"], r["eps"], r["x"], r["id"], r["fiscal_year"]) == (300.0, 7.1, 5.0, "T_2027", 2027.0)
    keyed = records.json_records(spark.createDataFrame([('{"a": {"v": 1}, "b": {"v": 2}}',)], "body string"))
    assert sorted(x["rec"]["id"] for x in keyed.collect()) == ["a", "b"]
    source = {"requests": [{"url": "https://x/1?k={{secret:key}}", "fields": {"id": "id", "a": ["a", "number"]}}, {"url": "https://x/2", "fields": {"id": "id", "a": ["a", "number"], "b": "b"}}]}
    bodies = {"https://x/1?k=s": '[{"id": "p", "a": 1}, {"id": "q", "a": 2}]', "https://x/2": '[{"id": "p", "b": "z"}]'}
    got = {r["id"]: (r["a"], r["b"]) for r in records.read_source(spark, source, {"key": "s"}, bodies.__getitem__).collect()}
    assert got == {"p": (1.0, "z"), "q": (2.0, None)}


def test_source_policy():
    for url in ("http://example.com", "https://127.0.0.1/x", "https://10.0.0.1/"):
        with pytest.raises(PlanError):
            records.check_url(url)
    with pytest.raises(PlanError):
        records.check_url("https://inner", lambda h: ["192.168.1.1"])
    records.check_url("https://outer", lambda h: ["93.184.216.34"])
    with pytest.raises(PlanError):
        records.secret("{{secret:not_there_at_all}}", {})


def test_streams(spark, tmp_path):
    folder = tmp_path / "deltas"
    spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("b", 5.0, 1), ("a", 2.0, -1)], "k string, value double, sign int").write.parquet(str(folder))
    stream = spark.readStream.schema("k string, value double, sign int").parquet(str(folder))
    q = feeds.maintained(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: (r["total"], r["n"]) for r in spark.table("kept").collect()} == {"a": (1.0, 1), "b": (5.0, 1)}
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"seq": 1, "at": "x", "by": "y", "op": "set_value", "args": "[]", "kw": "{}"}\n')
    q = feeds.log_stream(spark, str(log)).writeStream.format("memory").queryName("ops").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ops").first()["op"] == "set_value"


def test_workbook(spark):
    import io
    import zipfile

    from planwright.sources import workbook

    e = Engine(spark)
    document.apply(e, DOC)
    e.create_table("d", "facts", {"period": "ref:periods", "v": "number"}, [{"period": "fy2025", "v": 3}])
    e.upsert_rows("d", "pl_lines", [{"id": "facts_total"}, {"id": "both"}, {"id": "spread"}])
    e.set_rules("d", "pl", "facts_total = SUM(facts.v)\nboth = revenue * margin\nspread = MEDIAN(facts.v)", replace=False)
    with zipfile.ZipFile(io.BytesIO(workbook.export(e, "d"))) as z:
        text = {n: z.read(n).decode() for n in z.namelist()}
    first = text["xl/worksheets/sheet1.xml"]
    assert "SUMIFS('t_facts'!$C$2:$C$2,'t_facts'!$B$2:$B$2,&quot;fy2025&quot;)" in first.replace('"fy2025"', "&quot;fy2025&quot;")
    assert "<f>(C3*D3)</f>" in first and "<f>(C2*(1+SUM('t_drivers'!$B$2:$B$2)))</f>" in first and 's="1"' in first
    assert "MEDIAN" in text[f"xl/worksheets/sheet{sum(n.startswith('xl/worksheets') for n in text)}.xml"]
    assert workbook.letter(0) == "A" and workbook.letter(26) == "AA" and workbook.letter(701) == "ZZ"


def test_workbook_holds_whole_tables(spark, monkeypatch):
    import io
    import zipfile

    from planwright.sources import workbook

    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "lines", {}, [{"id": "total"}])
    n = 100_003
    e.create_table("m", "facts", {"v": "number"}, df=spark.range(n).selectExpr("cast(id as string) id", "cast(1 as double) v"))
    e.create_pivot("m", "p", [("line", "lines")], "line")
    e.set_rules("m", "p", "total = SUM(facts.v)")
    with zipfile.ZipFile(io.BytesIO(workbook.export(e, "m"))) as z:
        text = {k: z.read(k).decode() for k in z.namelist()}
    assert f"SUM('t_facts'!$B$2:$B${n + 1})</f><v>{float(n)}</v>" in text["xl/worksheets/sheet1.xml"]
    assert any(x.count("<row ") == n + 1 for x in text.values())
    monkeypatch.setattr(workbook, "MOST_TABLE_ROWS", n - 1)
    with pytest.raises(PlanError) as refused:
        workbook.export(e, "m")
    assert refused.value.code == "EXPORT_TOO_LARGE"


def test_cell_formats(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "lines", {"name": "text", "format": "text"}, [{"id": "revenue", "name": "Revenue", "format": "currency"}, {"id": "margin", "name": "Margin", "format": "percent"}, {"id": "heads", "name": "Heads"}])
    e.create_table("m", "versions", {"format": "text"}, [{"id": "plan"}, {"id": "pct", "format": "percent"}])
    e.create_pivot("m", "p", [("line", "lines"), ("version", "versions")], "line")
    e.set_rules("m", "p", 'revenue = 1234567.8\nrevenue[version=pct] = 0.05\nmargin = 0.1219\nheads = 42\nformat heads = int\nformat revenue[version=pct] = "0.00%"')
    text = grid.markdown(grid.query(e, "m", "p", ["line"], ["version"]))
    assert "$1,234,568" in text and "12.2%" in text and "| 42 |" in text.replace("  ", " ").replace("  ", " ") and "5.00%" in text
    assert grid.markdown(grid.query(e, "m", "p", ["line"], ["version"]), most=60).endswith("characters]")


def test_linked_table_rename_and_copy(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "names", {}, [{"id": "p"}, {"id": "old"}])
    e.create_table("m", "px", {"a": "number"}, [{"id": "old", "a": 1}])
    e.set_source("m", "px", {"url": "https://x/1", "fields": {"id": "id", "a": ["a", "number"]}})
    assert e.refresh("m", "px", get=lambda u: '[{"id": "p", "a": 4}]') == 1
    assert [(r["id"], r["a"]) for r in e.table("m", "px").collect()] == [("p", 4.0)]
    e.create_table("m", "q", {"name": "ref:names"}, [{"name": "p"}])
    c = e.copy()
    e.rename_table("m", "names", "people")
    assert e.model("m").tables["q"].fields["name"].ref == "people" and c.model("m").tables["q"].fields["name"].ref == "names"
    c.set_cell("m", "px", "p", "a", 9)
    assert e.get_field("m", "px", "p", "a") == 4.0 and c.get_field("m", "px", "p", "a") == 9.0


def test_body_source(spark):
    from planwright.sources import http_source

    r = http_source.BodyReader({"urls": json.dumps(["https://a/1", "https://a/1", "https://a/2"])})
    r.get, r.check = (lambda u: f"body of {u}"), (lambda u: None)
    assert [x for p in r.partitions() for x in r.read(p)] == [(0, "https://a/1", "body of https://a/1"), (1, "https://a/2", "body of https://a/2")]
    with pytest.raises(PlanError):
        http_source.BodyReader({"urls": json.dumps([f"https://a/{i}" for i in range(100)])})
    assert http_source.BodySource.name() == "planwright_bodies"
