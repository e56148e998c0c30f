"""Whole models with numbers worked out beside them."""

import pytest

from planwright.engine import Engine
from planwright.errors import PlanError


def near(a, b, by=1e-6):
    return a is not None and not isinstance(a, dict) and abs(a - b) < by


def table(pdf, line, dim="line"):
    return {tuple(r[k] for k in pdf.columns if k not in ("measure", "value", "text", "error", "state", dim)): (r["value"], r["error"]) for _, r in pdf[pdf[dim] == line].iterrows()}


def ids(names):
    return [{"id": n} for n in names.split()]


MONTHS = ("jul25", "aug25", "sep25", "oct25", "nov25", "dec25")


@pytest.fixture(scope="module")
def orchard(spark):
    """Crates picked and bills paid until September, guesses after it."""
    e = Engine(spark)
    e.create_model("m")
    e.create_periods("m", "months", "2025-07", 6, "month", "2025-09-30")
    kinds = {"wages": "cost", "fuel": "cost", "crates": "volume"}
    e.create_table("m", "lines", {"kind": "text"}, [{"id": n, "kind": kinds.get(n, "money")} for n in "crates price sales wages fuel costs surplus levy kept kept_so_far per_crate".split()])
    e.create_table("m", "picks", {"month": "ref:months", "fruit": "text", "crates": "number"}, [{"month": m, "fruit": f, "crates": n} for m, f, n in (("jul25", "apple", 40), ("jul25", "pear", 25), ("aug25", "apple", 55), ("sep25", "pear", 30), ("sep25", "apple", 45.5))])
    e.create_table("m", "bills", {"month": "ref:months", "what": "text", "paid": "number"}, [{"month": m, "what": w, "paid": n} for m, w, n in (("jul25", "wages", 210), ("jul25", "fuel", 38), ("aug25", "wages", 205), ("aug25", "fuel", 31.5), ("sep25", "wages", 150), ("sep25", "wages", 90), ("sep25", "fuel", 44))])
    e.create_table("m", "guess", {}, ids("more raise"))
    e.create_pivot("m", "guesses", [("guess", "guess"), ("month", "months")], line_dim="guess", time_dim="month")
    for m, more, up in (("oct25", 6, 15), ("nov25", -20.5, 0), ("dec25", 3, 12)):
        e.set_value("m", "guesses", {"guess": "more", "month": m}, more)
        e.set_value("m", "guesses", {"guess": "raise", "month": m}, up)
    e.create_pivot("m", "season", [("line", "lines"), ("month", "months")], line_dim="line", time_dim="month")
    e.set_rules("m", "season", """
        crates[frame=hist] = SUM(picks.crates)
        crates[frame=fcst] = PREV(crates) + guesses.more
        price              = 12 - 2% * crates
        sales              = crates * price
        wages[frame=hist]  = SUM(bills.paid[what=wages])
        wages[frame=fcst]  = wages[month-1] + guesses.raise
        fuel[frame=hist]   = SUM(bills.paid[what=fuel])
        fuel[frame=fcst]   = crates * 0.75
        costs              = SUM(value[line.kind = cost])
        surplus            = sales - costs
        levy               = IF(surplus > 350, (surplus - 350) / 5, 0)
        kept               = surplus - levy
        kept_so_far        = CUMSUM(kept)
        per_crate          = kept / crates
    """)
    return e


def orchard_by_hand(more=(6, -20.5, 3)):
    crates, wages = [65, 55, 75.5], [210, 205, 240]
    for m, up in zip(more, (15, 0, 12)):
        crates.append(crates[-1] + m)
        wages.append(wages[-1] + up)
    fuel = [38, 31.5, 44, *(c * 0.75 for c in crates[3:])]
    sales = [c * (12 - 0.02 * c) for c in crates]
    surplus = [s - w - f for s, w, f in zip(sales, wages, fuel)]
    kept = [s - max(0, s - 350) / 5 for s in surplus]
    so_far = [sum(kept[: i + 1]) for i in range(6)]
    return {"crates": crates, "costs": [w + f for w, f in zip(wages, fuel)], "sales": sales, "kept": kept, "kept_so_far": so_far, "per_crate": [k / c for k, c in zip(kept, crates)]}


def test_orchard(orchard):
    got = orchard.cells("m", "season").toPandas()
    assert got["error"].isna().all()
    for line, values in orchard_by_hand().items():
        found = table(got, line)
        for m, v in zip(MONTHS, values):
            assert near(found[(m,)][0], v), (line, m)


def test_an_input_comes_before_every_rule(orchard):
    orchard.set_value("m", "guesses", {"guess": "more", "month": "oct25"}, 10.5)
    assert near(orchard.get("m", "season", {"line": "crates", "month": "dec25"}), orchard_by_hand((10.5, -20.5, 3))["crates"][5])
    orchard.set_value("m", "season", {"line": "crates", "month": "nov25"}, 17)
    assert orchard.get("m", "season", {"line": "crates", "month": "nov25"}) == 17
    assert near(orchard.get("m", "season", {"line": "sales", "month": "nov25"}), 17 * (12 - 0.34))
    assert near(orchard.get("m", "season", {"line": "crates", "month": "dec25"}), 20)
    assert orchard.explain("m", "season", {"line": "crates", "month": "nov25"})["source"] == "input"
    x = orchard.explain("m", "season", {"line": "sales", "month": "aug25"})
    assert x["source"] == "rule" and x["precedents"] == ["crates", "price"] and near(x["value"], 55 * 10.9)


@pytest.mark.parametrize("text,code", [
    ("kept = surplus + lveY", "UNKNOWN_NAME"), ("kept = picks.crates", "SET_IN_SCALAR"), ("pears = 4", "UNKNOWN_TARGET"), ("kept = SUMPRODUCT(2)", "UNKNOWN_FUNCTION"),
    ("kept = PREV(3 * 2)", "BAD_ARG"), ("kept[month=last] = 0", "BAD_CONDITION"), ("kept = sales[", "PARSE"),
])
def test_rules_that_do_not_compile(orchard, text, code):
    with pytest.raises(PlanError) as x:
        orchard.set_rules("m", "season", text, replace=False)
    assert x.value.code == code


def test_loose_rules_report(orchard):
    assert orchard.set_rules("m", "season", "kept = no_such_line", replace=False, strict=False)
    orchard.models["m"].pivots["season"].rules.pop()


def test_pivots_that_feed_each_other(spark):
    """A tank waters a field, the field earns coins, coins plant more of it."""
    e = Engine(spark)
    e.create_model("m")
    e.create_periods("m", "years", "2030-01", 5, "year", "2030-12-31")
    parts = {"tank": "inflow drawn level", "field": "planted thirst harvest", "purse": "spend coins"}
    for p, names in parts.items():
        e.create_table("m", f"{p}_lines", {}, ids(names))
        e.create_pivot("m", p, [("line", f"{p}_lines"), ("year", "years")], line_dim="line", time_dim="year")
    for p, line, v in (("tank", "inflow", 70), ("tank", "level", 400), ("field", "planted", 30), ("field", "harvest", 110), ("purse", "coins", 90)):
        e.set_value("m", p, {"line": line, "year": "fy2030"}, v)
    e.set_rules("m", "tank", "inflow[frame=fcst] = inflow[year-1] * 90% + 12\ndrawn[frame=fcst] = field.thirst\nlevel[frame=fcst] = level[year-1] + inflow - drawn")
    e.set_rules("m", "field", "planted[frame=fcst] = PREV(planted) + purse.spend / 50\nthirst[frame=fcst] = planted * 1.5 - MIN(3, tank.level[year-1] / 100)\nharvest[frame=fcst] = planted * 4 - 10")
    e.set_rules("m", "purse", "spend[frame=fcst] = coins[year-1] / 4\ncoins[frame=fcst] = PREV(coins) + field.harvest[year-1] / 2 - spend")
    inflow, level, planted, harvest, coins, want = 70.0, 400.0, 30.0, 110.0, 90.0, {}
    for y in range(2031, 2035):
        spend = coins / 4
        coins = coins + harvest / 2 - spend
        planted += spend / 50
        thirst = planted * 1.5 - min(3, level / 100)
        inflow = inflow * 0.9 + 12
        level = level + inflow - thirst
        harvest = planted * 4 - 10
        want[f"fy{y}"] = {"tank": {"level": level, "drawn": thirst}, "field": {"harvest": harvest}, "purse": {"coins": coins, "spend": spend}}
    for p in parts:
        got = e.cells("m", p).toPandas()
        assert got["error"].isna().all()
        for y, of in want.items():
            for line, v in of[p].items():
                assert near(table(got, line)[(y,)][0], v), (p, line, y)


def bonus(spark, iterate):
    """A bonus of a tenth of what is left after the bonus; half of that goes to a fund, which earns for the next year."""
    e = Engine(spark)
    e.create_model("m", iterate)
    e.create_periods("m", "years", "2040-01", 4, "year", "2040-12-31")
    e.create_table("m", "lines", {}, ids("earned bonus left fund"))
    e.create_pivot("m", "shop", [("line", "lines"), ("year", "years")], line_dim="line", time_dim="year")
    for line, y, v in (("fund", "fy2040", 64), ("earned", "fy2041", 110), ("earned", "fy2042", -45), ("earned", "fy2043", 330)):
        e.set_value("m", "shop", {"line": line, "year": y}, v)
    e.set_rules("m", "shop", "bonus[frame=fcst] = MAX(0, left) * 10%\nleft[frame=fcst] = earned + PREV(fund) / 16 - bonus\nfund[frame=fcst] = PREV(fund) + left / 2")
    return e


def test_circular_rules_settle(spark):
    got = bonus(spark, {"tolerance": 1e-9}).cells("m", "shop").toPandas()
    assert got["error"].isna().all()
    fund = 64.0
    for y, earned in (("fy2041", 110), ("fy2042", -45), ("fy2043", 330)):
        before = earned + fund / 16
        left = before / 1.1 if before > 0 else before
        fund += left / 2
        for line, v in (("left", left), ("bonus", max(0.0, left) / 10), ("fund", fund)):
            assert near(table(got, line)[(y,)][0], v), (y, line)


def test_circular_rules_without_iteration_are_errors(spark):
    got = bonus(spark, None).cells("m", "shop").toPandas()
    assert table(got, "left")[("fy2042",)][1] == "CYCLE"
    assert table(got, "fund")[("fy2040",)] == (64, None)


@pytest.mark.parametrize("settings,rules,want", [({"max_iterations": 30}, "x = 3 * y - 2\ny = x + 1", "ITER"), (True, "x = 0.25 * y + 6\ny = x", 8)])
def test_loops(spark, settings, rules, want):
    e = Engine(spark)
    e.create_model("m", settings)
    e.create_table("m", "names", {}, ids("x y"))
    e.create_pivot("m", "loop", [("line", "names")], line_dim="line")
    e.set_rules("m", "loop", rules)
    for _, r in e.cells("m", "loop").toPandas().iterrows():
        assert r["error"] == want if want == "ITER" else abs(r["value"] - want) < 0.05


def test_rolling_up_another_pivot(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_periods("m", "months", "2027-04", 3, "month")
    e.create_table("m", "coasts", {}, ids("north south"))
    e.create_table("m", "ports", {"coast": "ref:coasts"}, [{"id": p, "coast": c} for p, c in (("arn", "north"), ("bly", "south"), ("cod", "south"), ("dun", "south"))])
    e.create_table("m", "port_lines", {}, ids("boats before moved"))
    e.create_pivot("m", "harbour", [("port", "ports"), ("line", "port_lines"), ("month", "months")], line_dim="line", time_dim="month")
    boats = {"arn": (7, 9, 4), "bly": (21, 20, 33), "cod": (5, 0, 8), "dun": (2, 2, 2)}
    for p, values in boats.items():
        for m, v in zip(("apr27", "may27", "jun27"), values):
            e.set_value("m", "harbour", {"port": p, "line": "boats", "month": m}, v)
    e.set_rules("m", "harbour", "before = PREV(boats)\nmoved = boats - boats[month-1]")
    e.create_table("m", "coast_lines", {}, ids("moored moved_all part"))
    e.create_pivot("m", "shore", [("coast", "coasts"), ("line", "coast_lines"), ("month", "months")], line_dim="line", time_dim="month")
    e.set_rules("m", "shore", "moored = SUM(harbour.boats[port.coast = @coast])\nmoved_all = SUM(harbour.moved[port.coast = @coast])\npart = moored / SUM(harbour.boats)")
    harbour, shore = e.cells("m", "harbour").toPandas(), e.cells("m", "shore").toPandas()
    assert table(harbour, "moved")[("bly", "jun27")][0] == 13 and table(harbour, "moved")[("cod", "apr27")][0] == 5
    first = table(harbour, "before")[("dun", "apr27")][0]
    assert first != first  # blank
    assert table(shore, "moored")[("south", "may27")][0] == 22 and table(shore, "moored")[("north", "jun27")][0] == 4
    assert table(shore, "moved_all")[("south", "jun27")][0] == 21 and near(table(shore, "part")[("north", "may27")][0], 9 / 31)


def test_masks_and_stretches_of_lines(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "crews", {}, ids("dawn day night relief everyone"))
    e.create_table("m", "lines", {}, ids("heads tea milk sugar rusks drinks"))
    e.create_pivot("m", "mess", [("crew", "crews"), ("line", "lines")], line_dim="line")
    for i, c in enumerate(("dawn", "day", "night", "relief")):
        for line, v in (("heads", 5 * i + 2), ("tea", i + 1), ("milk", 0.5), ("sugar", 3 * i), ("rusks", 100)):
            e.set_value("m", "mess", {"crew": c, "line": line}, v)
    e.set_rules("m", "mess", "heads[crew=everyone] = SUM(heads[crew != everyone])\ndrinks = SUM(value[line = tea..sugar])")
    got = e.cells("m", "mess").toPandas()
    assert table(got, "heads")[("everyone",)][0] == 2 + 7 + 12 + 17
    assert table(got, "drinks")[("night",)][0] == 3 + 0.5 + 6 and table(got, "drinks")[("everyone",)][0] == 0


def test_trees(spark):
    e = Engine(spark)
    e.create_model("m")
    tree = [("all", None, 1), ("upper", "all", 0.7), ("lower", "all", 0.3), ("u1", "upper", 0.25), ("u2", "upper", 0.75), ("u2x", "u2", 0.5)]
    e.create_table("m", "depots", {"above": "ref:depots", "part": "number"}, [{"id": d, "above": a, "part": p} for d, a, p in tree])
    e.create_table("m", "lines", {}, ids("sacks below grant"))
    e.create_pivot("m", "store", [("depot", "depots"), ("line", "lines")], line_dim="line")
    for d, line, v in (("u1", "sacks", 14), ("u2", "sacks", 6), ("lower", "sacks", 31), ("u2x", "sacks", 1), ("all", "grant", 800)):
        e.set_value("m", "store", {"depot": d, "line": line}, v)
    e.set_rules("m", "store", "below = SUM(sacks[depot.above = @depot])\ngrant = grant[depot = @depot.above] * depot.part")
    got = e.cells("m", "store").toPandas()
    assert table(got, "below")[("upper",)][0] == 20 and table(got, "below")[("all",)][0] == 31 and table(got, "below")[("u2",)][0] == 1
    grant = table(got, "grant")
    assert near(grant[("u2x",)][0], 800 * 0.7 * 0.75 * 0.5) and near(grant[("lower",)][0], 240) and grant[("u1",)][1] is None


def test_levels_of_deep_trees(spark):
    """A chain of any depth is followed to its end; loops and members of no tree count nothing."""
    from planwright.plans.planner import levels

    links = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(130)] + [("a", "b"), ("b", "a"), ("lost", "nowhere"), ("side", "n5")]
    schema = "id string, up string"
    assert levels(spark.createDataFrame(links, schema)) == 130
    assert levels(spark.createDataFrame([("a", "a")], schema)) == 1 and levels(spark.createDataFrame([], schema)) == 1


def test_rules_of_tables(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "readers", {"town": "text", "age": "number"}, [{"id": "ida", "town": "Hull", "age": 61}, {"id": "jon", "town": "York", "age": 9}, {"id": "kit", "town": "Hull", "age": 30}])
    loans = [("a1", "jon", 0.4), ("a2", "ida", 2.5), ("a3", "jon", 1.1), ("a4", "kit", 0), ("a5", "jon", -0.5)]
    e.create_table("m", "loans", {"reader": "ref:readers", "fine": "number", "town": "text*", "so_far": "number*", "note": "text*", "opening": "number*", "owed": "number*"}, [{"id": i, "reader": r, "fine": f} for i, r, f in loans])
    e.create_table("m", "lines", {}, ids("loans_made fines"))
    e.create_pivot("m", "desk", [("reader", "readers"), ("line", "lines")], line_dim="line")
    e.set_rules("m", "desk", "loans_made = COUNTA(loans.id)\nfines = SUM(loans.fine) + 0.01 * reader.age")
    assert e.get("m", "desk", {"reader": "jon", "line": "loans_made"}) == 3
    e.set_rules("m", "loans", 'town = reader.town\nso_far = so_far[row-1] + fine\nnote = UPPER(id) & ": " & REPLACE(reader, 1, 1, "*")\nopening = fine[row=first]\nowed = desk.fines[reader=@reader]')
    rows = {r["id"]: r for r in e.table("m", "loans").collect()}
    assert [rows[i]["town"] for i, *_ in loans] == ["York", "Hull", "York", "Hull", "York"] and near(rows["a5"]["so_far"], 3.5) and near(rows["a2"]["so_far"], 2.9)
    assert rows["a2"]["note"] == "A2: *da" and {r["opening"] for r in rows.values()} == {0.4}
    assert near(rows["a1"]["owed"], 1.09) and near(rows["a4"]["owed"], 0.3)


def test_two_ways_to_a_dimension(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_table("m", "airfields", {}, ids("osl ber lis"))
    e.create_table("m", "flights", {"out_of": "ref:airfields", "into": "ref:airfields", "seats": "number"}, [{"id": "f1", "out_of": "osl", "into": "lis", "seats": 180}, {"id": "f2", "out_of": "ber", "into": "osl", "seats": 72}])
    e.create_table("m", "lines", {}, ids("seats_in"))
    e.create_pivot("m", "traffic", [("airfield", "airfields"), ("line", "lines")], line_dim="line")
    with pytest.raises(PlanError) as x:
        e.set_rules("m", "traffic", "seats_in = SUM(flights.seats)")
    assert x.value.code == "AMBIGUOUS_GROUP_KEY" and "out_of=@airfield" in x.value.fix
    e.set_rules("m", "traffic", "seats_in = SUM(flights.seats[into=@airfield])")
    assert [e.get("m", "traffic", {"airfield": a, "line": "seats_in"}) for a in ("osl", "ber", "lis")] == [72, 0, 180]


def test_calendars_and_dates(spark):
    e = Engine(spark)
    e.create_model("m")
    e.create_periods("m", "months", "2031-10", 5, "month", "2031-12-31")
    shifts = [("s1", "2031-10-01", "eyes", 8), ("s2", "2031-10-31", "ears", 6.5), ("s3", "2031-12-31", "eyes", 12), ("s4", "2032-03-01", "eyes", 4), ("s5", "2031-11-15", "eyes", 7.5)]
    e.create_table("m", "shifts", {"day": "date", "ward": "text", "hours": "number", "month": "ref:months*"}, [{"id": i, "day": d, "ward": w, "hours": h} for i, d, w, h in shifts])
    e.set_rules("m", "shifts", "month = PERIOD(day, months)")
    assert {r["id"]: r["month"] for r in e.table("m", "shifts").collect()} == {"s1": "oct31", "s2": "oct31", "s3": "dec31", "s4": None, "s5": "nov31"}
    e.create_distinct("m", "wards", "shifts", "ward")
    e.create_table("m", "lines", {}, ids("worked booked spare"))
    e.create_pivot("m", "roster", [("ward", "wards"), ("line", "lines"), ("month", "months")], line_dim="line")
    e.set_rules("m", "roster", "worked = SUM(shifts.hours[ward=@ward])\nbooked[frame=hist] = worked + 1\nbooked[frame=fcst] = PREV(booked) * 0.5\nspare = booked - worked")
    got = e.cells("m", "roster").toPandas()
    assert table(got, "worked")[("eyes", "dec31")][0] == 12 and near(table(got, "booked")[("eyes", "feb32")][0], 3.25) and near(table(got, "spare")[("ears", "jan32")][0], 0.5)


def test_periods_that_overlap_or_leave_gaps(spark):
    """The period begun last counts, and only until it ends; each row meets one."""
    e = Engine(spark)
    e.create_model("m")
    spans = [("year", "2026-01-01", "2026-12-31"), ("spring", "2026-04-01", "2026-06-30"), ("fair", "2026-05-04", "2026-05-09"), ("fair2", "2026-05-04", "2026-05-20"), ("open", "2026-11-15", None)]
    e.create_table("m", "spans", {"start": "date", "end": "date"}, [{"id": i, "start": a, "end": b} for i, a, b in spans])
    days = {"2025-12-31": None, "2026-01-01": "year", "2026-04-01": "spring", "2026-05-03": "spring", "2026-05-09": "fair2", "2026-05-20": "fair2", "2026-05-21": None, "2026-11-14": None, "2026-11-15": "open", "2031-01-01": "open"}
    e.create_table("m", "visits", {"day": "date", "span": "ref:spans*"}, [{"id": d, "day": d} for d in days] + [{"id": "none"}])
    e.set_rules("m", "visits", "span = PERIOD(day)")
    rows = [(r["id"], r["span"]) for r in e.table("m", "visits").collect()]
    assert len(rows) == len(days) + 1 and dict(rows) == {**days, "none": None}


def test_neighbouring_rows(spark, monkeypatch):
    """Aggregates of rows around a row, in stretches of a few rows each."""
    from planwright.plans import tables

    monkeypatch.setattr(tables, "STRETCH", 5)
    e = Engine(spark)
    e.create_model("m")
    values = [(7 * i) % 23 - 4.5 for i in range(57)]
    e.create_table("m", "rows", {"v": "number", "mean": "number*", "top": "number*", "last": "number*", "next3": "number*"}, [{"id": f"r{i}", "v": v} for i, v in enumerate(values)])
    e.set_rules("m", "rows", "mean = AVG(v[row = this-3 .. this+1])\ntop = MAX(v[row = this .. this+4])\nlast = LAST(v[row = this-2 .. this-1])\nnext3 = SUM(v[row = this+1 .. this+3])")
    got = {r["id"]: r for r in e.table("m", "rows").collect()}
    assert len(got) == 57
    for i in range(57):
        r, part = got[f"r{i}"], lambda a, b: values[max(0, i + a) : max(0, i + b + 1)]  # noqa: E731, B023
        assert near(r["mean"], sum(part(-3, 1)) / len(part(-3, 1))) and r["top"] == max(part(0, 4))
        assert r["last"] == (part(-2, -1)[-1] if i else None) and near(r["next3"], sum(part(1, 3)))
