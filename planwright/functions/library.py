"""The function library: names to builders of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from .values import BLANK, BOOL, DATE, NUM, TEXT, Val, as_number, as_text, blank, compare, days, errors, guarded, is_blank, literal, number, truth, unify

LIBRARY: dict[str, Callable[..., Val]] = {}


def define(*names: str):
    def keep(f: Callable[..., Val]) -> Callable[..., Val]:
        LIBRARY.update(dict.fromkeys(names, f))
        return f

    return keep


def numeric(name: str, f: Callable[..., Column], bad: Callable[..., Column] | None = None, code: str = "NUM", defaults: tuple = ()) -> None:
    """A function of numbers, blank 0; ``bad`` says where it has no value."""

    def build(*args: Val) -> Val:
        need = f.__code__.co_argcount
        args = [*args, *(literal(d) for d in defaults[len(defaults) - (need - len(args)) :] if need > len(args))]
        if len(args) != need:
            raise PlanError("BAD_ARG", f"{name} takes {need} arguments")
        ns = [number(a) for a in args]
        cols = [n.col for n in ns]
        return guarded(NUM, f(*cols), *ns, when=None if bad is None else bad(*cols), code=code)

    LIBRARY[name] = build


def lit(x: float) -> Column:
    return F.lit(float(x))


def call(name: str, args: list[Val]) -> Val:
    if name not in LIBRARY:
        raise PlanError("UNKNOWN_FUNCTION", f"no function {name}")
    return LIBRARY[name](*args)


# operators


def operate(op: str, args: list[Val]) -> Val:
    if op == "neg":
        n = number(args[0])
        return guarded(NUM, -n.col, n)
    if op == "not":
        return guarded(BOOL, ~truth(args[0]), args[0])
    a, b = args
    if op in ("and", "or"):
        # The second side, and its error, count only where the first leaves it open.
        first = truth(a)
        open_ = first if op == "and" else ~first
        col = (first & truth(b)) if op == "and" else (first | truth(b))
        err = a.err
        if b.err is not None:
            later = F.when(open_, b.err)
            err = later if err is None else F.coalesce(err, later)
        return Val(BOOL, col, err)
    if op in ("=", "!=", "<", "<=", ">", ">="):
        return compare(op, a, b)
    if op == "&":
        return guarded(TEXT, F.concat(as_text(a), as_text(b)), a, b)
    x, y = number(a), number(b)
    if op == "/":
        return divide(x, y)
    if op == "^":
        return guarded(NUM, F.pow(x.col, y.col), x, y)
    return guarded(NUM, {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}[op], x, y)


@define("DIVIDE")
def divide(a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    return guarded(NUM, F.try_divide(x.col, y.col), x, y, when=y.col == 0, code="DIV0")


# logic


@define("IF")
def if_(test: Val, yes: Val | None = None, no: Val | None = None) -> Val:
    yes, no = yes or literal(True), no or literal(0)
    kind, (y, n) = unify([yes, no])
    t = truth(test)
    err = test.err
    for v, where in ((yes, t), (no, ~t)):
        if v.err is not None:
            own = F.when(where, v.err)
            err = own if err is None else F.coalesce(err, own)
    return Val(kind, F.when(t, y).otherwise(n), err)


@define("IFERROR")
def iferror(a: Val, b: Val) -> Val:
    if a.err is None:
        return a
    kind, (x, y) = unify([a, b])
    return Val(kind, F.when(a.err.isNull(), x).otherwise(y), None if b.err is None else F.when(a.err.isNotNull(), b.err))


@define("AND")
def and_(*args: Val) -> Val:
    out = args[0]
    for a in args[1:]:
        out = operate("and", [out, a])
    return guarded(BOOL, truth(out), out)


@define("OR")
def or_(*args: Val) -> Val:
    out = args[0]
    for a in args[1:]:
        out = operate("or", [out, a])
    return guarded(BOOL, truth(out), out)


define("NOT")(lambda a: operate("not", [a]))
define("ISBLANK")(lambda a: guarded(BOOL, is_blank(a), a))
define("ISNUMBER")(lambda a: guarded(BOOL, a.col.isNotNull() if a.kind in (NUM, DATE) else F.lit(False), a))
define("ISTEXT")(lambda a: guarded(BOOL, a.col.isNotNull() if a.kind == TEXT else F.lit(False), a))
define("ISLOGICAL")(lambda a: guarded(BOOL, a.col.isNotNull() if a.kind == BOOL else F.lit(False), a))
define("ISERROR")(lambda a: Val(BOOL, F.lit(False) if a.err is None else a.err.isNotNull()))


@define("COALESCE")
def coalesce(*args: Val) -> Val:
    kind, cols = unify(list(args))
    return guarded(kind, F.coalesce(*(F.when(~is_blank(v), c) for v, c in zip(args, cols, strict=True))), *args)


# mathematics

numeric("ABS", lambda x: F.abs(x))
numeric("SQRT", lambda x: F.sqrt(x), lambda x: x < 0)
numeric("EXP", lambda x: F.exp(x))
numeric("LN", lambda x: F.ln(x), lambda x: x <= 0)
numeric("LOG10", lambda x: F.log10(x), lambda x: x <= 0)
numeric("LOG", lambda x, b: F.ln(x) / F.nullif(F.ln(b), lit(0)), lambda x, b: (x <= 0) | (b <= 0) | (b == 1), defaults=(10,))
numeric("SIGN", lambda x: F.signum(x))
numeric("POWER", lambda x, y: F.pow(x, y))
numeric("MOD", lambda x, y: x - y * F.floor(F.try_divide(x, y)), lambda x, y: y == 0)


def _scaled(f: Callable[[Column], Column]) -> Callable[..., Column]:
    def run(x, d):
        m = F.pow(lit(10), d)
        return F.signum(x) * f(F.abs(x * m)) / m

    return run


numeric("ROUND", lambda x, d: _scaled(lambda v: F.floor(v + 0.5))(x, d), defaults=(0,))
numeric("ROUNDUP", lambda x, d: _scaled(F.ceil)(x, d), defaults=(0,))
numeric("ROUNDDOWN", lambda x, d: _scaled(F.floor)(x, d), defaults=(0,))
numeric("TRUNC", lambda x, d: _scaled(F.floor)(x, d), defaults=(0,))
numeric("MROUND", lambda x, m: F.when(m == 0, lit(0)).otherwise(F.floor(F.try_divide(x, m) + 0.5) * m))
LIBRARY["RAND"] = lambda: Val(NUM, F.rand())
numeric("RANDBETWEEN", lambda lo, hi: F.floor(lo + F.rand() * (hi - lo + 1)).cast("double"))


# text


def textual(name: str, f: Callable[..., Column], kinds: str, kind: str = TEXT, defaults: tuple = ()) -> None:
    """``kinds``: t or n for each argument."""

    def build(*args: Val) -> Val:
        missing = len(kinds) - len(args)
        args = [*args, *(literal(d) for d in (defaults[-missing:] if missing > 0 else ()))]
        if len(args) != len(kinds):
            raise PlanError("BAD_ARG", f"{name} takes {len(kinds)} arguments")
        ns = [number(a) if k == "n" else a for a, k in zip(args, kinds, strict=True)]
        cols = [a.col.cast("int") if k == "n" else as_text(a) for a, k in zip(ns, kinds, strict=True)]
        return guarded(kind, f(*cols), *ns)

    LIBRARY[name] = build


define("CONCAT")(lambda *a: guarded(TEXT, F.concat(*(as_text(x) for x in a)), *a))
textual("LEFT", lambda s, n: F.substring(s, F.lit(1), F.when(n < 0, F.greatest(F.length(s) + n, F.lit(0))).otherwise(n)), "tn", defaults=(1,))
textual("RIGHT", lambda s, n: F.when(n == 0, "").when(n < 0, s.substr(1 - n, F.length(s))).otherwise(F.right(s, n)), "tn", defaults=(1,))
textual("MID", lambda s, i, n: s.substr(i, F.greatest(n, F.lit(0))), "tnn")
textual("LEN", lambda s: F.length(s).cast("double"), "t", NUM)
textual("LOWER", lambda s: F.lower(s), "t")
textual("UPPER", lambda s: F.upper(s), "t")
textual("TRIM", lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+", " "), "t")
textual("REPLACE", lambda s, i, n, r: F.concat(s.substr(F.lit(1), i - 1), r, s.substr(i + n, F.length(s))), "tnnt")
textual("SUBSTITUTE", lambda s, o, r: F.when(o == "", s).otherwise(F.replace(s, o, r)), "ttt")
textual("CONTAINS", lambda s, t: F.contains(F.lower(s), F.lower(t)), "tt", BOOL)
textual("STARTSWITH", lambda s, t: F.startswith(F.lower(s), F.lower(t)), "tt", BOOL)
textual("ENDSWITH", lambda s, t: F.endswith(F.lower(s), F.lower(t)), "tt", BOOL)
textual("EXACT", lambda s, t: s == t, "tt", BOOL)
define("STRING")(lambda a: guarded(TEXT, as_text(a), a))
define("VALUE")(number)


def text_format(v: Val, places: int | None) -> Val:
    """TEXT(v, "0.00"): a fixed number of places; other formats leave the text."""
    if places is None or v.kind not in (NUM, DATE):
        return guarded(TEXT, as_text(v), v)
    return guarded(TEXT, F.format_string(f"%.{places}f", v.col), v)


# dates


def dated(name: str, f: Callable[[Column], Column], kind: str = NUM) -> None:
    def build(a: Val) -> Val:
        d = days(a)
        return guarded(kind, f(F.date_from_unix_date(d.col.cast("int"))), d)

    LIBRARY[name] = build


def made(y: Column, m: Column, d: Column) -> Column:
    """A day number; months and days beyond their range carry over."""
    first = F.add_months(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), m.cast("int") - 1)
    return (F.unix_date(first) + d.cast("int") - 1).cast("double")


dated("YEAR", lambda d: F.year(d).cast("double"))
dated("MONTH", lambda d: F.month(d).cast("double"))
dated("DAY", lambda d: F.dayofmonth(d).cast("double"))
dated("QUARTER", lambda d: F.quarter(d).cast("double"))
dated("WEEKDAY", lambda d: F.dayofweek(d).cast("double"))
dated("DATEISO", lambda d: F.date_format(d, "yyyy-MM-dd"), TEXT)
LIBRARY["TODAY"] = lambda: Val(DATE, F.unix_date(F.current_date()).cast("double"))


@define("DATE")
def date(y: Val, m: Val, d: Val) -> Val:
    n = [number(x) for x in (y, m, d)]
    return guarded(DATE, made(*(x.col for x in n)), *n)


def _parts(v: Val) -> tuple[Val, Column, Column, Column]:
    d = days(v)
    date = F.date_from_unix_date(d.col.cast("int"))
    return d, F.year(date), F.month(date), F.dayofmonth(date)


@define("DAYS")
def days_between(a: Val, b: Val) -> Val:
    x, y = days(a), days(b)
    return guarded(NUM, x.col - y.col, x, y)


@define("EOMONTH")
def eomonth(a: Val, k: Val | None = None) -> Val:
    d, y, m, _ = _parts(a)
    n = number(k or literal(0))
    return guarded(DATE, made(y, m + n.col.cast("int") + 1, F.lit(0)), d, n)


@define("SOMONTH")
def somonth(a: Val, k: Val | None = None) -> Val:
    d, y, m, _ = _parts(a)
    n = number(k or literal(0))
    return guarded(DATE, made(y, m + n.col.cast("int"), F.lit(1)), d, n)


@define("DATEOP")
def dateop(a: Val, k: Val, unit: Val | None = None) -> Val:
    d, y, m, day = _parts(a)
    n = number(k)
    i, u = n.col.cast("int"), F.lower(as_text(unit or literal("day")))
    col = F.when(F.startswith(u, F.lit("y")), made(y + i, m, day)).when(F.startswith(u, F.lit("m")), made(y, m + i, day))
    return guarded(DATE, col.when(F.startswith(u, F.lit("w")), d.col + 7 * i).otherwise(d.col + i), d, n)


@define("DATEDIF")
def datedif(a: Val, b: Val, unit: Val | None = None) -> Val:
    x, y1, m1, d1 = _parts(a)
    z, y2, m2, d2 = _parts(b)
    u = F.lower(as_text(unit or literal("d")))
    early = (m2 < m1) | ((m2 == m1) & (d2 < d1))
    years = y2 - y1 - early.cast("int")
    months = (y2 - y1) * 12 + m2 - m1 - (d2 < d1).cast("int")
    return guarded(NUM, F.when(u == "y", years).when(u == "m", months).otherwise(z.col - x.col).cast("double"), x, z)


@define("YEARFRAC")
def yearfrac(a: Val, b: Val) -> Val:
    x, y = days(a), days(b)
    return guarded(NUM, (y.col - x.col) / 365, x, y)


# finance: rates are for a period, payments have the sign of the cash flow


def _pmt(rate, n, pv, fv, kind):
    g = F.pow(1 + rate, n)
    return F.when(rate == 0, -F.try_divide(pv + fv, n)).otherwise(-F.try_divide(rate * (pv * g + fv), (1 + rate * kind) * (g - 1)))


def _ipmt(rate, per, n, pv, fv, kind):
    p, k = _pmt(rate, n, pv, fv, kind), per - 1
    g = F.pow(1 + rate, k)
    grown = F.when(rate == 0, pv + p * k).otherwise(pv * g + p * F.try_divide(g - 1, rate))
    return -F.when(kind != 0, pv + p * k).otherwise(grown) * rate


numeric("PMT", lambda rate, n, pv, fv, kind: _pmt(rate, n, pv, fv, kind), lambda rate, n, pv, fv, kind: n == 0, "DIV0", (0, 0))
numeric("PV", lambda rate, n, p, fv, kind: F.when(rate == 0, -(p * n + fv)).otherwise(-(F.try_divide(p * (1 + rate * kind) * (F.pow(1 + rate, n) - 1), rate) + fv) / F.pow(1 + rate, n)), None, "NUM", (0, 0))
numeric("FV", lambda rate, n, p, pv, kind: F.when(rate == 0, -(pv + p * n)).otherwise(-(pv * F.pow(1 + rate, n) + F.try_divide(p * (1 + rate * kind) * (F.pow(1 + rate, n) - 1), rate))), None, "NUM", (0, 0))


def _nper_ratio(rate, p, pv, fv, kind):
    return F.try_divide(p * (1 + rate * kind) - fv * rate, p * (1 + rate * kind) + pv * rate)


numeric("NPER", lambda rate, p, pv, fv, kind: F.when(rate == 0, -F.try_divide(pv + fv, p)).otherwise(F.try_divide(F.ln(_nper_ratio(rate, p, pv, fv, kind)), F.ln(1 + rate))), lambda rate, p, pv, fv, kind: (rate != 0) & ~F.coalesce(_nper_ratio(rate, p, pv, fv, kind) > 0, F.lit(False)), "NUM", (0, 0))
numeric("SLN", lambda cost, salvage, life: F.try_divide(cost - salvage, life), lambda cost, salvage, life: life == 0, "DIV0")
numeric("SYD", lambda cost, salvage, life, per: F.try_divide((cost - salvage) * (life - per + 1) * 2, life * (life + 1)), lambda cost, salvage, life, per: life == 0, "DIV0")
numeric("GROWTH", lambda base, rate, n: base * F.pow(1 + rate, n))
numeric("IPMT", lambda rate, per, n, pv, fv, kind: _ipmt(rate, per, n, pv, fv, kind), lambda rate, per, n, pv, fv, kind: n == 0, "DIV0", (0, 0))
numeric("PPMT", lambda rate, per, n, pv, fv, kind: _pmt(rate, n, pv, fv, kind) - _ipmt(rate, per, n, pv, fv, kind), lambda rate, per, n, pv, fv, kind: n == 0, "DIV0", (0, 0))


def _ddb(cost, salvage, life, per, factor):
    """Double declining balance: each period's part of what is left, down to the salvage value."""
    start = F.struct(cost.alias("left"), lit(0).alias("now"))

    def step(acc, _):
        take = F.least(F.try_divide(acc["left"] * factor, life), acc["left"] - salvage)
        return F.struct((acc["left"] - take).alias("left"), take.alias("now"))

    return F.when(per < 1, lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(per, lit(1)).cast("int")), start, step, lambda a: a["now"]))


numeric("DDB", lambda cost, salvage, life, per, factor: _ddb(cost, salvage, life, per, factor), lambda cost, salvage, life, per, factor: life == 0, "DIV0", (2,))


def newton(value: Callable[[Column], Column], slope: Callable[[Column], Column], steps: int = 100) -> Column:
    """A root from 0.1, or null if it isn't found in ``steps``."""
    start = F.struct(lit(0.1).alias("r"), F.lit(False).alias("done"))

    def step(acc, _):
        r = acc["r"]
        nxt = r - F.try_divide(value(r), slope(r))
        done = (F.abs(value(r)) < 1e-10) | (F.abs(nxt - r) < 1e-12)
        moved = F.struct(F.when(F.abs(value(r)) < 1e-10, r).otherwise(nxt).alias("r"), F.coalesce(done, F.lit(False)).alias("done"))
        return F.when(acc["done"] | r.isNull(), acc).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: F.when(a["done"], a["r"]))


def rate(n, p, pv, fv, kind):
    f = lambda r: pv * F.pow(1 + r, n) + p * (1 + r * kind) * F.try_divide(F.pow(1 + r, n) - 1, r) + fv
    return newton(f, lambda r: (f(r + 1e-6) - f(r)) / 1e-6)


@define("RATE")
def rate_(*args: Val) -> Val:
    ns = [number(a) for a in [*args, *[literal(0)] * (5 - len(args))]]
    r = rate(*(n.col for n in ns))
    return guarded(NUM, r, *ns, when=r.isNull(), code="NUM")


def npv(rate: Column, flows: Column) -> Column:
    """End-of-period flows (array without nulls)."""
    return F.aggregate(F.transform(flows, lambda v, i: v / F.pow(1 + rate, i + 1)), lit(0), lambda a, x: a + x)


def irr(flows: Column) -> Column:
    total = lambda f: F.aggregate(F.transform(flows, f), lit(0), lambda a, x: a + x)
    return newton(lambda r: total(lambda v, i: v / F.pow(1 + r, i)), lambda r: total(lambda v, i: -i * v / F.pow(1 + r, i + 1)))


# aggregates over arrays of values in order (nulls are blanks)

AGGREGATES = ("SUM", "AVG", "AVERAGE", "COUNT", "COUNTA", "COUNTBLANK", "COUNTD", "MIN", "MAX", "MEDIAN", "FIRST", "LAST", "LISTAGG", "NPV", "IRR")


def result_kind(name: str, kind: str) -> str:
    if name in ("FIRST", "LAST"):
        return kind
    return DATE if name in ("MIN", "MAX") and kind == DATE else TEXT if name == "LISTAGG" else NUM


def joined(texts: Column, separator: Column | None) -> Column:
    return F.call_function("array_join", texts, F.lit(", ") if separator is None else separator)


def aggregate_column(name: str, v: Val, order: Column | None = None, extra: Column | None = None) -> Val:
    """As a Spark aggregate of a group's rows.  ``order``: their order, for FIRST, LAST, LISTAGG, NPV, IRR."""
    err = None if v.err is None else F.min(v.err)
    order = F.lit(0) if order is None else order
    present = ~is_blank(v)
    kind = result_kind(name, v.kind)
    if name in ("COUNTA", "COUNTBLANK"):
        return Val(NUM, F.count_if(present if name == "COUNTA" else ~present).cast("double"), err)
    if name == "COUNTD":
        return Val(NUM, F.count_distinct(F.when(present, F.lower(as_text(v)))).cast("double"), err)
    if name == "COUNT":
        ok = F.lit(False) if v.kind == BOOL else v.col.isNotNull() if v.kind != TEXT else F.coalesce(v.col.try_cast("double").isNotNull() & (v.col != ""), F.lit(False))
        return Val(NUM, F.count_if(ok).cast("double"), err)
    if name in ("FIRST", "LAST"):
        pick = F.min_by if name == "FIRST" else F.max_by
        return Val(kind, pick(v.col, F.when(present, order)), err)
    if name == "LISTAGG":
        items = F.sort_array(F.collect_list(F.when(present, F.struct(order.alias("o"), as_text(v).alias("t")))))
        return Val(TEXT, joined(F.transform(items, lambda x: x["t"]), extra), err)
    n = as_number(v)
    if n.err is not None:
        err = F.min(n.err)
    if name in ("NPV", "IRR"):
        items = F.sort_array(F.collect_list(F.when(n.col.isNotNull(), F.struct(order.alias("o"), n.col.alias("x")))))
        flows = F.transform(items, lambda x: x["x"])
        if name == "NPV":
            return Val(NUM, npv(extra, flows), err)
        r = irr(flows)
        bad = F.when(r.isNull(), F.lit("NUM"))
        return Val(NUM, r, bad if err is None else F.coalesce(err, bad))
    made_ = {"SUM": lambda c: F.coalesce(F.sum(c), lit(0)), "AVG": F.avg, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "MEDIAN": F.median}[name](n.col)
    return Val(kind, made_ if err is None else F.when(err.isNull(), made_), err)


def aggregate_values(name: str, values: list[Val], extra: Column | None = None) -> Val:
    """Of a fixed list of values in one row."""
    if name in ("AVERAGE",):
        name = "AVG"
    err = errors(*values)
    if name in ("COUNTA", "COUNTBLANK"):
        hits = [(~is_blank(v) if name == "COUNTA" else is_blank(v)).cast("double") for v in values]
        return Val(NUM, sum(hits[1:], hits[0]), err)
    if name in ("COUNT",):
        hits = [aggregate_count_one(v) for v in values]
        return Val(NUM, sum(hits[1:], hits[0]), err)
    if name in ("FIRST", "LAST"):
        ordered = values if name == "FIRST" else values[::-1]
        kind, cols = unify(ordered)
        return Val(kind, F.coalesce(*(F.when(~is_blank(v), c) for v, c in zip(ordered, cols, strict=True))), err)
    if name in ("COUNTD", "LISTAGG"):
        texts = F.filter(F.array(*(F.when(~is_blank(v), as_text(v)) for v in values)), lambda x: x.isNotNull())
        if name == "LISTAGG":
            return Val(TEXT, joined(texts, extra), err)
        return Val(NUM, F.size(F.array_distinct(F.transform(texts, F.lower))).cast("double"), err)
    numbers = [as_number(v) for v in values]
    err = errors(*numbers)
    cols = [n.col.cast("double") for n in numbers]
    if name == "SUM":
        parts = [F.coalesce(c, lit(0)) for c in cols]
        out = sum(parts[1:], parts[0])
    elif name == "MIN":
        out = F.least(*cols) if len(cols) > 1 else cols[0]
    elif name == "MAX":
        out = F.greatest(*cols) if len(cols) > 1 else cols[0]
    else:
        some = F.sort_array(F.filter(F.array(*cols), lambda x: x.isNotNull())) if name == "MEDIAN" else F.filter(F.array(*cols), lambda x: x.isNotNull())
        n = F.size(some)
        if name == "AVG":
            out = F.when(n > 0, F.aggregate(some, lit(0), lambda a, x: a + x) / n)
        elif name == "MEDIAN":
            mid = F.floor(n / 2).cast("int")
            out = F.when(n == 0, None).when(n % 2 == 1, F.get(some, mid)).otherwise((F.get(some, mid - 1) + F.get(some, mid)) / 2)
        elif name == "NPV":
            out = npv(extra, some)
        else:
            out = irr(some)
            bad = F.when(out.isNull(), F.lit("NUM"))
            err = bad if err is None else F.coalesce(err, bad)
    kinds = {v.kind for v in values} - {BLANK}
    kind = DATE if name in ("MIN", "MAX") and kinds == {DATE} else NUM
    return Val(kind, out if err is None else F.when(err.isNull(), out), err)


def aggregate_count_one(v: Val) -> Column:
    if v.kind in (BOOL, BLANK):
        return lit(0)
    ok = v.col.isNotNull() if v.kind != TEXT else (v.col != "") & v.col.try_cast("double").isNotNull()
    return F.coalesce(ok, F.lit(False)).cast("double")


__all__ = ["AGGREGATES", "LIBRARY", "aggregate_column", "aggregate_values", "blank", "call", "operate", "text_format"]
