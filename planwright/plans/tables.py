"""Computed fields of tables: row expressions, paths through references, row order, aggregates, cells.

Row order is kept without one task that sees every row: rows are numbered within the partition they were
read in (the high bits of the order column), and partitions' totals are added up beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..analyze import refs as R
from ..catalog import ORD, SPARK_TYPES, Model, Table
from ..errors import PlanError
from ..functions import library as lib
from ..functions.values import TEXT, Val, as_text, blank, errors, from_field, literal, number, same, stored, to_field
from ..lang.syntax import At, Call, Lit, Op, Ref

PART = F.shiftright(F.col(ORD), 33)
#: Rows of a stretch that one task aggregates neighbours in.
STRETCH = 8_192


def running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A running total in row order."""
    part, here = f"_p{name}", f"_h{name}"
    w = Window.partitionBy(part).orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(part, PART).withColumn(here, value)
    # One row for each partition the table was read in.
    totals = df.groupBy(part).agg(F.sum(here).alias("_t"))
    before = totals.select(F.col(part).alias("_q"), F.coalesce(F.sum("_t").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    df = df.withColumn(name, F.coalesce(F.sum(here).over(w), F.lit(0)))
    return df.join(F.broadcast(before), F.col(part) == F.col("_q")).withColumn(name, F.col(name) + F.col("_before")).drop(part, here, "_q", "_before")


def row_index(df: DataFrame, name: str) -> DataFrame:
    """Position from 0 in row order."""
    return running(df, F.lit(1), name).withColumn(name, F.col(name) - 1)


def period_column(planner, model: Model, df: DataFrame, date: Column, table: Table, name: str) -> DataFrame:
    """The member of a periods table that a date falls in: of the periods begun by then, the one that began last, if it has not ended.

    Generated calendars are joined by the first day of a date's period.  Other periods may overlap or leave gaps; of
    those that begin together the last row counts.  They are cut to the days on which each is the last begun, dealt
    out by month, and joined by month and day, so no row meets two and no join compares all with all.
    """
    periods = planner.table(model, table.id)
    df = df.withColumn("_when", date)
    if table.grain:
        periods = periods.select(F.col("id").alias(name), F.col("start").alias("_ps"))
        unit = {"month": "MM", "quarter": "quarter", "year": "year"}[table.grain]
        df = df.withColumn("_at", F.trunc("_when", unit))
        # Calendars start on a month; a quarter or a year may start on any.
        if table.grain != "month":
            first = periods.agg(F.min(F.month("_ps") - 1).alias("m")).first()["m"] or 0
            months = {"quarter": 3, "year": 12}[table.grain]
            shift = first % months
            df = df.withColumn("_at", F.to_date(F.add_months(F.trunc(F.add_months("_when", -shift), unit), shift)))
        return df.join(periods, F.col("_at") == F.col("_ps"), "left").drop("_at", "_when", "_ps")
    never = F.lit("9999-12-31").cast("date")
    begun = periods.filter(F.col("start").isNotNull()).groupBy(F.col("start").alias("_ps")).agg(F.max_by(F.struct(F.col("id").alias("id"), F.coalesce("end", never).alias("end")), ORD).alias("_p"))
    following = F.coalesce(F.date_sub(F.lead("_ps").over(Window.orderBy("_ps")), 1), never)  # one row a period
    spans = begun.select(F.col("_p.id").alias(name), "_ps", F.least("_p.end", following).alias("_pe")).filter("_pe >= _ps")
    spans = spans.withColumn("_month", F.explode(F.sequence(F.trunc("_ps", "MM"), F.trunc("_pe", "MM"), F.expr("interval 1 month"))))
    out = df.join(spans, (F.trunc("_when", "MM") == F.col("_month")) & (F.col("_ps") <= F.col("_when")) & (F.col("_pe") >= F.col("_when")), "left")
    return out.drop("_when", "_ps", "_pe", "_month")


def needed_fields(table: Table, need: set[str]) -> set[str]:
    """The computed fields that some fields take, by the rules that write them."""
    todo, out = {table.has(n) for n in need} - {None}, set()
    while todo:
        f = todo.pop()
        if f in out or f not in table.fields or not table.fields[f].computed:
            continue
        out.add(f)
        for r in table.rules:
            if r.target == f and r.valid and not r.text.format:
                todo |= own_fields(table, r.text.body, r.text.when)
    return out


def plan_table(planner, model: Model, table: Table, only: frozenset | None = None) -> DataFrame:
    """The table with the computed fields that rules write (all, or ``only`` those)."""
    df = table.df
    for f in table.fields.values():
        if f.computed and f.id not in df.columns:
            df = df.withColumn(f.id, F.lit(None).cast(SPARK_TYPES[f.type]))
    rules: dict[str, list] = {}
    for r in table.rules:
        if r.valid and not r.text.format and (only is None or r.target in only):
            rules.setdefault(r.target, []).append(r)
    t = TablePlan(planner, model, table, df)
    todo = dict(rules)
    while todo:
        free = [f for f, rs in todo.items() if not any(own_fields(table, r.text.body, r.text.when) & (set(todo) - {f}) for r in rs)]
        if not free:
            raise PlanError("CYCLE", f"fields {', '.join(todo)} of {table.id!r} depend on one another")
        for f in free:
            t.compute(f, todo.pop(f))
    return t.df


def own_fields(table: Table, body: object, when: tuple = ()) -> set[str]:
    out = {table.has(s.path[0]) for s in when}
    for ref in R.refs_in(body):
        if ref.parts[0] == table.id and len(ref.parts) > 1:
            out.add(table.has(ref.parts[1]))
        else:
            out.add(table.has(ref.parts[0]))
        out |= {table.has(s.right[0]) for s in ref.selectors if s.kind == "match"}

    def ats(x: object) -> None:
        if isinstance(x, At):
            out.add(table.has(x.path[0]))
        for a in getattr(x, "args", ()):
            ats(a)

    ats(body)
    return out - {None}


class TablePlan:
    def __init__(self, planner, model: Model, table: Table, df: DataFrame):
        self.planner, self.model, self.table, self.df = planner, model, table, df
        self.extra: dict[object, tuple] = {}

    def compute(self, field: str, rules: list) -> None:
        f = self.table.fields[field]
        value: Column | None = None
        err: Column | None = None
        for r in rules:
            self.planner.model = self.model
            v = stored(self.recurrence(field, r.text.body) or self.emit(r.text.body))
            cond = self.condition(r)
            col = to_field(v, f.type)
            if f.type == "ref":
                link = self.planner.fresh("r_")
                known = self.planner.table(self.model, f.ref).select(F.col("id").alias(link)) if f.ref != self.table.id else self.table.df.select(F.col("id").alias(link))
                name = self.planner.fresh("c_")
                self.df = self.df.withColumn(name, col).join(known, F.col(name) == F.col(link), "left")
                col = F.col(link)
            base = F.lit(None).cast(SPARK_TYPES[f.type]) if value is None else value
            value = col if cond is None else F.when(cond, col).otherwise(base)
            if v.err is not None:
                err = v.err if err is None else F.coalesce(v.err, err)
        self.df = self.df.withColumn(field, value)
        if err is not None:
            self.df = self.df.withColumn(f"_err_{field}", err)

    def condition(self, rule) -> Column | None:
        from .planner import predicate

        out = None
        for s in rule.text.when:
            c = predicate(self.path(s.path), s)
            out = c if out is None else out & c
        return out

    def recurrence(self, field: str, body: object) -> Val | None:
        """f = f[row-1] + x as a running total; another rule on its own last row has no plan."""
        def back(x: object) -> bool:
            return isinstance(x, Ref) and self.table.has(x.parts[-1]) == field and len(x.selectors) == 1 and x.selectors[0].kind == "shift" and x.selectors[0].path == ("row",) and x.selectors[0].value == -1

        def any_back(x: object) -> bool:
            return back(x) or any(any_back(a) for a in getattr(x, "args", ()))

        if not any_back(body):
            return None
        if isinstance(body, Op) and body.op in ("+", "-"):
            a, b = body.args
            rest = b if back(a) else a if back(b) and body.op == "+" else None
            if rest is None and body.op in ("+", "-") and isinstance(a, Op) and any_back(a):
                inner = self.flatten(a)
                terms = [(s, t) for s, t in inner if not back(t)] + [(1 if body.op == "+" else -1, b)]
                if sum(back(t) for _, t in inner) == 1 and all(not any_back(t) for _, t in terms):
                    total = None
                    for sign, t in terms:
                        n = number(self.emit(t))
                        total = n.col * sign if total is None else total + n.col * sign
                    return self.run(total)
            if rest is not None and not any_back(rest):
                n = number(self.emit(rest))
                return self.run(n.col if body.op == "+" else -n.col)
        raise PlanError("UNSUPPORTED", f"{field!r} reads its own last row other than by adding to it", f"{field} = {field}[row-1] + x")

    def flatten(self, x: object, sign: int = 1) -> list:
        if isinstance(x, Op) and x.op in ("+", "-"):
            return self.flatten(x.args[0], sign) + self.flatten(x.args[1], sign if x.op == "+" else -sign)
        return [(sign, x)]

    def run(self, col: Column) -> Val:
        name = self.planner.fresh("t_")
        self.df = running(self.df, col, name)
        return Val("num", F.col(name))

    def path(self, path: tuple[str, ...]) -> Val:
        """A field, or one at the end of references."""
        if path[0] == "row":
            return Val("num", F.col(self.index()).cast("double"))
        if len(path) == 1:
            fid = self.table.has(path[0])
            if fid is None:
                raise PlanError("UNKNOWN_NAME", f"{path[0]!r} is no field of {self.table.id!r}")
            v = from_field(F.col(fid), "text" if fid == "id" else self.table.fields[fid].type)
            return Val(v.kind, v.col, F.col(f"_err_{fid}") if f"_err_{fid}" in self.df.columns else None)
        key = ("path", path)
        if key not in self.extra:
            name = self.planner.fresh("p_")
            self.df, kind = self.planner.follow(self.model, self.table, self.df, path, name)
            self.extra[key] = (name, kind)
        name, kind = self.extra[key]
        return from_field(F.col(name), kind)

    def index(self) -> str:
        if "index" not in self.extra:
            name = self.planner.fresh("i_")
            self.df = row_index(self.df, name)
            self.extra["index"] = (name,)
        return self.extra["index"][0]

    def emit(self, x: object) -> Val:
        if isinstance(x, Lit):
            return literal(x.value)
        if isinstance(x, At):
            return self.path(x.path)
        if isinstance(x, Op):
            return lib.operate(x.op, [self.emit(a) for a in x.args])
        if isinstance(x, Call):
            return self.call(x)
        parts = x.parts[1:] if x.parts[0] == self.table.id and len(x.parts) > 1 else x.parts
        if parts[0] == "row" or self.table.has(parts[0]) is not None:
            return self.other_row(parts, x) if x.selectors else self.path((*parts, *x.path))
        if len(parts) > 1 and parts[0] in self.model.pivots:
            return self.cell(x)
        if len(parts) > 1 and parts[0] in self.model.tables:
            raise PlanError("SET_IN_SCALAR", f"{'.'.join(parts)} is a column of rows", f"SUM({'.'.join(parts)})")
        raise PlanError("UNKNOWN_NAME", f"{'.'.join(parts)!r} is no field of {self.table.id!r}")

    def other_row(self, parts: tuple, x: Ref) -> Val:
        """f[row-1], f[row=first], f[row=last]."""
        s = x.selectors[0]
        if len(x.selectors) > 1 or s.path != ("row",) or s.kind not in ("shift", "pin"):
            raise PlanError("BAD_SELECTOR", "a field is read of this row, [row-1], [row=first] or [row=last]")
        v = self.path((*parts, *x.path))
        i, far, got = self.index(), self.planner.fresh("k_"), self.planner.fresh("l_")
        side = self.df.select(F.col(i).alias(far), v.col.alias(got))
        if s.kind == "shift":
            self.df = self.df.join(side, F.col(i) + s.value == F.col(far), "left").drop(far)
        elif s.value.word == "this":
            return v
        else:
            edge = side.agg((F.min_by if s.value.word == "first" else F.max_by)(got, far).alias(got))
            self.df = self.df.crossJoin(F.broadcast(edge))
        return Val(v.kind, F.col(got), v.err)

    def call(self, c: Call) -> Val:
        if c.name in R.TIME_CALLS:
            raise PlanError("NO_TIME_DIM", f"{c.name} is of pivots", "use [row-1]")
        if c.name == "PERIOD":
            from .planner import period_table

            v = self.emit(c.args[0])
            name = self.planner.fresh("p_")
            self.df = period_column(self.planner, self.model, self.df, F.date_from_unix_date(v.col.cast("int")), period_table(self.model, c, self.table), name)
            return Val(TEXT, F.col(name), v.err)
        if c.name == "TEXT":
            fmt = c.args[1].value if len(c.args) > 1 and isinstance(c.args[1], Lit) else ""
            places = len(fmt) - 2 if str(fmt).startswith("0.") and set(fmt[2:]) == {"0"} else None
            return lib.text_format(self.emit(c.args[0]), places)
        if c.name not in lib.AGGREGATES:
            return lib.call(c.name, [self.emit(a) for a in c.args])
        args, extra = list(c.args), None
        if c.name == "NPV":
            extra = number(self.emit(args.pop(0)))
        if len(args) == 1 and isinstance(args[0], Ref):
            ref = args[0]
            parts = ref.parts[1:] if ref.parts[0] == self.table.id and len(ref.parts) > 1 else ref.parts
            if self.table.has(parts[0]) is not None and ref.selectors and ref.selectors[0].kind == "range" and ref.selectors[0].path == ("row",):
                return self.row_range(c.name, parts, ref)
            if len(ref.parts) > 1 and ref.parts[0] in self.model.tables:
                return self.rows(c.name, ref, extra)
            if len(ref.parts) > 1 and ref.parts[0] in self.model.pivots:
                return self.cells(c.name, ref, extra)
        return lib.aggregate_values(c.name, [self.emit(a) for a in args] or [blank()], None if extra is None else extra.col)

    def row_range(self, name: str, parts: tuple, ref: Ref) -> Val:
        from .planner import over

        s = ref.selectors[0]
        v = self.path((*parts, *ref.path))
        if name == "SUM" and s.low.word == "first" and s.high.word == "this" and not s.high.by:
            return self.run(number(v).col)
        got = self.planner.fresh("n_")
        if s.low.word == "this" and s.high.word == "this":
            return self.near_rows(name, v, s.low.by, s.high.by, got)
        low = Window.unboundedPreceding if s.low.word == "first" else s.low.by
        high = Window.unboundedFollowing if s.high.word == "last" else s.high.by
        made = over(name, v, Window.orderBy(ORD).rowsBetween(low, high), F.col(ORD), None)
        self.df = self.df.withColumn(got, made.col)
        return Val(made.kind, F.col(got), made.err)

    def near_rows(self, name: str, v: Val, low: int, high: int, got: str) -> Val:
        """An aggregate of the rows from this+low to this+high: numbered, dealt out by stretches that hold their neighbours' edges too."""
        from .planner import over

        at, block, err = (self.planner.fresh(x) for x in ("i_", "b_", "e_"))
        size = max(STRETCH, 4 * (abs(low) + abs(high)))
        if high < low:
            low, high = high + 1, high  # no row at all
        df = row_index(self.df, at)
        of = lambda shift: F.floor((F.col(at) + shift) / size)
        df = df.withColumn(block, F.explode(F.array_distinct(F.concat(F.array(of(0)), F.sequence(of(-high), of(-low))))))
        made = over(name, v, Window.partitionBy(block).orderBy(at).rowsBetween(low, high), F.col(ORD), None)
        df = df.withColumns({got: made.col} | ({} if made.err is None else {err: made.err}))
        self.df = df.filter(F.col(block) == of(0)).drop(at, block)
        return Val(made.kind, F.col(got), None if made.err is None else F.col(err))

    def rows(self, name: str, ref: Ref, extra: Val | None) -> Val:
        """An aggregate of a table's rows, whole or matched to fields of this row."""
        from .planner import predicate

        other = self.model.table(ref.parts[0])
        df = self.df if other is self.table else self.planner.table(self.model, other.id)
        got = self.planner.fresh("f_")
        df, kind = self.planner.follow(self.model, other, df, (*ref.parts[1:], *ref.path), got)
        on: list[tuple[Column, str]] = []
        for s in ref.selectors:
            field = self.planner.fresh("g_")
            df, k = self.planner.follow(self.model, other, df, s.path, field)
            v = from_field(F.col(field), k)
            if s.kind == "match":
                df = df.withColumn(field, F.lower(as_text(v)))
                on.append((F.lower(as_text(self.path(s.right))), field))
            else:
                df = df.filter(predicate(v, s))
        made = lib.aggregate_column(name, from_field(F.col(got), kind), F.col(ORD), None if extra is None else extra.col)
        value, error = self.planner.fresh("t_"), self.planner.fresh("x_") if made.err is not None else None
        aggs = [made.col.alias(value)] + ([made.err.alias(error)] if error else [])
        names = [self.planner.fresh("j_") for _ in on]
        grouped = (df.groupBy(*(F.col(g).alias(n) for (_, g), n in zip(on, names, strict=True))) if on else df).agg(*aggs)
        return self.attach(grouped, list(zip((left for left, _ in on), names, strict=True)), made.kind, value, error, name)

    def attach(self, side: DataFrame, on: list, kind: str, value: str, error: str | None, name: str = "") -> Val:
        if on:
            cond = None
            for left, n in on:
                c = left == F.col(n)
                cond = c if cond is None else cond & c
            self.df = self.df.join(side, cond, "left").drop(*(n for _, n in on))
        else:
            self.df = self.df.join(F.broadcast(side), F.lit(True), "left")
        col = F.coalesce(F.col(value), F.lit(0.0)) if name in ("SUM", "COUNT", "COUNTA", "COUNTBLANK", "COUNTD") else F.col(value)
        return Val(kind, col, F.col(error) if error else None)

    def _cells(self, ref: Ref, in_set: bool):
        other = self.model.pivots[ref.parts[0]]
        measures = {m.id for m in other.measures}
        name = ref.parts[1]
        line = None if name in measures else R.find_line(self.planner, other, name)
        if line is None and name not in measures:
            raise PlanError("UNKNOWN_NAME", f"{name!r} is no measure or line item of {other.id!r}")
        found = R.cells(self.planner, self.model, None, None, other, name if name in measures else other.measures[0].id, line, ref, True)
        for d, p in found.picks.items():
            if p.how == "many" and not p.tests and not p.keys:
                links = [f.id for f in self.table.fields.values() if f.ref == other.dim(d).table]
                if len(links) == 1 and not any(s.path[0] == d for s in ref.selectors):
                    p.how, p.right = "match", (links[0],)
                elif not in_set:
                    raise PlanError("UNPINNED_DIM", f"{other.id}.{name} leaves {d!r} open", f"{other.id}.{name}[{d}=@...]")
        frame = self.planner.pivot(self.model, other, found.lines if other.line_dim else None)
        self.planner.model = self.model
        return found, frame

    def cell(self, ref: Ref) -> Val:
        """One cell of a pivot, by fields of this row."""
        found, frame = self._cells(ref, False)
        cell = frame.cells[(self.model.id, found.pivot.id, found.lines[0], found.measure)]
        right, on = self._matched(found, frame)
        value, error = self.planner.fresh("q_"), self.planner.fresh("x_") if cell.error else None
        side = right.select(*(F.col(r).alias(n) for _, r, n in on), F.col(cell.value).alias(value), *([F.col(cell.error).alias(error)] if error else []))
        return self.attach(side, [(left, n) for left, _, n in on], cell.kind, value, error)

    def _matched(self, found, frame):
        right, on = frame.df, []
        for d, p in found.picks.items():
            if p.how == "pin":
                member = p.member if p.member is not None else self.planner.edge(found.pivot.dim(d).table, p.edge)
                right = right.filter(F.col(f"d_{d}") == member)
            elif p.how == "match":
                on.append((as_text(self.path(p.right)), f"d_{d}", self.planner.fresh("j_")))
        return right, on

    def cells(self, name: str, ref: Ref, extra: Val | None) -> Val:
        from .planner import predicate, Scope

        found, frame = self._cells(ref, True)
        right, on = self._matched(found, frame)
        for d, p in found.picks.items():
            for t in p.tests:
                right = right.filter(predicate(self.planner.attribute(Scope(frame, None), found.pivot.dim(d), t.path), t))
        items = [frame.cells[(self.model.id, found.pivot.id, line, found.measure)] for line in found.lines]
        packed = F.explode(F.array(*(F.struct(F.col(c.value).cast("double").alias("v"), (F.col(c.error) if c.error else F.lit(None).cast("string")).alias("e")) for c in items)))
        made = lib.aggregate_column(name, Val("num", F.col("_c.v"), F.col("_c.e")), F.lit(0), None if extra is None else extra.col)
        value, error = self.planner.fresh("t_"), self.planner.fresh("x_")
        right = right.withColumn("_c", packed)
        keyed = right.groupBy(*(F.col(r).alias(n) for _, r, n in on)) if on else right
        side = keyed.agg(made.col.alias(value), made.err.alias(error))
        return self.attach(side, [(left, n) for left, _, n in on], made.kind, value, error, name)


__all__ = ["errors", "plan_table", "period_column", "row_index", "running", "same"]
