"""Rules to DataFrame plans.

A pivot becomes one frame: a row for each coordinate of its axes, a pair of columns (value, error) for
each line item and measure.  Cells are grouped into strongly connected sets of the dependency graph and
planned in order: plain projections, shifts and ranges as window functions, sets as aggregates joined
back, recurrences over time as a fold over each coordinate's ordered periods, circular rules as a bounded
iteration inside that fold, recurrences along a hierarchy level by level.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..analyze import refs as R
from ..catalog import ORD, Dim, Model, Pivot, Rule, Table
from ..errors import PlanError
from ..functions import library as lib
from ..functions.values import BLANK, BOOL, DATE, NUM, TEXT, Val, as_text, blank, compare, errors, from_field, is_blank, literal, same, stored, to_field, truth, unify
from ..lang.syntax import At, Bound, Call, Lit, Op, Ref, Selector

Node = tuple[str, str, str | None, str]  # model, pivot, line, measure
MEMBER_LIMIT = 100_000  # line items and pinned members the driver may hold
PASSES = 4  # along a hierarchy, between writes


@dataclass
class Cell:
    kind: str
    value: str
    error: str | None = None
    state: str | None = None


@dataclass
class Frame:
    """A pivot's plan so far.  Axis columns are named d_<dim>, ranks r_<dim>."""

    model: Model
    pivot: Pivot
    df: DataFrame
    cells: dict[Node, Cell] = field(default_factory=dict)
    extra: dict[object, Val | str] = field(default_factory=dict)  # columns added for references, by what they are
    known: dict[str, str] = field(default_factory=dict)


class Scope:
    """Where a rule is evaluated: columns by name, and cells bound to something else than columns."""

    def __init__(self, frame: Frame, line: str | None, column=F.col, bound=None):
        self.frame, self.line, self.column, self.bound = frame, line, column, bound

    def val(self, kind: str, value: str, error: str | None) -> Val:
        return Val(kind, self.column(value), None if error is None else self.column(error))


class Planner:
    def __init__(self, spark: SparkSession, models: dict[str, Model]):
        self.spark, self.models = spark, models
        self.frames: dict[tuple[str, str], Frame] = {}
        self.ready: dict[tuple, DataFrame] = {}
        self._members: dict[tuple[str, str], dict[str, dict]] = {}
        self._ids = itertools.count()
        self.model: Model | None = None
        self.warnings: list[str] = []

    def fresh(self, prefix: str) -> str:
        return f"{prefix}{next(self._ids)}"

    # members

    def members(self, table: str, model: Model | None = None) -> dict[str, dict]:
        """A dimension table's rows by id, in order, for line items and pins."""
        model = model or self.model
        key = (model.id, table)
        if key not in self._members:
            rows = model.table(table).df.orderBy(ORD).limit(MEMBER_LIMIT + 1).collect()
            if len(rows) > MEMBER_LIMIT:
                raise PlanError("TOO_MANY_LINES", f"{table!r} has over {MEMBER_LIMIT} members for line items")
            self._members[key] = {r["id"]: r.asDict() for r in rows}
        return self._members[key]

    def owner(self, pivot: Pivot) -> Model:
        return next(m for m in self.models.values() if m.pivots.get(pivot.id) is pivot)

    def member_id(self, table: str, member: object, model: Model | None = None) -> str:
        """A member by id or else by name; the table is asked, not read whole."""
        model = model or self.model
        text = str(int(member)) if isinstance(member, float) and member == int(member) else str(member)
        key = (model.id, table)
        df = model.table(table).df
        if key in self._members:
            rows = self._members[key]
            if text in rows:
                return text
            hit = next((i for i, r in rows.items() if r.get("name") == text), None)
        else:
            named = F.col("id") == text
            if "name" in df.columns:
                named = named | (F.col("name") == text)
            rows = df.filter(named).orderBy(F.col("id") != text, *([ORD] if ORD in df.columns else ["id"])).select("id").take(1)
            hit = rows[0]["id"] if rows else None
        if hit is None:
            raise PlanError("NO_MEMBER", f"{text!r} is no member of {table!r}")
        return hit

    def edge(self, table: str, which: str, model: Model | None = None) -> str | None:
        """The first or last member."""
        df = (model or self.model).table(table).df
        row = df.orderBy(ORD if which == "first" else F.desc(ORD)).select("id").first()
        return row["id"] if row else None

    def line_matches(self, row: dict, member: str, tests: list[Selector], keys: list, pivot: Pivot | None, line: str | None) -> bool:
        for t in tests:
            have = member if not t.path else row.get(t.path[0])
            if not matches(have, t):
                return False
        for path, right in keys:
            if pivot is None or pivot.line_dim != right[0]:
                raise PlanError("BAD_SELECTOR", "line items are chosen when the rule is read, by literals or @line")
            mine = self.members(pivot.dim(pivot.line_dim).table)[line]
            if str(row.get(path[0])).lower() != str(line if len(right) == 1 else mine.get(right[1])).lower():
                return False
        return True

    # tables

    def table(self, model: Model, id: str, need: set[str] | None = None) -> DataFrame:
        """A table with its computed fields: all, or those that ``need`` takes, so that no others are joined for."""
        from .tables import needed_fields, plan_table

        table = model.table(id)
        only = None if need is None else frozenset(needed_fields(table, need))
        key = (model.id, id, only)
        if key not in self.ready:
            self.ready[key] = plan_table(self, model, table, only)
        return self.ready[key]

    def follow(self, model: Model, table: Table, df: DataFrame, path: tuple[str, ...], name: str) -> tuple[DataFrame, str]:
        """Joins the field at the end of a path of references as column ``name``; its type."""
        first = table.has(path[0])
        if first is None:
            raise PlanError("UNKNOWN_NAME", f"{path[0]!r} is no field of {table.id!r}")
        if len(path) == 1:
            return df.withColumn(name, F.col(first)), "text" if first == "id" else table.fields[first].type
        at, owner = F.col(first), table
        step_from = first
        for i, part in enumerate(path[1:], 1):
            f = owner.fields.get(step_from)
            if f is None or not f.ref:
                raise PlanError("BAD_PATH", f"{step_from!r} is no reference: .{part} can't follow it")
            owner = model.table(f.ref)
            step = owner.has(part)
            if step is None:
                raise PlanError("UNKNOWN_NAME", f"{part!r} is no field of {owner.id!r}")
            if step == "id":
                step_from = "id"
                df = df.withColumn(name, at)
                continue
            temp, key = (name if i == len(path) - 1 else self.fresh("f_")), self.fresh("k_")
            side = self.table(model, owner.id, {step}).select(F.col("id").alias(key), F.col(step).alias(temp))
            df = df.join(side, at == F.col(key), "left").drop(key)
            at, step_from = F.col(temp), step
        return df, "text" if step_from == "id" else owner.fields[step_from].type

    # frames

    def frame(self, model: Model, pivot: Pivot) -> Frame:
        key = (model.id, pivot.id)
        if key not in self.frames:
            df = None
            for d in pivot.axes:
                ids = self.table(model, d.table, set()).select(F.col("id").alias(f"d_{d.id}"), F.col(ORD).alias(f"o_{d.id}"))
                df = ids if df is None else df.crossJoin(ids)
            frame = Frame(model, pivot, self.spark.range(1).select(F.lit(True).alias("one")) if df is None else df)
            self._inputs(frame)
            self.frames[key] = frame
        return self.frames[key]

    def _inputs(self, frame: Frame) -> None:
        """Sparse inputs, one pass: a column of numbers and one of texts for each cell that has any."""
        p = frame.pivot
        axes = [d.id for d in p.axes]
        where = [d.id for d in p.dims]
        df = p.input_df
        if p.inputs:
            rows = []
            for (coords, measure), v in p.inputs.items():
                rows.append((*coords, measure, float(v) if isinstance(v, (int, float)) else None, None if isinstance(v, (int, float)) else str(v)))
            typed = self.spark.createDataFrame(rows, ", ".join([*(f"`{w}` string" for w in where), "measure string, num double, txt string"]))
            df = typed if df is None else df.unionByName(typed)
        if df is None:
            return
        pairs = [(r["line"], r["measure"]) for r in df.select((F.col(p.line_dim) if p.line_dim else F.lit(None).cast("string")).alias("line"), "measure").distinct().collect()]
        aggs = []
        for line, measure in pairs:
            mine = F.col("measure") == measure
            if p.line_dim:
                mine = mine & (F.col(p.line_dim) == line)
            n, t = self.fresh("in_"), self.fresh("it_")
            frame.known[repr((line, measure))] = n
            frame.extra[("input", line, measure)] = (n, t)
            aggs += [F.max(F.when(mine, F.col("num"))).alias(n), F.max(F.when(mine, F.col("txt"))).alias(t)]
        if not aggs:
            return
        if axes:
            wide = df.groupBy(*(F.col(a).alias(f"x_{a}") for a in axes)).agg(*aggs)
            on = None
            for a in axes:
                c = F.col(f"d_{a}") == F.col(f"x_{a}")
                on = c if on is None else on & c
            frame.df = frame.df.join(wide, on, "left").drop(*(f"x_{a}" for a in axes))
        else:
            frame.df = frame.df.crossJoin(df.agg(*aggs))

    def rank(self, frame: Frame, dim: str) -> str:
        """A dense position of a dimension's members, from 0."""
        name = f"r_{dim}"
        if name not in frame.df.columns:
            t = frame.pivot.dim(dim).table
            order = self.table(frame.model, t, set()).select(F.col("id").alias("_rid"), (F.row_number().over(Window.orderBy(ORD)) - 1).alias(name))
            frame.df = frame.df.join(order, F.col(f"d_{dim}") == F.col("_rid")).drop("_rid")
        return name

    def attribute(self, scope: Scope, dim: Dim, path: tuple[str, ...]) -> Val:
        """A member, or an attribute of it."""
        frame = scope.frame
        table = frame.model.table(dim.table)
        if dim.id == frame.pivot.line_dim:
            value: object = scope.line
            owner = table
            for i, part in enumerate(path):
                fid = owner.has(part)
                if fid is None:
                    raise PlanError("UNKNOWN_NAME", f"{part!r} is no field of {owner.id!r}")
                row = self.members(owner.id, frame.model).get(value)
                value = value if fid == "id" else (row or {}).get(fid)
                if i < len(path) - 1:
                    owner = frame.model.table(owner.fields[fid].ref)
            return literal(value) if not hasattr(value, "toordinal") else from_field(F.lit(value), "date")
        if not path:
            return Val(TEXT, scope.column(f"d_{dim.id}"))
        key = ("attr", dim.id, path)
        if key not in frame.extra:
            name, link = self.fresh("a_"), self.fresh("k_")
            side, kind = self.follow(frame.model, table, self.table(frame.model, table.id, {path[0]}), path, name)
            side = side.select(F.col("id").alias(link), name)
            frame.df = frame.df.join(side, F.col(f"d_{dim.id}") == F.col(link), "left").drop(link)
            frame.extra[key] = (name, kind)
        name, kind = frame.extra[key]
        return from_field(scope.column(name), kind)

    # dependencies

    def nodes_of(self, model: Model, pivot: Pivot) -> list[Node]:
        lines = list(R.line_members(self, pivot)) if pivot.line_dim else [None]
        return [(model.id, pivot.id, line, m.id) for line in lines for m in pivot.measures]

    def rules_of(self, model: Model, pivot: Pivot, line: str | None, measure: str) -> list[Rule]:
        out = []
        for r in pivot.rules:
            if r.text.format or not r.valid or r.target != measure:
                continue
            if r.line is not None and R.find_line(self, pivot, r.line) != line:
                if R.find_line(self, pivot, r.line) is None:
                    raise PlanError("UNKNOWN_TARGET", f"{r.line!r} is no line item or measure of {pivot.id!r}")
                continue
            if self._line_condition(model, pivot, line, r):
                out.append(r)
        return out

    def _line_condition(self, model: Model, pivot: Pivot, line: str | None, rule: Rule) -> bool:
        """Whether the parts of a condition that are about the line item hold."""
        for s in rule.text.when:
            if s.kind in ("range", "shift", "match") or (s.kind == "pin" and s.value.word):
                raise PlanError("BAD_CONDITION", "conditions take members, member sets and attribute tests")
            dim, attr = R.dim_of(model, pivot, s.path)
            if dim.id != pivot.line_dim:
                continue
            row = self.members(dim.table)[line]
            test = Selector(s.kind, attr, s.op, s.value, s.values)
            have = line if not attr else row.get(attr[0])
            if not attr and s.kind == "pin":
                want = R.find_line(self, pivot, s.value.member)
                ok = (want == line) == (s.op == "=")
            else:
                ok = matches(have, test)
            if not ok:
                return False
        return True

    def depends(self, node: Node) -> list[tuple[Node, str, int]]:
        """(node, how, by): how is now, shift (in time) or far."""
        model = self.models[node[0]]
        pivot = model.pivots[node[1]]
        self.model = model
        out = []

        def walk(x: object, in_set: bool) -> None:
            if isinstance(x, Call):
                x = R.expand_time(self, model, pivot, x)
            if isinstance(x, Ref):
                found = R.resolve(self, model, pivot, node[2], x, in_set)
                if isinstance(found, R.Cells):
                    owner = self.owner(found.pivot)
                    how, by = "far", 0
                    if found.scalar or (found.line_set and all(p.how == "now" and not p.tests and not p.keys for p in found.picks.values())):
                        moves = [(d, p) for d, p in found.picks.items() if p.how != "now"]
                        if not moves:
                            how = "now"
                        elif len(moves) == 1 and moves[0][1].how == "shift" and moves[0][1].partner == pivot.time_dim:
                            how, by = "shift", moves[0][1].by
                    out.extend(((owner.id, found.pivot.id, line, found.measure), how, by) for line in found.lines)
                elif isinstance(found, R.Column_):
                    out.extend((n, "far", 0) for n in self.table_needs(model, found.table))
            elif isinstance(x, Call):
                for i, a in enumerate(x.args):
                    if x.name == "PERIOD" and i:
                        continue
                    walk(a, in_set or x.name in lib.AGGREGATES)
            elif isinstance(x, Op):
                for a in x.args:
                    walk(a, in_set)

        for r in self.rules_of(model, pivot, node[2], node[3]):
            walk(r.text.body, False)
        return out

    def table_needs(self, model: Model, table: Table, seen: frozenset = frozenset()) -> list[Node]:
        """Cells that a table's computed fields read."""
        if table.id in seen:
            return []
        out = []
        for r in table.rules:
            for ref in R.refs_in(r.text.body):
                if len(ref.parts) > 1 and ref.parts[0] in model.pivots:
                    p = model.pivots[ref.parts[0]]
                    out.extend(self.nodes_of(model, p))
        return out

    def components(self, wanted: list[Node]) -> list[list[Node]]:
        """Strongly connected sets of what is wanted, dependencies first."""
        index: dict[Node, int] = {}
        low: dict[Node, int] = {}
        stack: list[Node] = []
        on: set[Node] = set()
        out: list[list[Node]] = []
        self.edges: dict[Node, list[tuple[Node, str, int]]] = {}
        for root in wanted:
            if root in index:
                continue
            work = [(root, None)]
            while work:
                node, it = work.pop()
                if it is None:
                    index[node] = low[node] = len(index)
                    stack.append(node)
                    on.add(node)
                    self.edges[node] = self.depends(node)
                    it = iter([d for d, *_ in self.edges[node]])
                for d in it:
                    if d not in index:
                        work += [(node, it), (d, None)]
                        break
                    if d in on:
                        low[node] = min(low[node], index[d])
                else:
                    if low[node] == index[node]:
                        group = []
                        while True:
                            x = stack.pop()
                            on.discard(x)
                            group.append(x)
                            if x == node:
                                break
                        out.append(group[::-1])
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
        return out

    # planning

    def pivot(self, model: Model, pivot: Pivot, lines: list[str] | None = None) -> Frame:
        """The frame with the wanted lines' cells planned (all, if none are named), and no others."""
        self.model = model
        wanted = [n for n in self.nodes_of(model, pivot) if lines is None or n[2] in lines]
        frame = self.frame(model, pivot)
        for group in self.components([n for n in wanted if n not in frame.cells]):
            if all(n in self.frames.get(n[:2], Frame(model, pivot, None)).cells for n in group):
                continue
            self._group(group)
        return frame

    def _group(self, group: list[Node]) -> None:
        inside = [(n, d, how, by) for n in group for d, how, by in self.edges[n] if d in set(group)]
        if not inside:
            return self._plain(group[0])
        by_time = {by > 0 for *_, how, by in inside if how == "shift"}
        if all(how in ("now", "shift") for *_, how, _ in inside) and len(by_time) < 2 and all(by != 0 for *_, how, by in inside if how == "shift"):
            from .fold import fold

            return fold(self, group, inside, backwards=by_time == {True})
        return self._levels(group)

    def _plain(self, node: Node) -> None:
        frame = self.frame(self.models[node[0]], self.models[node[0]].pivots[node[1]])
        self.model = frame.model
        v, state = self.cell_value(Scope(frame, node[2]), node)
        self._store(frame, node, v, state)

    def _store(self, frame: Frame, node: Node, v: Val, state: Column | None) -> None:
        value, error, mark = self.fresh("v_"), self.fresh("e_") if v.err is not None else None, self.fresh("s_")
        added = {value: v.col}
        if error:
            added[error] = v.err
        if state is not None:
            added[mark] = state
        frame.df = frame.df.withColumns(added)
        frame.cells[node] = Cell(v.kind, value, error, mark if state is not None else None)

    def _levels(self, group: list[Node]) -> None:
        """A recurrence along a hierarchy or another axis: pass by pass, until every chain has been walked."""
        frames = {n: self.frame(self.models[n[0]], self.models[n[0]].pivots[n[1]]) for n in group}
        passes = max(self._depth(f) for f in frames.values()) * len(group)
        for n, f in frames.items():
            kind = TEXT if next(m for m in f.pivot.measures if m.id == n[3]).type == "text" else NUM
            self._store(f, n, Val(kind, F.lit(None).cast("double" if kind == NUM else "string"), F.lit("CYCLE")), None)
        for turn in range(passes + 1):
            done = {}
            for n, f in frames.items():
                self.model = f.model
                done[n] = self.cell_value(Scope(f, n[2]), n)
            for n, f in frames.items():
                self._store(f, n, *done[n])
            for f in {id(f): f for f in frames.values()}.values():
                self._trim(f, turn % PASSES == PASSES - 1 or turn == passes)

    def _trim(self, frame: Frame, write: bool) -> None:
        """Leaves a frame's axes and cells; what was added for references goes.  They may be written, to go on from there."""
        from .cut import cut

        keep = [c for c in frame.df.columns if c[:2] in ("d_", "o_", "r_") or c == "one"]
        keep += [c for k, v in frame.extra.items() if k[0] == "input" for c in v]
        keep += [c for x in frame.cells.values() for c in (x.value, x.error, x.state) if c]
        frame.df = frame.df.select(*dict.fromkeys(keep))
        if write:
            frame.df = cut(frame.df)
        frame.extra = {k: v for k, v in frame.extra.items() if k[0] == "input"}

    def _depth(self, frame: Frame) -> int:
        """Levels of the deepest hierarchy among a frame's dimensions; of time, its periods."""
        deepest = 1
        for d in frame.pivot.axes:
            t = frame.model.table(d.table)
            for f in t.fields.values():
                if f.ref == t.id:
                    deepest = max(deepest, levels(t.df.select("id", F.col(f.id).alias("up"))))
            if d.id == frame.pivot.time_dim and deepest == 1:
                deepest = t.df.count()
        if deepest > 400:
            raise PlanError("TOO_DEEP", "a recurrence of over 400 steps that no fold can take")
        return deepest

    # cells

    def cell_value(self, scope: Scope, node: Node) -> tuple[Val, Column]:
        """An input, or else the last rule whose condition holds, or else blank; and which it was."""
        frame = scope.frame
        pivot = frame.pivot
        measure = next(m for m in pivot.measures if m.id == node[3])
        branches = []
        for r in self.rules_of(frame.model, pivot, node[2], node[3]):
            v = self.emit(scope, r.text.body)
            branches.append((self.condition(scope, r), v))
        given = frame.extra.get(("input", node[2], node[3]))
        want = {"text": TEXT, "bool": BOOL, "date": DATE}.get(measure.type, NUM)
        values = [v for _, v in branches]
        own = None
        if given:
            n, t = scope.column(given[0]), scope.column(given[1])
            own = Val(TEXT, t) if want == TEXT else Val(want, (n != 0) if want == BOOL else n)
            values.append(own)
        if not values:
            return blank() if want != TEXT else Val(TEXT, F.lit(None).cast("string")), F.lit(0)
        kind, cols = unify(values)
        if kind == BLANK:
            kind, cols = (TEXT, [c.cast("string") for c in cols]) if want == TEXT else (NUM, cols)
        errs = [v.err for v in values]
        value = error = state = None
        rules = list(zip((c for c, _ in branches), cols, errs, strict=False))
        for cond, col, err in rules:  # the last that matches wins
            c = F.lit(True) if cond is None else cond
            value = F.when(c, col) if value is None else F.when(c, col).otherwise(value)
            if err is not None or error is not None:
                e = F.lit(None).cast("string") if err is None else err
                error = F.when(c, e) if error is None else F.when(c, e).otherwise(error)
            state = F.when(c, 1).otherwise(0) if state is None else F.when(c, 1).otherwise(state)
        if own is not None:
            has = own.col.isNotNull()
            value = own.col if value is None else F.when(has, cols[-1]).otherwise(value)
            if error is not None:
                error = F.when(~has, error)
            state = F.when(has, 2).otherwise(F.lit(0) if state is None else state)
        return stored(Val(kind, value, error)), state

    def condition(self, scope: Scope, rule: Rule) -> Column | None:
        out = None
        for s in rule.text.when:
            dim, attr = R.dim_of(scope.frame.model, scope.frame.pivot, s.path)
            if dim.id == scope.frame.pivot.line_dim:
                continue
            if not attr and s.kind == "pin":
                c = scope.column(f"d_{dim.id}") == self.member_id(dim.table, s.value.member)
                c = c if s.op == "=" else ~c
            elif not attr and s.kind == "set":
                c = scope.column(f"d_{dim.id}").isin([self.member_id(dim.table, m) for m in s.values])
                c = c if s.op == "in" else ~c
            else:
                c = predicate(self.attribute(scope, dim, attr), s)
            out = c if out is None else out & c
        return out

    def emit(self, scope: Scope, x: object) -> Val:
        model, pivot = scope.frame.model, scope.frame.pivot
        if isinstance(x, Call):
            x = R.expand_time(self, model, pivot, x)
        if isinstance(x, Lit):
            return literal(x.value)
        if isinstance(x, At):
            dim, attr = R.dim_of(model, pivot, x.path)
            return self.attribute(scope, dim, attr)
        if isinstance(x, Op):
            return lib.operate(x.op, [self.emit(scope, a) for a in x.args])
        if isinstance(x, Call):
            return self._call(scope, x)
        found = R.resolve(self, model, pivot, scope.line, x)
        if isinstance(found, R.Attribute):
            return self.attribute(scope, found.dim, found.path)
        if isinstance(found, R.Column_):
            raise PlanError("SET_IN_SCALAR", f"{'.'.join(x.parts)} is a column of rows", f"SUM({'.'.join(x.parts)})")
        if not found.scalar:
            raise PlanError("SET_IN_SCALAR", f"{'.'.join(x.parts)} is a set of cells", f"SUM({'.'.join(x.parts)})")
        return self._read(scope, found)

    def _call(self, scope: Scope, c: Call) -> Val:
        if c.name == "PERIOD":
            return self._period(scope, c)
        if c.name == "TEXT":
            v = self.emit(scope, c.args[0])
            fmt = c.args[1].value if len(c.args) > 1 and isinstance(c.args[1], Lit) else None
            places = len(fmt) - 2 if isinstance(fmt, str) and fmt.startswith("0.") and set(fmt[2:]) == {"0"} else None
            return lib.text_format(v, places)
        if c.name not in lib.AGGREGATES:
            return lib.call(c.name, [self.emit(scope, a) for a in c.args])
        model, pivot = scope.frame.model, scope.frame.pivot
        args, extra = list(c.args), None
        if c.name == "NPV":
            extra = lib.number(self.emit(scope, args.pop(0)))
        if c.name == "LISTAGG" and len(args) > 1 and isinstance(args[-1], Lit):
            extra = Val(TEXT, F.lit(str(args.pop().value)))
        if c.name in ("FIRST", "LAST") and len(args) == 1 and isinstance(args[0], Ref):
            found = R.resolve(self, model, pivot, scope.line, args[0], True)
            if isinstance(found, R.Cells) and found.here and pivot.time_dim:
                edge = Selector("pin", (R.time_of(self, model, pivot, args[0]),), value=Bound(word=c.name.lower()))
                return self.emit(scope, R.shifted(args[0], edge))
        sets, scalars = [], []
        for a in args:
            a = R.expand_time(self, model, pivot, a) if isinstance(a, Call) else a
            if isinstance(a, Ref):
                found = R.resolve(self, model, pivot, scope.line, a, True)
                if isinstance(found, R.Column_):
                    sets.append(found)
                    continue
                if isinstance(found, R.Cells):
                    if all(p.how in ("now", "pin", "shift", "match") and not p.tests and not p.keys for p in found.picks.values()):
                        one = [R.Cells(found.pivot, found.measure, [line], found.picks) for line in found.lines]
                        scalars += [self._read(scope, o) for o in one]
                    else:
                        sets.append(found)
                    continue
            scalars.append(self.emit(scope, a))
        if not sets:
            out = lib.aggregate_values(c.name, scalars or [blank()], None if extra is None else extra.col)
            return out if extra is None else Val(out.kind, out.col, errors(out, extra))
        if len(sets) == 1 and not scalars:
            return self._set(scope, c.name, sets[0], extra)
        if c.name not in ("SUM", "COUNT", "COUNTA", "COUNTBLANK", "MIN", "MAX"):
            raise PlanError("BAD_ARG", f"{c.name} takes one set, or values")
        parts = [self._set(scope, c.name, s, extra) for s in sets]
        if scalars:
            parts.append(lib.aggregate_values(c.name, scalars))
        return lib.aggregate_values("SUM" if c.name.startswith("COUNT") else c.name, parts)

    # cells elsewhere

    def _source(self, cells: R.Cells) -> Frame:
        return self.frame(self.owner(cells.pivot), cells.pivot)

    def _node(self, source: Frame, cells: R.Cells, line: str | None) -> Node:
        return (source.model.id, cells.pivot.id, line, cells.measure)

    def _read(self, scope: Scope, cells: R.Cells) -> Val:
        """One cell."""
        source = self._source(cells)
        if not cells.lines:
            return blank()
        node = self._node(source, cells, cells.lines[0])
        if scope.bound is not None:
            bound = scope.bound(node, cells)
            if bound is not None:
                return bound
        cell = source.cells[node]
        frame = scope.frame
        if source is frame and cells.here:
            return scope.val(cell.kind, cell.value, cell.error)
        key = ("read", node, cell.value, repr(sorted((d, repr(p)) for d, p in cells.picks.items())))
        if key not in frame.extra:
            frame.extra[key] = self._window_read(frame, source, cells, cell) or self._join_read(scope, source, cells, cell)
        kind, value, error = frame.extra[key]
        return scope.val(kind, value, error)

    def _window_read(self, frame: Frame, source: Frame, cells: R.Cells, cell: Cell):
        """A shift along one axis of the same pivot: lag or lead."""
        moved = [(d, p) for d, p in cells.picks.items() if p.how != "now"]
        if source is not frame or len(moved) != 1 or moved[0][1].how != "shift" or moved[0][0] != moved[0][1].partner:
            return None
        dim, pick = moved[0]
        rest = [f"d_{d.id}" for d in frame.pivot.axes if d.id != dim]
        w = Window.partitionBy(*rest).orderBy(f"o_{dim}")
        value, error = self.fresh("w_"), self.fresh("x_") if cell.error else None
        frame.df = frame.df.withColumn(value, F.lag(cell.value, -pick.by).over(w))
        if error:
            frame.df = frame.df.withColumn(error, F.lag(cell.error, -pick.by).over(w))
        return cell.kind, value, error

    def _keys(self, scope: Scope, source: Frame, picks: dict[str, R.Pick], reading: Frame) -> tuple[DataFrame, list[tuple[Column, str]], Frame]:
        """The source's rows that are asked for, and (reader's column, source's column) to join by."""
        right = source.df
        on: list[tuple[Column, str]] = []
        for d, p in picks.items():
            dim = cells_dim = source.pivot.dim(d)
            if p.how == "pin":
                member = p.member if p.member is not None else self.edge(cells_dim.table, p.edge, source.model)
                right = right.filter(F.col(f"d_{d}") == member)
            elif p.how == "now":
                on.append((F.col(f"d_{p.partner}") if p.partner != reading.pivot.line_dim else F.lit(scope.line), f"d_{d}"))
            elif p.how == "shift":
                on.append((F.col(self.rank(reading, p.partner)) + p.by, self.rank(source, d)))
                right = source.df if right is source.df else right
            elif p.how == "match":
                on.append((self._right(scope, p.right).col, f"d_{d}"))
            for t in p.tests:
                v = Val(TEXT, F.col(f"d_{d}")) if not t.path else self.attribute(Scope(source, None), dim, t.path)
                if not t.path and t.kind in ("pin", "set"):
                    ids = [self.member_id(dim.table, m, source.model) for m in ((t.value.member,) if t.kind == "pin" else t.values)]
                    c = F.col(f"d_{d}").isin(ids)
                    test = c if t.op in ("=", "in") else ~c
                else:
                    test = predicate(v, t)
                right = self._refresh(right, source).filter(test)
            for path, right_path in p.keys:
                v = Val(TEXT, F.col(f"d_{d}")) if path == ("id",) else self.attribute(Scope(source, None), dim, path)
                right = self._refresh(right, source)
                name = self.fresh("g_")
                right = right.withColumn(name, F.lower(as_text(v)))
                on.append((F.lower(as_text(self._right(scope, right_path))), name))
        return right, on, source

    def _refresh(self, right: DataFrame, source: Frame) -> DataFrame:
        """The source's frame with columns added since, under the filters so far."""
        missing = [c for c in source.df.columns if c not in right.columns]
        if not missing:
            return right
        axes = [f"d_{d.id}" for d in source.pivot.axes]
        side = source.df.select(*(F.col(a).alias(f"y{a}") for a in axes), *missing)
        on = None
        for a in axes:
            c = F.col(a) == F.col(f"y{a}")
            on = c if on is None else on & c
        return right.join(side, on).drop(*(f"y{a}" for a in axes))

    def _right(self, scope: Scope, path: tuple[str, ...]) -> Val:
        dim, attr = R.dim_of(scope.frame.model, scope.frame.pivot, path)
        return self.attribute(Scope(scope.frame, scope.line), dim, attr)

    def _attach(self, frame: Frame, right: DataFrame, on: list[tuple[Column, str]], kind: str, value: str, error: str | None, empty: float | None = None):
        """Left-joins looked-up columns to the reading frame."""
        names = [self.fresh("j_") for _ in on]
        side = right.select(*(F.col(r).alias(n) for (_, r), n in zip(on, names, strict=True)), value, *([error] if error else []))
        if on:
            cond = None
            for (left, _), n in zip(on, names, strict=True):
                c = left == F.col(n)
                cond = c if cond is None else cond & c
            frame.df = frame.df.join(side, cond, "left").drop(*names)
        else:
            # One row at most: an aggregate, or a cell with every dimension pinned.
            frame.df = frame.df.join(F.broadcast(side), F.lit(True), "left")
        if empty is not None:
            keep = F.col(value).isNull() if error is None else F.col(value).isNull() & F.col(error).isNull()
            frame.df = frame.df.withColumn(value, F.when(keep, F.lit(empty)).otherwise(F.col(value)))
        return kind, value, error

    def _join_read(self, scope: Scope, source: Frame, cells: R.Cells, cell: Cell):
        right, on, _ = self._keys(scope, source, cells.picks, scope.frame)
        value, error = self.fresh("q_"), self.fresh("x_") if cell.error else None
        right = self._refresh(right, source).withColumn(value, F.col(cell.value))
        if error:
            right = right.withColumn(error, F.col(cell.error))
        return self._attach(scope.frame, right, on, cell.kind, value, error)

    # sets

    def _set(self, scope: Scope, name: str, found, extra: Val | None) -> Val:
        key = ("set", name, repr(found), scope.line if self._uses_line(found, scope) else None, None if extra is None else str(extra.col))
        if isinstance(found, R.Cells):  # as planned so far
            source = self._source(found)
            key += tuple(source.cells[self._node(source, found, line)].value for line in found.lines)
        if key not in scope.frame.extra:
            plan = self._rows_set if isinstance(found, R.Column_) else self._cells_set
            scope.frame.extra[key] = plan(scope, name, found, extra)
        kind, value, error = scope.frame.extra[key]
        return scope.val(kind, value, error)

    def _uses_line(self, found, scope: Scope) -> bool:
        return scope.frame.pivot.line_dim is not None

    def _cells_set(self, scope: Scope, name: str, cells: R.Cells, extra: Val | None):
        frame, source = scope.frame, self._source(cells)
        ranges = [(d, p) for d, p in cells.picks.items() if p.how == "range"]
        if len(ranges) == 1 and all(p.how in ("now", "range") and not p.tests and not p.keys for p in cells.picks.values()) and len(cells.lines) == 1:
            d, p = ranges[0]
            if p.partner and all(b.word in ("this", "first", "last") for b in (p.low, p.high)) and not (p.low.word == "last" or p.high.word == "first"):
                return self._range_window(scope, name, source, cells, d, p, extra)
        picks = {}
        for d, p in cells.picks.items():
            if p.how == "range":
                picks[d] = self._fixed_range(scope, source, d, p)
            else:
                picks[d] = p
        right, on, _ = self._keys(scope, source, picks, frame)
        right = self._refresh(right, source)
        items = [source.cells[self._node(source, cells, line)] for line in cells.lines]
        kinds = [Val(c.kind, F.col(c.value), F.col(c.error) if c.error else None) for c in items]
        if not kinds:
            kinds = [blank()]
        kind, cols = unify(kinds)
        order = F.struct(*(F.col(f"o_{d.id}") for d in source.pivot.axes)) if source.pivot.axes else F.lit(0)
        if len(kinds) == 1:
            v = Val(kind, cols[0], kinds[0].err)
        else:
            packed = F.array(*(F.struct(F.lit(i).alias("i"), c.alias("v"), (k.err if k.err is not None else F.lit(None).cast("string")).alias("e")) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))))
            right = right.withColumn("_cell", F.explode(packed))
            order = F.struct(F.col("_cell.i"), order)
            v = Val(kind, F.col("_cell.v"), F.col("_cell.e") if any(k.err is not None for k in kinds) else None)
        made = lib.aggregate_column(name, v, order, None if extra is None else extra.col)
        value, error = self.fresh("t_"), self.fresh("x_") if made.err is not None else None
        aggs = [made.col.alias(value)] + ([made.err.alias(error)] if error else [])
        grouped = right.groupBy(*(r for _, r in on)).agg(*aggs) if on else right.agg(*aggs)
        return self._attach(frame, grouped, on, made.kind, value, error, 0.0 if name in ("SUM", "COUNT", "COUNTA", "COUNTBLANK", "COUNTD") else None)

    def _fixed_range(self, scope: Scope, source: Frame, d: str, p: R.Pick) -> R.Pick:
        """A range between members: a set of them."""
        table = source.pivot.dim(d).table
        if any(b.word == "this" for b in (p.low, p.high)):
            raise PlanError("BAD_SELECTOR", "a range from the current member stands alone")
        order = list(self.members(table))
        spot = lambda b: {"first": 0, "last": len(order) - 1}.get(b.word) if b.word else order.index(self.member_id(table, b.member))
        chosen = order[spot(p.low) : spot(p.high) + 1]
        return R.Pick("many", p.partner, tests=[*p.tests, Selector("set", (), "in", values=tuple(chosen))], keys=p.keys)

    def _range_window(self, scope: Scope, name: str, source: Frame, cells: R.Cells, d: str, p: R.Pick, extra: Val | None):
        """A range around the current member: a window over the source's rows, read at the same place."""
        cell = source.cells[self._node(source, cells, cells.lines[0])]
        rest = [f"d_{x.id}" for x in source.pivot.axes if x.id != d]
        lo = Window.unboundedPreceding if p.low.word == "first" else p.low.by
        hi = Window.unboundedFollowing if p.high.word == "last" else p.high.by
        w = Window.partitionBy(*rest).orderBy(f"o_{d}").rowsBetween(lo, hi)
        v = Val(cell.kind, F.col(cell.value), F.col(cell.error) if cell.error else None)
        made = over(name, v, w, F.col(f"o_{d}"), extra)
        value, error = self.fresh("n_"), self.fresh("x_") if made.err is not None else None
        source.df = source.df.withColumn(value, made.col)
        if error:
            source.df = source.df.withColumn(error, made.err)
        if source is scope.frame:
            return made.kind, value, error
        picks = {k: R.Pick("now", q.partner) for k, q in cells.picks.items()}
        right, on, _ = self._keys(scope, source, picks, scope.frame)
        copy, copy_e = self.fresh("q_"), self.fresh("x_") if error else None
        right = right.withColumn(copy, F.col(value))
        if copy_e:
            right = right.withColumn(copy_e, F.col(error))
        return self._attach(scope.frame, right, on, made.kind, copy, copy_e)

    # rows of tables

    def _rows_set(self, scope: Scope, name: str, found: R.Column_, extra: Val | None):
        """An aggregate of a table's column, grouped by what the pivot's dimensions are to its rows.

        All aggregates of one table under the same keys are planned together, in one pass over its rows.
        """
        frame = scope.frame
        batch = [(name, found, scope.line, extra)]
        if extra is None:
            batch = self._siblings(scope, name, found)
        signature = self._row_keys(scope, found)
        need = {p[0] for _, p, _ in signature} | {c.path[0] for _, c, _, _ in batch} | {s.path[0] for _, c, _, _ in batch for s in c.selectors}
        if frame.pivot.line_dim:
            need |= {p[0] for p in R.ref_paths(frame.model, found.table, frame.pivot.dim(frame.pivot.line_dim).table)}
        df = self.table(frame.model, found.table.id, need)
        on: list[tuple[Column, str]] = []
        for left, path, ref in signature:
            g = self.fresh("g_")
            df, kind = self.follow(frame.model, found.table, df, path, g)
            if not ref:  # text keys ignore case, and blank meets blank
                df = df.withColumn(g, F.lower(as_text(from_field(F.col(g), kind))))
                left = F.lower(as_text(left))
            else:
                left = left.col
            on.append((left, g))
        aggs, made_all, predicates = [], [], []
        for fn, col, line, ex in batch:
            c = self.fresh("f_")
            df, kind = self.follow(frame.model, found.table, df, col.path, c)
            v = from_field(F.col(c), kind)
            df, pred = self._row_filter(Scope(frame, line), col, df)
            predicates.append(pred)
            if pred is not None:
                v = Val(v.kind, F.when(pred, v.col))
            made = lib.aggregate_column(fn, v, F.col(ORD), None if ex is None else ex.col)
            if fn == "COUNTBLANK" and pred is not None:
                made = Val(NUM, F.count_if(pred & is_blank(from_field(F.col(c), kind))).cast("double"), made.err)
            value, error = self.fresh("t_"), self.fresh("x_") if made.err is not None else None
            aggs += [made.col.alias(value)] + ([made.err.alias(error)] if error else [])
            made_all.append((made.kind, value, error))
        if all(p is not None for p in predicates):
            any_ = predicates[0]
            for p in predicates[1:]:
                any_ = any_ | p
            df = df.filter(any_)
        grouped = df.groupBy(*(g for _, g in on)).agg(*aggs) if on else df.agg(*aggs)
        names = [self.fresh("j_") for _ in on]
        flat = [c for _, v, e in made_all for c in ([v, e] if e else [v])]
        side = grouped.select(*(F.col(g).alias(n) for (_, g), n in zip(on, names, strict=True)), *flat)
        if on:
            cond = None
            for (left, _), n in zip(on, names, strict=True):
                c = left == F.col(n)
                cond = c if cond is None else cond & c
            frame.df = frame.df.join(side, cond, "left").drop(*names)
        else:
            frame.df = frame.df.crossJoin(F.broadcast(side))
        fills = {}
        for (fn, *_), (_, value, error) in zip(batch, made_all, strict=True):
            if fn in ("SUM", "COUNT", "COUNTA", "COUNTBLANK", "COUNTD"):
                empty = F.col(value).isNull() if error is None else F.col(value).isNull() & F.col(error).isNull()
                fills[value] = F.when(empty, F.lit(0.0)).otherwise(F.col(value))
        if fills:
            frame.df = frame.df.withColumns(fills)
        for (fn, col, line, ex), made in zip(batch[1:], made_all[1:], strict=True):
            frame.extra[("set", fn, repr(col), line if frame.pivot.line_dim else None, None)] = made
        return made_all[0]

    def _siblings(self, scope: Scope, name: str, found: R.Column_) -> list[tuple]:
        """This aggregate first, then the pivot's others of the same table and keys."""
        frame = scope.frame
        out = [(name, found, scope.line, None)]
        mine = [(str(left.col), p, r) for left, p, r in self._row_keys(scope, found)]
        seen = {(name, repr(found), scope.line)}

        def walk(x: object, line: str | None) -> None:
            if isinstance(x, Call):
                if x.name in lib.AGGREGATES and x.name not in ("NPV", "LISTAGG") and len(x.args) == 1 and isinstance(x.args[0], Ref):
                    try:
                        other = R.resolve(self, frame.model, frame.pivot, line, x.args[0], True)
                        if isinstance(other, R.Column_) and other.table is found.table and (x.name, repr(other), line) not in seen:
                            if [(str(left.col), p, r) for left, p, r in self._row_keys(Scope(frame, line), other)] == mine:
                                seen.add((x.name, repr(other), line))
                                out.append((x.name, other, line, None))
                    except PlanError:
                        pass  # its own rule will say so
            if isinstance(x, (Op, Call)):
                for a in x.args:
                    walk(a, line)

        lines = list(R.line_members(self, frame.pivot)) if frame.pivot.line_dim else [None]
        for r in frame.pivot.rules:
            if r.text.format:
                continue
            for line in lines:
                if r.line is None or R.find_line(self, frame.pivot, r.line) == line:
                    if self._line_condition(frame.model, frame.pivot, line, r):
                        walk(r.text.body, line)
        return out

    def _row_keys(self, scope: Scope, found: R.Column_) -> list[tuple[Val, tuple[str, ...], bool]]:
        """(reader's value, path in the rows, by reference): explicit keys, then paths found by references."""
        frame, model = scope.frame, scope.frame.model
        out, taken = [], set()
        for s in found.selectors:
            if s.kind == "match":
                dim, attr = R.dim_of(model, frame.pivot, s.right)
                taken.add(dim.id)
                if dim.id == frame.pivot.line_dim:
                    continue  # known when the rule is read: a filter
                f = found.table.fields.get(s.path[0])
                by_ref = len(s.path) == 1 and not attr and f is not None and f.ref == dim.table
                out.append((self.attribute(Scope(frame, scope.line), dim, attr), s.path, by_ref))
        for d in frame.pivot.dims:
            if d.id in taken:
                continue
            if d.table == found.table.id:
                if d.id != frame.pivot.line_dim:
                    out.append((Val(TEXT, F.col(f"d_{d.id}")), ("id",), True))
                continue
            paths = R.ref_paths(model, found.table, d.table)
            if len(paths) > 1:
                raise PlanError("AMBIGUOUS_GROUP_KEY", f"{found.table.id!r} reaches {d.id!r} by {' and '.join('.'.join(p) for p in paths)}", f"SUM({found.table.id}.{'.'.join(found.path)}[{'.'.join(paths[0])}=@{d.id}])")
            if paths and d.id != frame.pivot.line_dim:
                out.append((Val(TEXT, F.col(f"d_{d.id}")), paths[0], True))
            elif not paths and d.id != frame.pivot.line_dim:
                self.warnings.append(f"{found.table.id} has no references to {d.id}: its total repeats for each member")
        return out

    def _row_filter(self, scope: Scope, found: R.Column_, df: DataFrame) -> tuple[DataFrame, Column | None]:
        out = None
        pivot, model = scope.frame.pivot, scope.frame.model
        explicit = {R.dim_of(model, pivot, s.right)[0].id for s in found.selectors if s.kind == "match"}
        tests: list[tuple[tuple[str, ...], Selector | Val]] = []
        for s in found.selectors:
            if s.kind == "match":
                dim, attr = R.dim_of(model, pivot, s.right)
                if dim.id == pivot.line_dim:
                    tests.append((s.path, self.attribute(scope, dim, attr)))
            elif s.kind in ("range", "shift") or (s.kind == "pin" and s.value.word):
                raise PlanError("BAD_SELECTOR", "rows are chosen by [field=literal] and [field=@dim]")
            else:
                tests.append((s.path, s))
        if pivot.line_dim and pivot.line_dim not in explicit:
            paths = R.ref_paths(model, found.table, pivot.dim(pivot.line_dim).table)
            if len(paths) == 1:
                tests.append((paths[0], literal(scope.line)))
        for path, test in tests:
            if len(path) == 1:
                fid = found.table.has(path[0])
                if fid is None:
                    raise PlanError("UNKNOWN_NAME", f"{path[0]!r} is no field of {found.table.id!r}")
                v = from_field(F.col(fid), "text" if fid == "id" else found.table.fields[fid].type)
            else:
                name = self.fresh("f_")
                df, kind = self.follow(model, found.table, df, path, name)
                v = from_field(F.col(name), kind)
            c = same(v, test) if isinstance(test, Val) else predicate(v, test)
            out = c if out is None else out & c
        return df, out

    # dates to periods

    def _period(self, scope: Scope, c: Call) -> Val:
        v = self.emit(scope, c.args[0])
        frame = scope.frame
        key = ("period", repr(c))
        if key not in frame.extra:
            from .tables import period_column

            table = period_table(frame.model, c, frame.pivot)
            name = self.fresh("p_")
            frame.df = period_column(self, frame.model, frame.df, F.date_from_unix_date(v.col.cast("int")), table, name)
            frame.extra[key] = name
        return Val(TEXT, scope.column(frame.extra[key]), v.err)


def levels(links: DataFrame) -> int:
    """The longest chain of links (id, up) that ends; each round doubles how far up a member looks."""
    from .cut import cut

    at = cut(links.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps")))
    reach, members = 1, at.count()
    while reach <= members and not at.filter(F.col("up").isNotNull()).isEmpty():
        above = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        joined = at.join(above, F.col("up") == F.col("_id"), "left")
        at = cut(joined.select("id", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
        reach *= 2
    return 1 + (at.filter(F.col("up").isNull()).agg(F.max("steps")).first()[0] or 0)


def period_table(model: Model, c: Call, of: Pivot | Table) -> Table:
    """The table that PERIOD names, or else the pivot's time, or what a field of the table refers to, or a table of periods."""
    if len(c.args) > 1:
        if not isinstance(c.args[1], Ref) or c.args[1].parts[0] not in model.tables:
            raise PlanError("BAD_ARG", "PERIOD(date, periods) names a periods table")
        return model.table(c.args[1].parts[0])
    spans = lambda t, *more: {"start", "end", *more} <= set(t.fields)
    if isinstance(of, Pivot):
        found = [model.table(d.table) for d in of.axes if d.id == of.time_dim]
    else:
        found = [t for f in of.fields.values() if f.ref and spans(t := model.table(f.ref))]
        found += [t for t in model.tables.values() if spans(t, "frame")]
    if not found or not spans(found[0]):
        raise PlanError("NO_PERIODS", "no table with start and end", "PERIOD(date, periods)")
    return found[0]


def plain(x: object) -> object:
    return x.toordinal() - 719163 if hasattr(x, "toordinal") else x


def matches(have: object, s: Selector) -> bool:
    """A selector's test of a value the driver knows."""
    def key(x: object) -> object:
        if x is None or x == "":
            return ""
        if isinstance(x, bool):
            return float(x)
        try:
            return float(plain(x))
        except (TypeError, ValueError):
            return str(x).lower()

    if s.kind == "set":
        return (key(have) in {key(v) for v in s.values}) == (s.op == "in")
    want = key(s.value.member if isinstance(s.value, Bound) else s.value)
    mine = key(have)
    if s.op in ("=", "!="):
        return (mine == want) == (s.op == "=")
    if isinstance(mine, str) != isinstance(want, str):
        mine, want = (0.0 if x == "" else x for x in (mine, want))
        if isinstance(mine, str) or isinstance(want, str):
            return False
    return {"<": mine < want, "<=": mine <= want, ">": mine > want, ">=": mine >= want}[s.op]


def predicate(v: Val, s: Selector) -> Column:
    """A selector's test of a value in a plan; never null."""
    if s.kind == "set":
        out = F.lit(False)
        if v.kind == TEXT:
            out = F.lower(F.coalesce(v.col, F.lit(""))).isin([str(x).lower() if not isinstance(x, float) or x != int(x) else str(int(x)) for x in s.values])
        else:
            for x in s.values:
                out = out | same(v, literal(x))
        return out if s.op == "in" else ~out
    want = s.value.member if isinstance(s.value, Bound) else s.value
    other = literal(want)
    if v.kind == DATE and isinstance(want, str):
        from ..functions.values import days

        other = days(other)
    c = compare(s.op, v, other)
    c = c.col if c.err is None else F.when(c.err.isNull(), c.col)
    return F.coalesce(c, F.lit(False))


def over(name: str, v: Val, w, order: Column, extra: Val | None) -> Val:
    """An aggregate over a window."""
    err = None if v.err is None else F.min(v.err).over(w)
    from ..functions.values import as_number

    if name in ("SUM", "AVG", "AVERAGE", "MIN", "MAX"):
        n = as_number(v)
        err = None if n.err is None else F.min(n.err).over(w)
        f = {"SUM": F.sum, "AVG": F.avg, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max}[name](n.col.cast("double")).over(w)
        return Val(NUM, F.coalesce(f, F.lit(0.0)) if name == "SUM" else f, err)
    if name == "COUNT":
        return Val(NUM, F.sum(lib.aggregate_count_one(v)).over(w), err)
    if name in ("COUNTA", "COUNTBLANK"):
        hit = is_blank(v) if name == "COUNTBLANK" else ~is_blank(v)
        return Val(NUM, F.sum(hit.cast("double")).over(w), err)
    items = F.sort_array(F.collect_list(F.when(~is_blank(v), F.struct(order.alias("o"), v.col.alias("x")))).over(w))
    xs = F.transform(items, lambda s: s["x"])
    if name in ("FIRST", "LAST"):
        return Val(v.kind, F.get(xs, F.lit(0) if name == "FIRST" else F.size(xs) - 1), err)
    if name == "COUNTD":
        return Val(NUM, F.size(F.array_distinct(F.transform(xs, lambda x: F.lower(x.cast("string"))))).cast("double"), err)
    if name == "LISTAGG":
        return Val(TEXT, lib.joined(F.transform(xs, lambda x: x.cast("string")), None if extra is None else extra.col), err)
    if name == "MEDIAN":
        s = F.sort_array(xs)
        n = F.size(s)
        mid = F.floor(n / 2).cast("int")
        return Val(NUM, F.when(n == 0, None).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2), err)
    if name == "NPV":
        return Val(NUM, lib.npv(extra.col, xs), errors(Val(NUM, xs, err), extra))
    r = lib.irr(xs)
    bad = F.when(r.isNull(), F.lit("NUM"))
    return Val(NUM, r, bad if err is None else F.coalesce(err, bad))


__all__ = ["Cell", "Frame", "Planner", "Scope", "over", "predicate", "to_field", "truth"]
