"""The engine: define models, write rules, load rows, read grids, cells and rows.

Reads are lazy plans; nothing is computed until a DataFrame is used.  A write makes later reads plan anew.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as C
from .analyze import refs as R
from .errors import PlanError
from .lang.syntax import Ref
from .operators import calendar, merge
from .plans.planner import Frame, Planner


class Engine:
    def __init__(self, spark: SparkSession, who: str = "engine"):
        self.spark, self.who = spark, who
        self.models: dict[str, C.Model] = {}
        self.version = self.schema_version = 0
        self.log: list[dict] = []
        self._planner: Planner | None = None

    # bookkeeping

    @property
    def planner(self) -> Planner:
        if self._planner is None:
            self._planner = Planner(self.spark, self.models)
        return self._planner

    def _wrote(self, op: str, schema: bool = False, **what: object) -> None:
        self.version += 1
        self.schema_version += schema
        self._planner = None
        self.log.append({"seq": self.version, "at": dt.datetime.now(dt.timezone.utc).isoformat(), "by": self.who, "op": op, **what})

    def model(self, id: str) -> C.Model:
        if id not in self.models:
            raise PlanError("SCHEMA_NO_MODEL", f"no model {id!r}")
        return self.models[id]

    # schema

    def create_model(self, id: str, iterate: bool | dict | None = None) -> C.Model:
        if id in self.models:
            raise PlanError("SCHEMA_DUPLICATE_MODEL", f"there is a model {id!r}")
        self.models[id] = C.Model(id)
        self._wrote("create_model", True, model=id)
        if iterate:
            self.set_iterate(id, iterate)
        return self.models[id]

    def set_iterate(self, model: str, settings: bool | dict) -> None:
        """Circular rules: off, on with 100 passes and a tolerance of 0.001, or as given."""
        self.model(model).iterate = None if settings is False else C.Iterate(**(settings if isinstance(settings, dict) else {}))
        self._wrote("set_iterate", model=model)

    def _new(self, model: str, id: str) -> C.Model:
        m = self.model(model)
        if id in m.tables or id in m.pivots:
            raise PlanError("SCHEMA_DUPLICATE_TABLE", f"{model!r} has {id!r}")
        return m

    def create_table(self, model: str, id: str, fields: list | dict | None = None, rows: list[dict] | None = None, df: DataFrame | None = None, tracked: bool = False) -> C.Table:
        """From inline rows, or over a DataFrame with an ``id`` column and the fields' columns."""
        m = self._new(model, id)
        if isinstance(fields, dict):
            fields = [C.Field.of(v, k) for k, v in fields.items()]
        fs = {f.id: f for f in map(C.Field.of, fields or [])}
        for r in rows or []:  # keys that no field declares become fields
            for k, v in r.items():
                if k != "id" and k not in fs:
                    fs[k] = C.Field(k, "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "bool" if isinstance(v, bool) else "text")
        for f in fs.values():
            if f.ref and f.ref in m.pivots:
                raise PlanError("SCHEMA_REF_NOT_TABULAR", f"{f.id!r} refers to a pivot")
        if df is not None:
            df = C.with_order(df)
            stored = [f for f in fs.values() if not f.computed or f.id in df.columns]
            df = df.select(F.col("id").cast("string").alias("id"), C.ORD, *(C.typed(F.col(f.id), f.type).alias(f.id) for f in stored))
        else:
            stored_fields = {k: f for k, f in fs.items() if not f.computed}
            self._check_rows(m, id, stored_fields, rows or [])
            df = C.rows_frame(self.spark, stored_fields, rows or [])
        t = C.Table(id, fs, df)
        m.tables[id] = t
        self._wrote("create_table", True, model=model, table=id)
        if tracked:
            self.track_table(model, id)
        return t

    def _check_rows(self, m: C.Model, id: str, fields: dict[str, C.Field], rows: list[dict]) -> None:
        ids = [str(r.get("id", i + 1)) for i, r in enumerate(rows)]
        if len(set(ids)) < len(ids):
            raise PlanError("DATA_DUPLICATE_ID", f"{id!r} has rows of one id")
        for f in fields.values():
            if f.ref and rows:
                values = {str(r[f.id]) for r in rows if r.get(f.id) is not None}
                if f.ref == id:
                    unknown = values - set(ids)
                elif f.ref in m.tables:
                    known = m.table(f.ref).df.filter(F.col("id").isin(sorted(values))).select("id").collect() if values else []
                    unknown = values - {r["id"] for r in known}
                else:
                    unknown = set()
                if unknown:
                    raise PlanError("DATA_UNKNOWN_REF", f"{f.id!r} refers to {sorted(unknown)[0]!r}, no row of {f.ref!r}")

    def create_periods(self, model: str, id: str, start: str, count: int, grain: str = "month", hist_until: str | None = None) -> C.Table:
        m = self._new(model, id)
        kinds = {"name": "text", "start": "date", "end": "date", "frame": "text", "year": "number", "quarter": "number", "idx": "number"}
        df = calendar.periods(self.spark, start, count, grain, hist_until)
        m.tables[id] = C.Table(id, {k: C.Field(k, v) for k, v in kinds.items()}, df, grain=grain)
        self._wrote("create_periods", True, model=model, table=id)
        return m.tables[id]

    def create_distinct(self, model: str, id: str, table: str, field: str) -> C.Table:
        """A dimension of a column's values in first-seen order; it follows the column."""
        m = self._new(model, id)
        src = m.table(table)
        df = merge.distinct_dimension(src.df, src.has(field))
        m.tables[id] = C.Table(id, {"name": C.Field("name")}, df, distinct_of=(table, field))
        self._wrote("create_distinct", True, model=model, table=id)
        return m.tables[id]

    def create_pivot(self, model: str, id: str, dims: list, line_dim: str | None = None, time_dim: str | None = None, measures: list | None = None) -> C.Pivot:
        m = self._new(model, id)
        ds = [d if isinstance(d, C.Dim) else C.Dim(*d) if isinstance(d, tuple) else C.Dim(d["id"], d["table"]) for d in dims]
        for d in ds:
            m.table(d.table)
        if len({d.id for d in ds}) < len(ds):
            raise PlanError("SCHEMA_DUPLICATE_DIM", f"{id!r} has two dimensions of one name")
        if time_dim is None:
            time_dim = next((d.id for d in ds if "frame" in m.table(d.table).fields or "period" in d.id.lower()), None)
        ms = [x if isinstance(x, C.Measure) else C.Measure(**{k: v for k, v in x.items() if k in ("id", "type", "format")}) for x in (measures or [{"id": "value"}])]
        m.pivots[id] = C.Pivot(id, ds, ms, line_dim, time_dim)
        self._wrote("create_pivot", True, model=model, pivot=id)
        return m.pivots[id]

    def add_dim(self, model: str, pivot: str, dim: str, table: str) -> None:
        p = self.model(model).pivot(pivot)
        if p.dim(dim):
            raise PlanError("SCHEMA_DUPLICATE_DIM", f"{pivot!r} has {dim!r}")
        p.dims.append(C.Dim(dim, table))
        p.inputs = {}
        self._wrote("add_dim", True, model=model, pivot=pivot)

    def add_measure(self, model: str, pivot: str, measure: dict) -> None:
        p = self.model(model).pivot(pivot)
        if any(x.id == measure["id"] for x in p.measures):
            raise PlanError("SCHEMA_DUPLICATE_MEASURE", f"{pivot!r} has {measure['id']!r}")
        p.measures.append(C.Measure(**measure))
        self._wrote("add_measure", True, model=model, pivot=pivot)

    def add_field(self, model: str, table: str, field: dict | C.Field) -> None:
        t = self.model(model).table(table)
        f = C.Field.of(field)
        if f.id in t.fields or f.id == "id":
            raise PlanError("SCHEMA_DUPLICATE_FIELD", f"{table!r} has {f.id!r}")
        t.fields[f.id] = f
        if not f.computed:
            t.df = t.df.withColumn(f.id, F.lit(None).cast(C.SPARK_TYPES[f.type]))
        self._wrote("add_field", True, model=model, table=table)

    def patch_field(self, model: str, table: str, field: str, **changes: object) -> None:
        t = self.model(model).table(table)
        if t.has(field) is None:
            raise PlanError("SCHEMA_NO_FIELD", f"{table!r} has no {field!r}")
        for k, v in changes.items():
            setattr(t.fields[t.has(field)], k, v)
        self._wrote("patch_field", True, model=model, table=table)

    def patch_measure(self, model: str, pivot: str, measure: str, **changes: object) -> None:
        for x in self.model(model).pivot(pivot).measures:
            if x.id == measure:
                for k, v in changes.items():
                    setattr(x, k, v)
                return self._wrote("patch_measure", True, model=model, pivot=pivot)
        raise PlanError("SCHEMA_NO_MEASURE", f"{pivot!r} has no {measure!r}")

    def drop_field(self, model: str, table: str, field: str) -> None:
        t = self.model(model).table(table)
        t.df = t.df.drop(field)
        t.fields.pop(field)
        t.rules = [r for r in t.rules if r.target != field]
        self._wrote("drop_field", True, model=model, table=table)

    def drop_table(self, model: str, table: str) -> None:
        """Refused while anything refers to it."""
        m = self.model(model)
        users = [t.id for t in m.tables.values() if t.id != table and any(f.ref == table for f in t.fields.values())]
        users += [p.id for p in m.pivots.values() if any(d.table == table for d in p.dims)]
        if users:
            raise PlanError("SCHEMA_IN_USE", f"{table!r} is used by {', '.join(users)}")
        m.tables.pop(table, None)
        m.pivots.pop(table, None)
        self._wrote("drop_table", True, model=model, table=table)

    def drop_model(self, model: str) -> None:
        self.models.pop(self.model(model).id)
        self._wrote("drop_model", True, model=model)

    # data

    def track_table(self, model: str, table: str) -> None:
        """Who added and changed rows, and when."""
        t = self.model(model).table(table)
        t.tracked = True
        for f, kind in merge.AUDIT.items():
            t.fields[f] = C.Field(f, kind)
        t.df = merge.audit(t.df, self.who, self._today(), new=True)
        self._wrote("track_table", True, model=model, table=table)

    def _today(self) -> dt.date:
        return dt.datetime.now(dt.timezone.utc).date()

    def _rows(self, t: C.Table, rows: list[dict] | DataFrame) -> tuple[DataFrame, list[str]]:
        if isinstance(rows, DataFrame):
            given = [c for c in rows.columns if c in t.fields and not t.fields[c].computed]
            return rows.select(F.col("id").cast("string").alias("id"), *(C.typed(F.col(c), t.fields[c].type).alias(c) for c in given)), given
        keys = list(dict.fromkeys(k for r in rows for k in r if k != "id"))
        given = [k for k in keys if k in t.fields and not t.fields[k].computed]
        start = t.df.count() if any("id" not in r for r in rows) else 0
        made = [{**r, "id": r.get("id", start + i + 1)} for i, r in enumerate(rows)]
        return C.rows_frame(self.spark, {k: t.fields[k] for k in given}, made).drop(C.ORD), given

    def insert_rows(self, model: str, table: str, rows: list[dict] | DataFrame) -> None:
        """Ids must be new; references must be known."""
        t = self.model(model).table(table)
        new, given = self._rows(t, rows)
        merge.check_new(t.df, new)
        self._check_refs(model, t, new, given)
        t.df = merge.append(t.df, self._stamp(t, new, True))
        t.version += 1
        self._wrote("insert_rows", model=model, table=table)

    def upsert_rows(self, model: str, table: str, rows: list[dict] | DataFrame, replace: bool = False) -> None:
        """Rows of known ids take the given fields; others are added.  ``replace``: rows not given go."""
        t = self.model(model).table(table)
        new, given = self._rows(t, rows)
        self._check_refs(model, t, new, given)
        t.df = merge.upsert(t.df, new, given, replace)
        if t.tracked:
            t.df = merge.audit_merge(t.df, new, self.who, self._today())
        t.version += 1
        self._wrote("replace_rows" if replace else "upsert_rows", model=model, table=table)
        if replace:
            self._unlink(model, table)

    def delete_rows(self, model: str, table: str, ids: list[str]) -> None:
        """Rows go; references to them become blank."""
        t = self.model(model).table(table)
        t.df = t.df.filter(~F.col("id").isin([str(i) for i in ids]))
        t.version += 1
        self._wrote("delete_rows", model=model, table=table)
        self._unlink(model, table)

    def _unlink(self, model: str, table: str) -> None:
        m = self.model(model)
        for t in m.tables.values():
            for f in t.fields.values():
                if f.ref == table and f.id in t.df.columns:
                    t.df = merge.null_dangling(t.df, f.id, m.table(table).df)

    def _check_refs(self, model: str, t: C.Table, new: DataFrame, given: list[str]) -> None:
        for c in given:
            f = t.fields[c]
            if f.ref:
                known = self.model(model).table(f.ref).df.select("id")
                if f.ref == t.id:
                    known = known.union(new.select("id"))
                bad = merge.unknown_refs(new, c, known).first()
                if bad:
                    raise PlanError("DATA_UNKNOWN_REF", f"{c!r} refers to {bad[0]!r}, no row of {f.ref!r}")

    def _stamp(self, t: C.Table, new: DataFrame, added: bool) -> DataFrame:
        return merge.audit(new, self.who, self._today(), new=added) if t.tracked else new

    def set_cell(self, model: str, table: str, id: str, field: str, value: object) -> None:
        t = self.model(model).table(table)
        fid = t.has(field)
        if fid is None or fid == "id":
            raise PlanError("SCHEMA_NO_FIELD", f"{table!r} has no {field!r}")
        v = F.lit(C.as_date(value) if t.fields[fid].type == "date" else value).cast(C.SPARK_TYPES[t.fields[fid].type])
        t.df = t.df.withColumn(fid, F.when(F.col("id") == id, v).otherwise(F.col(fid)))
        if t.tracked:
            t.df = merge.audit_merge(t.df, self.spark.createDataFrame([(id,)], "id string"), self.who, self._today())
        t.version += 1
        self._wrote("set_cell", model=model, table=table, id=id, field=field)

    def set_value(self, model: str, pivot: str, at: dict, value: object, measure: str | None = None) -> None:
        """An input at one coordinate; None takes it away."""
        m = self.model(model)
        p = m.pivot(pivot)
        self.planner.model = m
        coords = []
        for d in p.dims:
            if d.id not in at:
                raise PlanError("COORD_MISSING_DIM", f"{d.id!r} is missing")
            try:
                coords.append(self.planner.member_id(d.table, at[d.id]))
            except PlanError as e:
                raise PlanError("COORD_NO_MEMBER", str(e)) from None
        key = (tuple(coords), measure or p.measures[0].id)
        if value is None:
            p.inputs.pop(key, None)
        else:
            p.inputs[key] = value
        p.version += 1
        planner = self._planner
        self._wrote("set_value", model=model, pivot=pivot)
        if planner is not None:  # members are as they were
            self._planner = Planner(self.spark, self.models)
            self._planner._members = planner._members

    def set_inputs(self, model: str, pivot: str, df: DataFrame) -> None:
        """Inputs in bulk: a column for each dimension, measure, value."""
        p = self.model(model).pivot(pivot)
        wide = df.select(*(F.col(d.id) for d in p.dims), "measure", F.col("value").try_cast("double").alias("num"), F.when(F.col("value").try_cast("double").isNull(), F.col("value").cast("string")).alias("txt"))
        p.input_df = wide
        self._wrote("set_inputs", model=model, pivot=pivot)

    # rules

    def set_rules(self, model: str, owner: str, text: str, replace: bool = True, strict: bool = True) -> list[str]:
        """Parse, resolve and plan; strict restores the old rules if any is wrong, else wrong ones are kept as invalid."""
        m = self.model(model)
        target = m.tables.get(owner) or m.pivot(owner)
        before = list(target.rules)
        self._planner = None
        problems: list[str] = []
        try:
            found = C.install(target, text, m, replace)
            for r in found:
                try:
                    self._check_rule(m, target, r)
                except PlanError as e:
                    if strict:
                        raise
                    r.valid, r.problem = False, str(e)
                    problems.append(str(e))
        except PlanError:
            target.rules = before
            raise
        self._wrote("set_rules", model=model, owner=owner)
        return problems

    def _check_rule(self, m: C.Model, target: C.Table | C.Pivot, rule: C.Rule) -> None:
        p = self.planner
        p.model = m
        if isinstance(target, C.Pivot):
            if rule.line is not None and R.find_line(p, target, rule.line) is None:
                raise PlanError("UNKNOWN_TARGET", f"{rule.line!r} is no measure or line item of {target.id!r}")
            if rule.text.format:
                return
            lines = [R.find_line(p, target, rule.line)] if rule.line else (list(R.line_members(p, target)) or [None])
            for line in lines[:1] if rule.line else lines:
                if p._line_condition(m, target, line, rule):
                    self._check_expression(m, target, line, rule.text.body)
                    break
        elif not rule.text.format:
            from .plans.tables import own_fields

            own_fields(target, rule.text.body, rule.text.when)

    def _check_expression(self, m: C.Model, pivot: C.Pivot, line: str | None, x: object, in_set: bool = False) -> None:
        from .functions import library as lib
        from .plans.planner import Scope

        if hasattr(x, "name") and hasattr(x, "args"):
            x = R.expand_time(self.planner, m, pivot, x)
        if isinstance(x, Ref):
            found = R.resolve(self.planner, m, pivot, line, x, in_set)
            if isinstance(found, R.Column_):
                if not in_set:
                    raise PlanError("SET_IN_SCALAR", f"{'.'.join(x.parts)} refers to rows", f"SUM({'.'.join(x.parts)})")
                frame = Frame(m, pivot, self.planner.frame(m, pivot).df)
                self.planner._row_keys(Scope(frame, line), found)
            elif isinstance(found, R.Cells) and not in_set and not found.scalar:
                raise PlanError("SET_IN_SCALAR", f"{'.'.join(x.parts)} is a set of cells", f"SUM({'.'.join(x.parts)})")
            return
        name = getattr(x, "name", None)
        if name and name not in lib.AGGREGATES and name not in lib.LIBRARY and name not in ("PERIOD", "TEXT"):
            raise PlanError("UNKNOWN_FUNCTION", f"no function {name}")
        for i, a in enumerate(getattr(x, "args", ())):
            if name == "PERIOD" and i:
                continue
            self._check_expression(m, pivot, line, a, in_set or name in lib.AGGREGATES)

    # reads

    def table(self, model: str, id: str) -> DataFrame:
        """A table with its computed fields, in no order (``_ord`` has it)."""
        return self.planner.table(self.model(model), id)

    def cells(self, model: str, pivot: str, lines: list[str] | None = None) -> DataFrame:
        """Long: a column for each dimension, measure, value, text, error, state (0 blank, 1 rule, 2 input)."""
        m = self.model(model)
        p = m.pivot(pivot)
        frame = self.planner.pivot(m, p, lines)
        items = []
        for (mid, pid, line, measure), c in frame.cells.items():
            if (mid, pid) != (model, pivot) or (lines is not None and line not in lines):
                continue
            numeric = c.kind != "text"
            state = F.col(c.state) if c.state else F.lit(1)
            error = F.col(c.error) if c.error else F.lit(None).cast("string")
            items.append(F.struct(
                F.lit(line).cast("string").alias("line"), F.lit(measure).alias("measure"),
                (F.col(c.value).cast("double") if numeric else F.lit(None).cast("double")).alias("value"),
                (F.lit(None).cast("string") if numeric else F.col(c.value).cast("string")).alias("text"),
                error.alias("error"), F.when(error.isNotNull(), 3).otherwise(state).alias("state"),
            ))
        axes = [F.col(f"d_{d.id}").alias(d.id) for d in p.axes]
        long = frame.df.select(*axes, F.explode(F.array(*items)).alias("_c"))
        line = [F.col("_c.line").alias(p.line_dim)] if p.line_dim else []
        return long.select(*(F.col(d.id) for d in p.axes), *line, "_c.measure", "_c.value", "_c.text", "_c.error", "_c.state").select(*(d.id for d in p.dims), "measure", "value", "text", "error", "state")

    def wide(self, model: str, pivot: str, lines: list[str] | None = None) -> DataFrame:
        """A row a coordinate of the axes, a column a line item (of the first measure), errors as nulls."""
        m = self.model(model)
        p = m.pivot(pivot)
        frame = self.planner.pivot(m, p, lines)
        axes = [F.col(f"d_{d.id}").alias(d.id) for d in p.axes]
        picked = [(n, c) for n, c in frame.cells.items() if n[:2] == (model, pivot) and (lines is None or n[2] in lines) and n[3] == p.measures[0].id]
        return frame.df.select(*axes, *(F.col(c.value).alias(n[2] or n[3]) for n, c in picked))

    def get(self, model: str, pivot: str, at: dict, measure: str | None = None) -> object:
        """One cell: a number, a text, None, or {'error': code}."""
        m = self.model(model)
        p = m.pivot(pivot)
        self.planner.model = m
        line = R.find_line(self.planner, p, at[p.line_dim]) if p.line_dim else None
        frame = self.planner.pivot(m, p, [line])
        c = frame.cells[(model, pivot, line, measure or p.measures[0].id)]
        df = frame.df
        for d in p.axes:
            df = df.filter(F.col(f"d_{d.id}") == self.planner.member_id(d.table, at[d.id]))
        row = df.select(F.col(c.value).alias("v"), (F.col(c.error) if c.error else F.lit(None).cast("string")).alias("e")).first()
        if row is None:
            raise PlanError("COORD_NO_MEMBER", f"no cell at {at}")
        return {"error": row["e"]} if row["e"] is not None else row["v"]

    def get_field(self, model: str, table: str, id: str, field: str) -> object:
        t = self.model(model).table(table)
        row = self.table(model, table).filter(F.col("id") == id).select(t.has(field) or field).first()
        if row is None:
            raise PlanError("DATA_NO_ROW", f"{table!r} has no row {id!r}")
        return row[0]

    def explain(self, model: str, pivot: str, at: dict) -> dict:
        """Where a cell comes from: input, rule or blank; its rule, what the rule reads, other rules."""
        m = self.model(model)
        p = m.pivot(pivot)
        value = self.get(model, pivot, at)
        self.planner.model = m
        line = R.find_line(self.planner, p, at[p.line_dim]) if p.line_dim else None
        coords = {d.id: self.planner.member_id(d.table, at[d.id]) for d in p.dims}
        key = (tuple(coords[d.id] for d in p.dims), p.measures[0].id)
        rules = self.planner.rules_of(m, p, line, p.measures[0].id)
        frame = self.planner.frame(m, p)
        from .plans.planner import Scope

        governing = None
        here = frame.df
        for d in p.axes:
            here = here.filter(F.col(f"d_{d.id}") == coords[d.id])
        for r in reversed(rules):
            cond = self.planner.condition(Scope(frame, line), r)
            here2 = frame.df
            for d in p.axes:
                here2 = here2.filter(F.col(f"d_{d.id}") == coords[d.id])
            if cond is None or not here2.filter(cond).isEmpty():
                governing = r
                break
        source = "input" if key in p.inputs else "rule" if governing else "blank"
        reads = []
        if source == "rule":
            for ref in R.refs_in(governing.text.body):
                reads.append(".".join(ref.parts))
        users = sorted({f"{o.id}.{r.line or r.target}" for mm in self.models.values() for o in [*mm.pivots.values(), *mm.tables.values()] for r in o.rules for ref in R.refs_in(r.text.body) if ref.parts[-1] in (line, at.get(p.line_dim)) and (len(ref.parts) > 1 and ref.parts[-2] == pivot or len(ref.parts) == 1 and o is p)})
        return {"value": value, "source": source, "rule": governing.text.text if source == "rule" else None, "precedents": reads, "other_rules": [r.text.text for r in rules if r is not governing], "referenced_by": users}

    def describe(self) -> dict:
        """The schema as plain data."""
        return {
            m.id: {
                "tables": {t.id: {f.id: {"type": f.type, "ref": f.ref, "computed": f.computed} for f in t.fields.values()} for t in m.tables.values()},
                "pivots": {p.id: {"dims": {d.id: d.table for d in p.dims}, "line": p.line_dim, "time": p.time_dim, "measures": [x.id for x in p.measures], "rules": [r.text.text for r in p.rules]} for p in m.pivots.values()},
            }
            for m in self.models.values()
        }

    def cell_format(self, model: str, pivot: str, at: dict, measure: str | None = None) -> str | None:
        """How a cell is written: the last format rule that holds there, else what its members declare (a
        percentage first, then the last dimension's), else the measure's."""
        from .functions.formats import read_format
        from .plans.planner import matches

        m = self.model(model)
        p = m.pivot(pivot)
        rows = {d.id: self.planner.members(d.table, m).get(at.get(d.id), {}) for d in p.dims}
        for r in reversed(p.rules):
            if not r.text.format or (r.line is not None and R.find_line(self.planner, p, r.line) != at.get(p.line_dim)):
                continue
            ok = True
            for s in r.text.when:
                dim, attr = R.dim_of(m, p, s.path)
                ok = ok and matches(rows[dim.id].get(attr[0]) if attr else at.get(dim.id), s)
            if ok:
                return str(r.text.body.value)
        declared = [rows[d.id]["format"] for d in p.dims if rows[d.id].get("format")]
        for f in declared:
            spec = read_format(f)
            if spec and spec.percent:
                return f
        if declared:
            return declared[-1]
        return next((x.format for x in p.measures if x.id == (measure or p.measures[0].id)), None)

    # linked tables and copies

    def set_source(self, model: str, table: str, source: dict) -> None:
        """Where a table's rows come from (see sources.records.read_source)."""
        self.model(model).table(table).source = dict(source)
        self._wrote("set_source", model=model, table=table)

    def refresh(self, model: str, table: str, secrets: dict | None = None, get=None) -> int:
        """Fetches a linked table's rows and replaces (or, mode 'upsert', merges) them; how many came."""
        from .sources import records

        t = self.model(model).table(table)
        if not t.source:
            raise PlanError("BAD_SOURCE", f"{table!r} has no source")
        rows = records.read_source(self.spark, t.source, secrets, **({"get": get} if get else {}))
        self.upsert_rows(model, table, rows, replace=t.source.get("mode", "replace") == "replace")
        t.source |= {"refreshed_at": dt.datetime.now(dt.timezone.utc).isoformat(), "rows": rows.count()}
        return t.source["rows"]

    def rename_table(self, model: str, table: str, new: str) -> None:
        """References, dimensions and sources follow."""
        m = self._new(model, new)
        t = m.tables.pop(table)
        t.id = new
        m.tables[new] = t
        for other in m.tables.values():
            for f in other.fields.values():
                f.ref = new if f.ref == table else f.ref
        for p in m.pivots.values():
            for d in p.dims:
                d.table = new if d.table == table else d.table
        self._wrote("rename_table", True, model=model, table=new)

    def copy(self) -> "Engine":
        """Another engine with the same models; writes to one leave the other."""
        from dataclasses import replace

        e = Engine(self.spark, self.who)
        e.version, e.schema_version = self.version, self.schema_version
        for m in self.models.values():
            tables = {k: replace(t, fields={i: replace(f) for i, f in t.fields.items()}, rules=list(t.rules)) for k, t in m.tables.items()}
            pivots = {k: replace(p, dims=[replace(d) for d in p.dims], measures=[replace(x) for x in p.measures], rules=list(p.rules), inputs=dict(p.inputs)) for k, p in m.pivots.items()}
            e.models[m.id] = C.Model(m.id, tables, pivots, m.iterate)
        return e
