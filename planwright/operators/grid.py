"""Grids: a pivot's cells laid out by rows and columns, with pages, filters, order and a top few; text forms of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ORD
from ..errors import PlanError
from ..functions.formats import read_format, write_number

CELLS = 250_000  # what a rendered grid may hold


@dataclass
class Grid:
    """A rendered layout: headers, and values, states and errors by row."""

    row_dims: list[str]
    rows: list[tuple]
    columns: list[tuple]
    values: list[list]
    states: list[list]
    formats: list[list]
    title: str | None = None
    labels: dict = field(default_factory=dict)


def grid_cells(engine, model: str, pivot: str, pages: dict | None = None, filters: dict | None = None, rows: list[str] | None = None, cols: list[str] | None = None, measure: str | None = None) -> DataFrame:
    """The cells a grid shows, long, with each dimension's place as _at_<dim> (a list's order, else row order)."""
    m = engine.model(model)
    p = m.pivot(pivot)
    rows, cols, pages, filters = rows or [], cols or [], pages or {}, filters or {}
    for d in p.dims:
        if d.id not in rows and d.id not in cols and d.id not in pages:
            raise PlanError("QUERY_UNPINNED_DIM", f"{d.id!r} is on neither rows, columns nor pages", f"pages: {{{d.id}: ...}}")
    engine.planner.model = m
    lines = None
    if p.line_dim in pages:
        lines = [engine.planner.member_id(p.dim(p.line_dim).table, pages[p.line_dim])]
    elif isinstance(filters.get(p.line_dim), (list, tuple)):
        lines = [engine.planner.member_id(p.dim(p.line_dim).table, x) for x in filters[p.line_dim]]
    df = engine.cells(model, pivot, lines).filter(F.col("measure") == (measure or p.measures[0].id))
    for d, member in pages.items():
        df = df.filter(F.col(d) == engine.planner.member_id(p.dim(d).table, member))
    for d in p.dims:
        table = engine.planner.table(m, d.table)
        f = filters.get(d.id)
        label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id")) if "name" in table.columns else F.col("id")
        members = table.select(F.col("id").alias("_m"), F.col(ORD).alias("_o"), label.alias(f"_label_{d.id}"), *([F.col(f["attr"]).alias("_a")] if isinstance(f, dict) else []))
        if isinstance(f, (list, tuple)):
            ids = [engine.planner.member_id(d.table, x) for x in f]
            members = members.filter(F.col("_m").isin(ids)).withColumn("_o", F.array_position(F.lit(ids), F.col("_m")))
        elif isinstance(f, dict):
            want = f.get("in", [f.get("eq")])
            members = members.filter(F.lower(F.col("_a").cast("string")).isin([str(x).lower() for x in want])).drop("_a")
        df = df.join(members, F.col(d.id) == F.col("_m")).withColumnRenamed("_o", f"_at_{d.id}").drop("_m")
    return df


def grid_frame(engine, model: str, pivot: str, rows: list[str], cols: list[str], pages: dict | None = None, filters: dict | None = None, sort: dict | None = None, top: int | None = None, measure: str | None = None) -> DataFrame:
    """One row a row coordinate, a struct column per column coordinate, as a DataFrame; sorted and cut if asked."""
    df = grid_cells(engine, model, pivot, pages, filters, rows, cols, measure)
    header = F.concat_ws(" / ", *(F.col(c) for c in cols)) if cols else F.lit("value")
    known = [r["h"] for r in df.select(header.alias("h"), *(F.col(f"_at_{c}") for c in cols)).distinct().orderBy(*(f"_at_{c}" for c in cols), "h").limit(CELLS + 1).collect()]
    if len(known) > CELLS:
        raise PlanError("QUERY_TOO_WIDE", f"over {CELLS} column coordinates")
    known = list(dict.fromkeys(known))
    wide = df.groupBy(*rows, *(f"_at_{r}" for r in rows)).agg(*(F.max(F.when(header == h, F.col("value"))).alias(h) for h in known))
    order = [F.col(f"_at_{r}") for r in rows]
    if sort:
        by = sort.get("by", "header")
        if by == "header":
            key = F.col(rows[0])
        elif by in known:
            key = F.col(f"`{by}`")
        else:
            raise PlanError("QUERY_NO_COLUMN", f"no column {by!r}")
        order = [key.desc_nulls_last() if sort.get("desc") else key.asc_nulls_first(), *order]
    out = wide.orderBy(*order)
    if sort and top:
        out = out.limit(top)
    return out.select(*rows, *(F.col(f"`{h}`") for h in known))


def layout(engine, model: str, pivot: str) -> dict:
    """Rows, columns and pages where none are said: line items down, time across, others on the first member."""
    p = engine.model(model).pivot(pivot)
    dims = [d.id for d in p.dims]
    cols = [p.time_dim] if p.time_dim in dims else [p.line_dim] if p.line_dim and len(dims) > 1 else []
    rows = [p.line_dim] if p.line_dim and p.line_dim not in cols else [d for d in dims if d not in cols][:1]
    engine.planner.model = engine.model(model)
    return {"rows": rows, "cols": cols, "pages": {d: engine.planner.edge(p.dim(d).table, "first") for d in dims if d not in rows + cols}}


def query(engine, model: str, pivot: str, rows: list[str] | None = None, cols: list[str] | None = None, pages: dict | None = None, filters: dict | None = None, sort: dict | None = None, top: int | None = None, measure: str | None = None, title: str | None = None, formats: dict | None = None, max_rows: int | None = None, estimates: bool = False) -> Grid:
    """A rendered grid; its size is bounded, as a page is."""
    if rows is None and cols is None:
        default = layout(engine, model, pivot)
        rows, cols, pages = default["rows"], default["cols"], pages or default["pages"]
    rows, cols = rows or [], cols or []
    df = grid_cells(engine, model, pivot, pages, filters, rows, cols, measure)
    dims = rows + cols
    got = df.select(*dims, *(f"_at_{d}" for d in dims), *(f"_label_{d}" for d in dims), "value", "text", "error", "state").limit(CELLS + 1).collect()
    if len(got) > CELLS:
        raise PlanError("QUERY_TOO_LARGE", f"over {CELLS} cells; use pages or filters")
    place = lambda r, ds: tuple(r[f"_at_{d}"] for d in ds)
    row_keys = {place(r, rows): tuple(r[d] for d in rows) for r in got}
    col_keys = {place(r, cols): tuple(r[d] for d in cols) for r in got}
    labels = {(d, r[d]): r[f"_label_{d}"] for r in got for d in dims}
    by = {(tuple(r[d] for d in rows), tuple(r[d] for d in cols)): r for r in got}
    row_list, col_list = [row_keys[k] for k in sorted(row_keys)], [col_keys[k] for k in sorted(col_keys)]
    cell = lambda r: None if r is None else f"#{r['error']}" if r["error"] else r["text"] if r["text"] is not None else r["value"]
    if sort:
        by_name = sort.get("by", "header")
        if by_name == "header":
            row_list.sort(key=lambda k: str(labels[(rows[0], k[0])]).lower(), reverse=bool(sort.get("desc")))
        else:
            target = tuple(by_name) if isinstance(by_name, (list, tuple)) else (by_name,)
            if target not in col_list:
                raise PlanError("QUERY_NO_COLUMN", f"no column {by_name!r}")
            number = lambda v: float("-inf") if not isinstance(v, (int, float)) or v != v else v
            row_list.sort(key=lambda k: number(cell(by.get((k, target)))), reverse=bool(sort.get("desc")))
        if top:
            row_list = row_list[:top]
    if max_rows:
        row_list = row_list[:max_rows]
    fmt = []
    for r in row_list:
        ats = [{**(pages or {}), **dict(zip(rows, r, strict=True)), **dict(zip(cols, c, strict=True))} for c in col_list]
        p = engine.model(model).pivot(pivot)
        fmt.append([(formats or {}).get(at.get(p.line_dim)) or engine.cell_format(model, pivot, at, measure) for at in ats])
    if estimates:
        for d in rows + cols:
            frames = engine.planner.members(engine.model(model).pivot(pivot).dim(d).table, engine.model(model))
            for i, r in frames.items():
                if r.get("frame") == "fcst" and (d, i) in labels:
                    labels[(d, i)] += "E"
    return Grid(rows, row_list, col_list, [[cell(by.get((r, c))) for c in col_list] for r in row_list], [[(by[(r, c)]["state"] if (r, c) in by else 0) for c in col_list] for r in row_list], fmt, title, {k: v for k, v in labels.items()} | {"cols": cols})


def markdown(g: Grid, scale: float = 1.0, parentheses: bool = False, most: int | None = None) -> str:
    """An aligned table; percentages are never scaled; cut at ``most`` characters, which it says."""
    cols = g.labels.get("cols", [])
    head = [*g.row_dims, *(" / ".join(str(g.labels.get((d, m), m)) for d, m in zip(cols, c, strict=True)) or "value" for c in g.columns)]
    body = []
    for key, values, specs in zip(g.rows, g.values, g.formats, strict=True):
        shown = []
        for v, spec in zip(values, specs, strict=True):
            f = read_format(spec)
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                shown.append(write_number(v if f and (f.percent or f.date) else v / scale, f, parentheses))
            else:
                shown.append("" if v is None else str(v))
        body.append([*(str(g.labels.get((d, m), m)) for d, m in zip(g.row_dims, key, strict=True)), *shown])
    widths = [max(3, *(len(r[i]) for r in [head, *body])) for i in range(len(head))]
    n = len(g.row_dims)
    line = lambda r: "| " + " | ".join(c.ljust(w) if i < n else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))) + " |"
    rule = "|" + "|".join("-" * (w + 2) if i < n else "-" * (w + 1) + ":" for i, w in enumerate(widths)) + "|"
    text = "\n".join(([f"### {g.title}", ""] if g.title else []) + [line(head), rule, *map(line, body)])
    return text if most is None or len(text) <= most else text[:most].rsplit("\n", 1)[0] + f"\n[cut at {most} characters]"


def window_json(g: Grid) -> str:
    """Columnar JSON: headers, values row by row, states, and a table of formats with an index for each row."""
    table = list(dict.fromkeys(f for r in g.formats for f in r if f))
    return json.dumps({"rows": g.rows, "columns": g.columns, "values": [v for r in g.values for v in r], "states": [s for r in g.states for s in r], "formats": table, "format_of_cell": [table.index(f) if f else None for r in g.formats for f in r]}, default=str)


def error_summary(engine, model: str, pivot: str) -> DataFrame:
    """error, n."""
    return engine.cells(model, pivot).filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
