"""Workbooks with live formulas: a sheet a pivot (coordinates down, line items across) and a table, rules and notes.

A rule that has a faithful spreadsheet form becomes a formula over the sheet's own cells: line items of a
coordinate are columns, so arithmetic and functions read along the row; shifts in time read another row;
another pivot's cell is found by its key with INDEX/MATCH; sums of a table's column are SUMIFS over its
sheet.  Other cells keep their value, and the Notes sheet names them.  Inputs are blue.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from ..analyze import refs as R
from ..catalog import ORD, Model, Pivot
from ..errors import PlanError
from ..lang.syntax import At, Call, Lit, Op, Ref
from .store import rules_text

MOST_ROWS = 100_000
#: Rows of a table: what a sheet holds below its heading.
MOST_TABLE_ROWS = 1_048_575
SAME = {"IF", "AND", "OR", "NOT", "ABS", "SQRT", "EXP", "LN", "LOG10", "SIGN", "ROUND", "ROUNDUP", "ROUNDDOWN", "MOD", "POWER", "IFERROR", "LEFT", "RIGHT", "MID", "LEN", "LOWER", "UPPER", "TRIM", "SUBSTITUTE", "EXACT", "YEAR", "MONTH", "DAY", "WEEKDAY", "EOMONTH", "DATE", "PMT", "PV", "FV", "NPER", "RATE", "SLN", "SYD", "DDB", "IPMT", "PPMT", "TODAY", "ISBLANK", "ISNUMBER", "ISTEXT", "TRUNC", "MROUND", "TEXT", "VALUE"}
IFS = {"SUM": "SUMIFS", "COUNT": "COUNTIFS", "AVG": "AVERAGEIFS", "AVERAGE": "AVERAGEIFS", "MIN": "MINIFS", "MAX": "MAXIFS"}


def letter(n: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class NoForm(Exception):
    """A rule without a spreadsheet form."""


class Sheet:
    def __init__(self, name: str):
        self.name, self.rows = name[:31], []

    def add(self, *cells: object) -> int:
        self.rows.append(list(cells))
        return len(self.rows)

    def xml(self) -> str:
        out = []
        for i, row in enumerate(self.rows, 1):
            cells = []
            for j, c in enumerate(row):
                style, formula = "", None
                if isinstance(c, tuple):
                    formula, c, blue = c
                    style = ' s="1"' if blue else ""
                at = f"{letter(j)}{i}"
                f = f"<f>{escape(formula)}</f>" if formula else ""
                if isinstance(c, bool):
                    cells.append(f'<c r="{at}" t="b"{style}>{f}<v>{int(c)}</v></c>')
                elif isinstance(c, (int, float)) and c == c:
                    cells.append(f'<c r="{at}"{style}>{f}<v>{c!r}</v></c>')
                elif formula:
                    cells.append(f'<c r="{at}" t="str"{style}>{f}<v>{escape("" if c is None else str(c))}</v></c>')
                elif c is not None and c == c:
                    cells.append(f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(c))}</t></is></c>')
            out.append(f'<row r="{i}">{"".join(cells)}</row>')
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'


class PivotSheet:
    """Where a pivot's cells lie: key in A, axes after it, then a column a line item."""

    def __init__(self, engine, model: Model, pivot: Pivot):
        self.pivot, self.axes = pivot, [d.id for d in pivot.axes]
        engine.planner.model = model
        self.lines = list(R.line_members(engine.planner, pivot)) if pivot.line_dim else [pivot.measures[0].id]
        df = engine.cells(model.id, pivot.id).filter(F.col("measure") == pivot.measures[0].id)
        for d in pivot.axes:
            members = engine.table(model.id, d.table).select(F.col("id").alias("_m"), F.col(ORD).alias(f"_o_{d.id}"))
            df = df.join(members, F.col(d.id) == F.col("_m")).drop("_m")
        rows = df.limit(MOST_ROWS * max(1, len(self.lines)) + 1).collect()
        if len(rows) > MOST_ROWS * max(1, len(self.lines)):
            raise PlanError("EXPORT_TOO_LARGE", f"{pivot.id!r} has over {MOST_ROWS} coordinates")
        self.cells = {(tuple(r[a] for a in self.axes), r[pivot.line_dim] if pivot.line_dim else self.lines[0]): r for r in rows}
        order = {tuple(r[a] for a in self.axes): tuple(r[f"_o_{a}"] for a in self.axes) for r in rows}
        self.coords = sorted(order, key=order.get)
        self.row = {c: i + 2 for i, c in enumerate(self.coords)}

    def column(self, line: str) -> str:
        return letter(1 + len(self.axes) + self.lines.index(line))


def table_rows(engine, model: str, table: str) -> list[dict]:
    """All rows of a table, in order; formulas range over its sheet, so one that does not fit is refused."""
    rows = engine.table(model, table).orderBy(ORD).limit(MOST_TABLE_ROWS + 1).collect()
    if len(rows) > MOST_TABLE_ROWS:
        raise PlanError("EXPORT_TOO_LARGE", f"{table!r} has over {MOST_TABLE_ROWS} rows")
    return [r.asDict() for r in rows]


def export(engine, model: str) -> bytes:
    """The model as .xlsx bytes; EXPORT_TOO_LARGE if a pivot or table has too many rows for its sheet."""
    m = engine.model(model)
    places = {p.id: PivotSheet(engine, m, p) for p in m.pivots.values()}
    tables = {t.id: table_rows(engine, model, t.id) for t in m.tables.values()}
    sheets, notes = [], Sheet("Notes")
    notes.add("Sheet", "Cell", "Why it holds a value")
    for p in m.pivots.values():
        at = places[p.id]
        s = Sheet(p.id)
        s.add("key", *at.axes, *at.lines)
        for c in at.coords:
            out: list = ["|".join(c), *c]
            for line in at.lines:
                r = at.cells[(c, line)]
                value = f"#{r['error']}" if r["error"] else r["text"] if r["text"] is not None else r["value"]
                formula = None
                if r["state"] in (1, 3):
                    try:
                        formula = Writer(engine, m, places, tables, p, c, line).cell()
                    except (NoForm, PlanError, KeyError, ValueError) as e:
                        notes.add(p.id, f"{at.column(line)}{at.row[c]}", str(e) or "no spreadsheet form")
                out.append((formula, value, r["state"] == 2) if formula or r["state"] == 2 else value)
            s.add(*out)
        sheets.append(s)
    for t in m.tables.values():
        s = Sheet(f"t_{t.id}")
        s.add("id", *t.fields)
        for r in tables[t.id]:
            s.add(r["id"], *(_plain(r.get(f)) for f in t.fields))
        sheets.append(s)
    rules = Sheet("Rules")
    for owner in [*m.tables.values(), *m.pivots.values()]:
        for text in rules_text(owner).splitlines():
            rules.add(owner.id, text)
    return package([*sheets, rules, notes], m.iterate is not None)


def _plain(v: object) -> object:
    return v.toordinal() - 693594 if hasattr(v, "toordinal") else v  # a spreadsheet's day number


class Writer:
    """The formula of one cell."""

    def __init__(self, engine, model: Model, places: dict, tables: dict, pivot: Pivot, coord: tuple, line: str):
        self.engine, self.model, self.places, self.tables = engine, model, places, tables
        self.pivot, self.coord, self.line = pivot, dict(zip(places[pivot.id].axes, coord, strict=True)), line
        engine.planner.model = model

    def cell(self) -> str:
        line = self.line if self.pivot.line_dim else None
        for r in reversed(self.engine.planner.rules_of(self.model, self.pivot, line, self.pivot.measures[0].id)):
            if self.holds(r):
                return self.write(r.text.body)
        raise NoForm("no rule")

    def attribute(self, dim, path: tuple) -> object:
        member: object = self.line if dim.id == self.pivot.line_dim else self.coord[dim.id]
        table = self.model.table(dim.table)
        for i, part in enumerate(path):
            row = next((r for r in self.tables[table.id] if r["id"] == member), {})
            member = row.get(table.has(part))
            if i < len(path) - 1:
                table = self.model.table(table.fields[table.has(part)].ref)
        return member

    def holds(self, rule) -> bool:
        from ..plans.planner import matches

        for s in rule.text.when:
            dim, attr = R.dim_of(self.model, self.pivot, s.path)
            if not matches(self.attribute(dim, attr), s):
                return False
        return True

    def write(self, x: object) -> str:
        x = R.expand_time(self.engine.planner, self.model, self.pivot, x) if isinstance(x, Call) else x
        if isinstance(x, Lit):
            return self.literal(x.value)
        if isinstance(x, At):
            dim, attr = R.dim_of(self.model, self.pivot, x.path)
            return self.literal(self.attribute(dim, attr))
        if isinstance(x, Op):
            parts = [self.write(a) for a in x.args]
            if x.op == "neg":
                return f"(-{parts[0]})"
            if x.op in ("and", "or", "not"):
                return f"{x.op.upper()}({','.join(parts)})"
            return f"({parts[0]}{'<>' if x.op == '!=' else x.op}{parts[1]})"
        if isinstance(x, Call):
            return self.call(x)
        found = R.resolve(self.engine.planner, self.model, self.pivot, self.line if self.pivot.line_dim else None, x)
        if isinstance(found, R.Attribute):
            return self.literal(self.attribute(found.dim, found.path))
        if isinstance(found, R.Column_) or not found.scalar:
            raise NoForm("a set outside an aggregate")
        return self.place(found, found.lines[0])

    def literal(self, v: object) -> str:
        if v is None:
            return '""'
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
        return str(_plain(v)) if hasattr(v, "toordinal") else '"' + str(v).replace('"', '""') + '"'

    def target(self, found: R.Cells) -> list[dict]:
        """The coordinates that a reference reads."""
        place = self.places[found.pivot.id]
        out = []
        for c in place.coords:
            at, ok = dict(zip(place.axes, c, strict=True)), True
            for d, p in found.picks.items():
                order = list(self.engine.planner.members(found.pivot.dim(d).table))
                mine = self.line if p.partner == self.pivot.line_dim else self.coord.get(p.partner)
                here = order.index(mine) if mine in order else None
                if p.how == "now":
                    ok &= at[d] == mine
                elif p.how == "shift":
                    ok &= here is not None and 0 <= here + p.by < len(order) and at[d] == order[here + p.by]
                elif p.how == "pin":
                    ok &= at[d] == (p.member if p.member is not None else order[0 if p.edge == "first" else -1])
                elif p.how == "range":
                    spot = lambda b, here=here, order=order: {"first": 0, "last": len(order) - 1}.get(b.word, (here or 0) + b.by) if b.word else order.index(self.engine.planner.member_id(found.pivot.dim(d).table, b.member))  # noqa: E731, B023
                    ok &= spot(p.low) <= order.index(at[d]) <= spot(p.high)
                elif p.how == "match":
                    dim, attr = R.dim_of(self.model, self.pivot, p.right)
                    ok &= at[d] == self.attribute(dim, attr)
                if p.tests or p.keys:
                    from ..plans.planner import matches

                    row = self.engine.planner.members(found.pivot.dim(d).table)[at[d]]
                    for t in p.tests:
                        ok &= matches(at[d] if not t.path else row.get(t.path[0]), t)
                    for path, right in p.keys:
                        dim, attr = R.dim_of(self.model, self.pivot, right)
                        ok &= str(at[d] if path == ("id",) else row.get(path[0])).lower() == str(self.attribute(dim, attr)).lower()
            if ok:
                out.append(c)
        return out

    def address(self, found: R.Cells, c: tuple, line: str | None) -> str:
        place = self.places[found.pivot.id]
        at = f"{place.column(line or place.lines[0])}{place.row[c]}"
        return at if found.pivot is self.pivot else f"'{found.pivot.id}'!{at}"

    def place(self, found: R.Cells, line: str | None) -> str:
        cells = self.target(found)
        return self.address(found, cells[0], line) if cells else '""'

    def call(self, c: Call) -> str:
        if c.name in ("SUM", "AVG", "AVERAGE", "COUNT", "MIN", "MAX", "MEDIAN", "COUNTA") and len(c.args) == 1 and isinstance(c.args[0], Ref):
            found = R.resolve(self.engine.planner, self.model, self.pivot, self.line if self.pivot.line_dim else None, c.args[0], True)
            if isinstance(found, R.Column_):
                return self.ifs(c.name, found)
            if isinstance(found, R.Cells):
                cells = [self.address(found, at, line) for at in self.target(found) for line in found.lines]
                if not cells:
                    return "0" if c.name in ("SUM", "COUNT", "COUNTA") else '""'
                if len(cells) > 250:
                    raise NoForm("over 250 cells in one aggregate")
                return f"{'AVERAGE' if c.name == 'AVG' else c.name}({','.join(cells)})"
        if c.name in SAME:
            return f"{c.name}({','.join(self.write(a) for a in c.args)})"
        if c.name in ("SUM", "MIN", "MAX", "AVG", "COUNT"):
            return f"{'AVERAGE' if c.name == 'AVG' else c.name}({','.join(self.write(a) for a in c.args)})"
        if c.name == "CONCAT":
            return "(" + "&".join(self.write(a) for a in c.args) + ")"
        raise NoForm(f"{c.name} has no spreadsheet form")

    def ifs(self, name: str, found: R.Column_) -> str:
        """SUMIFS and its kind over the table's sheet."""
        t = found.table
        if name not in IFS or len(found.path) > 1:
            raise NoForm(f"{name} over rows by a path")
        column = lambda f: f"'t_{t.id}'!${letter(0 if f == 'id' else 1 + list(t.fields).index(f))}$2:${letter(0 if f == 'id' else 1 + list(t.fields).index(f))}${len(self.tables[t.id]) + 1}"
        tests: list[tuple[str, str]] = []
        taken = set()
        for s in found.selectors:
            if len(s.path) > 1:
                raise NoForm("a filter by a path")
            if s.kind == "match":
                dim, attr = R.dim_of(self.model, self.pivot, s.right)
                taken.add(dim.id)
                tests.append((column(t.has(s.path[0])), self.literal(self.attribute(dim, attr))))
            elif s.kind == "pin" and not s.value.word:
                tests.append((column(t.has(s.path[0])), self.literal(s.value.member) if s.op == "=" else f'"<>{s.value.member}"'))
            elif s.kind == "test":
                tests.append((column(t.has(s.path[0])), f'"{s.op}{s.value:g}"' if isinstance(s.value, float) else f'"{s.op}{s.value}"'))
            else:
                raise NoForm("a filter by a set")
        for d in self.pivot.dims:
            if d.id in taken:
                continue
            paths = R.ref_paths(self.model, t, d.table)
            if paths:
                if len(paths[0]) > 1:
                    raise NoForm("rows grouped by a path of references")
                tests.append((column(paths[0][0]), self.literal(self.line if d.id == self.pivot.line_dim else self.coord[d.id])))
        where = ",".join(f"{a},{b}" for a, b in tests)
        value = column(t.has(found.path[0]))
        if not tests:
            return f"{'AVERAGE' if name == 'AVG' else name}({value})"
        return f"COUNTIFS({where})" if name == "COUNT" else f"{IFS[name]}({value},{where})"


def package(sheets: list[Sheet], iterate: bool) -> bytes:
    names = "".join(f'<sheet name="{escape(s.name)}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets><calcPr iterate="{int(iterate)}" fullCalcOnLoad="1"/></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rs" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><color rgb="FF0000FF"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    files |= {f"xl/worksheets/sheet{i}.xml": s.xml() for i, s in enumerate(sheets, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()
