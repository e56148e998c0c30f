"""Model documents: one plain object with periods, tables, pivots, inputs, rules and outputs; links that carry one."""

from __future__ import annotations

import base64
import json
import zlib

from ..catalog import Field
from ..errors import PlanError
from ..operators import grid
from . import delimited

KEYS = {"model", "iterate", "periods", "tables", "pivots", "outputs", "dashboards", "title", "theme"}
CARDS = {"table", "chart", "kpi", "links", "data", "text", "distribution", "form"}


def normalize(doc: object) -> dict:
    """Checks a document's shape; errors say where."""
    def fail(path: str, what: str) -> None:
        raise PlanError("BAD_DOCUMENT", f"{path}: {what}")

    if not isinstance(doc, dict):
        fail("$", "a document is an object")
    for k in doc:
        if k not in KEYS:
            fail(f"$.{k}", f"unknown; known are {', '.join(sorted(KEYS))}")
    if not isinstance(doc.get("model"), str):
        fail("$.model", "a model id is needed")
    out = dict(doc)
    periods = out.get("periods", [])
    out["periods"] = [periods] if isinstance(periods, dict) else periods
    for name in ("tables", "pivots", "outputs", "dashboards"):
        v = out.get(name, [])
        if isinstance(v, dict):
            v = [{"id": k, **x} for k, x in v.items()]
        if not isinstance(v, list) or not all(isinstance(x, dict) for x in v):
            fail(f"$.{name}", "a list of objects")
        out[name] = v
    for i, p in enumerate(out["pivots"]):
        if "id" not in p:
            fail(f"$.pivots[{i}].id", "missing")
        if not p.get("dims") and not p.get("lines"):
            fail(f"$.pivots[{i}].dims", "a pivot has dimensions or lines")
    for i, d in enumerate(out["dashboards"]):
        for j, c in enumerate(d.get("cards", [])):
            if c.get("kind", "table") not in CARDS:
                fail(f"$.dashboards[{i}].cards[{j}].kind", f"one of {', '.join(sorted(CARDS))}")
    return out


def apply(engine, doc: dict) -> dict[str, str]:
    """Build (or update) a model; returns each output as markdown.

    All pivots exist before any of their rules; a document applied again upserts rows, lines and inputs.
    """
    doc = normalize(doc)
    mid = doc["model"]
    if mid not in engine.models:
        engine.create_model(mid)
    m = engine.model(mid)
    if "iterate" in doc:
        engine.set_iterate(mid, doc["iterate"])
    for p in doc["periods"]:
        pid = p.get("id", "periods")
        if pid not in m.tables:
            engine.create_periods(mid, pid, p["start"], p["count"], p.get("grain", "month"), p.get("histUntil") or p.get("hist_until"))
    for t in doc["tables"]:
        _table(engine, m, t)
    for t in doc["tables"]:
        if t.get("rules"):
            engine.set_rules(mid, t["id"], _text(t["rules"]))
    for p in doc["pivots"]:
        _pivot(engine, m, p)
    for p in doc["pivots"]:
        for x in p.get("inputs", []):
            for at, value in _inputs(m.pivots[p["id"]], x):
                engine.set_value(mid, p["id"], at, value, x.get("measure"))
    for p in doc["pivots"]:
        if p.get("rules"):
            engine.set_rules(mid, p["id"], _text(p["rules"]))
    out = {}
    for o in doc["outputs"]:
        g = grid.query(engine, mid, o.get("pivot") or o["table"], o.get("rows"), o.get("cols"), o.get("pages"), o.get("filters"), o.get("sort"), o.get("top"), title=o.get("title"), formats=o.get("formats"))
        out[o.get("id") or o.get("pivot") or o["table"]] = grid.markdown(g, o.get("scale", 1.0))
    return out


def _text(rules: object) -> str:
    return rules if isinstance(rules, str) else "\n".join(rules)


def _table(engine, m, t: dict) -> None:
    fields = [Field.of(v, k) for k, v in t.get("fields", {}).items()]
    if "distinct" in t:
        if t["id"] not in m.tables:
            table, _, field = t["distinct"].partition(".")
            engine.create_distinct(m.id, t["id"], table, field)
    elif "csv" in t:
        df = delimited.read_delimited(engine.spark, t["csv"], t.get("delimiter", ","))
        delimited.load(engine, m.id, t["id"], df, "upsert" if t["id"] in m.tables else "create", types={f.id: f.type for f in fields if not f.ref}, refs={f.id: f.ref for f in fields if f.ref})
        for f in fields:
            if f.computed and f.id not in m.tables[t["id"]].fields:
                engine.add_field(m.id, t["id"], f)
    elif t["id"] in m.tables:
        for f in fields:
            if f.id not in m.tables[t["id"]].fields:
                engine.add_field(m.id, t["id"], f)
        if t.get("rows"):
            engine.upsert_rows(m.id, t["id"], t["rows"])
    else:
        engine.create_table(m.id, t["id"], fields, t.get("rows", []), tracked=bool(t.get("tracked")))


def _pivot(engine, m, p: dict) -> None:
    lines = p.get("lines")
    dims = [d if isinstance(d, (tuple, dict)) else (d, d) for d in p.get("dims", [])]
    if isinstance(p.get("dims"), dict):
        dims = list(p["dims"].items())
    line_dim = p.get("lineDim") or p.get("line_dim")
    if lines:
        table = f"{p['id']}_lines"
        rows = [{"id": x} if isinstance(x, str) else x for x in lines]
        if table in m.tables:
            engine.upsert_rows(m.id, table, rows)
        else:
            kinds = {k: Field(k, "number" if isinstance(v, (int, float)) else "text") for r in rows for k, v in r.items() if k != "id"}
            engine.create_table(m.id, table, list(kinds.values()), rows)
        line_dim = line_dim or "line"
        if not any((d["id"] if isinstance(d, dict) else d[0]) == line_dim for d in dims):
            dims = [(line_dim, table), *dims]
    if p["id"] not in m.pivots:
        engine.create_pivot(m.id, p["id"], dims, line_dim, p.get("timeDim") or p.get("time_dim"), p.get("measures"))


def _inputs(pivot, x: dict):
    """{at: {...}, value} or {line: ..., values: {member: value}} along time."""
    if "value" in x:
        yield x["at"], x["value"]
        return
    along = x.get("along") or pivot.time_dim
    base = dict(x.get("at", {}))
    if "line" in x and pivot.line_dim:
        base[pivot.line_dim] = x["line"]
    for member, value in x["values"].items():
        yield {**base, along: member}, value


def encode_link(doc: dict, base: str = "model:#m=") -> str:
    """A document in an address: deflated JSON in base64url."""
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = packed.compress(json.dumps(doc, separators=(",", ":")).encode()) + packed.flush()
    return base + base64.urlsafe_b64encode(data).decode().rstrip("=")


def decode_link(link: str) -> dict:
    code = link.rsplit("#m=", 1)[-1]
    try:
        return json.loads(zlib.decompress(base64.urlsafe_b64decode(code + "=" * (-len(code) % 4)), -15))
    except (ValueError, zlib.error) as e:
        raise PlanError("BAD_LINK", str(e)) from None
