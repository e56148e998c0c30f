"""Rows of a table: conditions, free text, order, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ORD
from ..errors import PlanError


def _one(c: Column, kind: str, op: str, value: object) -> Column:
    if kind == "string":
        low = F.lower(F.coalesce(c, F.lit("")))
        text = str(value).lower() if value is not None else ""
        if op == "eq":
            return low == text
        if op == "contains":
            return low.contains(text)
        return {"gt": low > text, "gte": low >= text, "lt": low < text, "lte": low <= text}[op]
    if op == "contains":
        return F.lower(c.cast("string")).contains(str(value).lower())
    if value is None:
        return c.isNull()
    v = F.lit(value).cast("date") if kind == "date" else F.lit(value)
    return {"eq": c.eqNullSafe(v), "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]


def condition(df: DataFrame, where: dict) -> Column:
    """{field: value, or list of any, or {op: value}}, with ops eq ne gt gte lt lte contains in."""
    kinds = dict(df.dtypes)
    out = F.lit(True)
    for name, test in where.items():
        if name not in kinds:
            raise PlanError("SCHEMA_NO_FIELD", f"no field {name!r}")
        c, kind = F.col(name), kinds[name]
        tests = test if isinstance(test, dict) else {"in" if isinstance(test, (list, tuple)) else "eq": test}
        for op, value in tests.items():
            if op in ("in", "eq") and isinstance(value, (list, tuple)):
                hit = reduce(lambda a, b: a | b, [_one(c, kind, "eq", v) for v in value], F.lit(False))
            elif op == "ne":
                hit = ~_one(c, kind, "eq", value)
            elif op in ("eq", "gt", "gte", "lt", "lte", "contains"):
                hit = _one(c, kind, op, value)
            else:
                raise PlanError("BAD_ARG", f"no comparison {op!r}")
            out = out & F.coalesce(hit, F.lit(False))
    return out


def find_rows(df: DataFrame, where: dict | None = None, q: str | None = None, sort: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filtered, sorted ('a,-b'; blanks last either way; ties in row order) and paged rows."""
    out = df.filter(condition(df, where or {}))
    if q:
        text = q.lower()
        out = out.filter(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(text), F.lit(False)) for c in df.columns if c != ORD]))
    kinds = dict(df.dtypes)
    order = []
    for key in [k.strip() for k in (sort or "").split(",") if k.strip()]:
        name = key.lstrip("-")
        if name not in kinds:
            raise PlanError("SCHEMA_NO_FIELD", f"no field {name!r}")
        c = F.lower(name) if kinds[name] == "string" else F.col(name)
        order.append(c.desc_nulls_last() if key.startswith("-") else c.asc_nulls_last())
    out = out.orderBy(*order, ORD) if ORD in df.columns else out.orderBy(*order) if order else out
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
