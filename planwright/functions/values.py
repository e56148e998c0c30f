"""A typed value in a plan: a Column, and beside it a Column that names an error.

Blank is null.  Numbers are doubles; dates are days since 1970-01-01 while they are computed with.
Operators read a blank as 0, '' or false; a stored value with an error has a null column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM, TEXT, BOOL, DATE, BLANK = "num", "text", "bool", "date", "blank"
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column
    err: Column | None = None


def blank() -> Val:
    return Val(BLANK, F.lit(None).cast("double"))


def literal(value: object) -> Val:
    if value is None:
        return blank()
    if isinstance(value, bool):
        return Val(BOOL, F.lit(value))
    if isinstance(value, (int, float)):
        return Val(NUM, F.lit(float(value)))
    return Val(TEXT, F.lit(str(value)))


def from_field(col: Column, kind: str) -> Val:
    """A stored field (number, text, date, bool, ref) as a value."""
    if kind == "date":
        return Val(DATE, F.unix_date(col).cast("double"))
    return Val({"number": NUM, "bool": BOOL}.get(kind, TEXT), col)


def to_field(v: Val, kind: str) -> Column:
    """A value as it is stored in a field of that type."""
    if kind == "number":
        return as_number(v).col if v.kind != BLANK else v.col
    if kind == "date":
        n = v if v.kind in (NUM, DATE, BLANK) else days(v)
        return F.date_from_unix_date(n.col.cast("int"))
    if kind == "bool":
        return truth(v)
    return F.when(v.col.isNull(), F.lit(None)).otherwise(as_text(v)) if v.kind != BLANK else v.col.cast("string")


def errors(*values: Val) -> Column | None:
    """The first error of several values."""
    found = [v.err for v in values if v.err is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def guarded(kind: str, col: Column, *values: Val, when: Column | None = None, code: str = "") -> Val:
    """A result with its arguments' errors, or ``code`` where ``when`` holds.

    Where there is an error the column may hold anything: it is made null when the value is stored, once,
    so that plans do not grow with each operation.
    """
    err = errors(*values)
    if when is not None:
        own = F.when(when, F.lit(code))
        err = own if err is None else F.coalesce(err, own)
    return Val(kind, col, err)


def stored(v: Val) -> Val:
    """With a null column where there is an error."""
    return v if v.err is None else Val(v.kind, F.when(v.err.isNull(), v.col), v.err)


def is_blank(v: Val) -> Column:
    return v.col.isNull() | (v.col == "") if v.kind == TEXT else v.col.isNull()


def as_number(v: Val) -> Val:
    """As a number, blank kept null; text that is no number is an error."""
    if v.kind in (NUM, DATE, BLANK):
        return v
    if v.kind == BOOL:
        return Val(NUM, v.col.cast("double"), v.err)
    text = F.trim(v.col)
    n = F.when(text != "", _try_double(text))
    return guarded(NUM, n, v, when=(text != "") & _try_double(text).isNull(), code="TYPE")


def _try_double(text: Column) -> Column:
    return text.try_cast("double")


def number(v: Val) -> Val:
    """As a number, blank 0."""
    n = as_number(v)
    return Val(NUM, F.coalesce(n.col, F.lit(0.0)), n.err)


def as_text(v: Val) -> Column:
    """As text, blank ''; whole numbers without a point."""
    if v.kind == TEXT:
        return F.coalesce(v.col, F.lit(""))
    if v.kind == BOOL:
        return F.coalesce(v.col.cast("string"), F.lit(""))
    whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
    return F.coalesce(F.when(whole, v.col.cast("bigint").cast("string")).otherwise(v.col.cast("string")), F.lit(""))


def truth(v: Val) -> Column:
    if v.kind == BOOL:
        return F.coalesce(v.col, F.lit(False))
    if v.kind == TEXT:
        return F.coalesce(F.lower(v.col) == "true", F.lit(False))
    return F.coalesce(v.col != 0, F.lit(False))


def days(v: Val) -> Val:
    """As a day number: dates, numbers, ISO or m/d/y text (read as UTC); anything else is an error."""
    if v.kind in (DATE, NUM):
        return guarded(DATE, F.floor(v.col).cast("double"), v, when=v.col.isNull(), code="TYPE")
    if v.kind == TEXT:
        iso = F.try_to_date(F.substring(v.col, 1, 10), "yyyy-MM-dd")
        us = F.try_to_date(v.col, "M/d/yyyy")
        d = F.unix_date(F.coalesce(iso, us)).cast("double")
        return guarded(DATE, d, v, when=d.isNull(), code="TYPE")
    return guarded(DATE, F.lit(None).cast("double"), v, when=F.lit(True), code="TYPE")


def same(a: Val, b: Val) -> Column:
    """Tolerant equality: blank is '', 0 and false; text ignores case; numbers agree to a billionth."""
    if BLANK in (a.kind, b.kind):
        v = b if a.kind == BLANK else a
        if v.kind == BLANK:
            return F.lit(True)
        return is_blank(v) | (~truth(v) if v.kind == BOOL else v.col == 0 if v.kind != TEXT else F.lit(False))
    if a.kind == TEXT and b.kind == TEXT:
        return F.lower(F.coalesce(a.col, F.lit(""))) == F.lower(F.coalesce(b.col, F.lit("")))
    if TEXT in (a.kind, b.kind):
        t, n = (a, b) if a.kind == TEXT else (b, a)
        x, y = F.when(is_blank(t), 0.0).otherwise(_try_double(F.trim(t.col))), F.coalesce(as_number(n).col, F.lit(0.0))
    else:
        x, y = number(a).col, number(b).col
    return F.coalesce(F.abs(x - y) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))


def compare(op: str, a: Val, b: Val) -> Val:
    if op in ("=", "!="):
        eq = same(a, b)
        return guarded(BOOL, eq if op == "=" else ~eq, a, b)
    if a.kind == TEXT and b.kind == TEXT:
        x, y, args = F.lower(as_text(a)), F.lower(as_text(b)), (a, b)
    else:
        na, nb = number(a), number(b)
        x, y, args = na.col, nb.col, (na, nb)
    return guarded(BOOL, {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], *args)


def unify(values: list[Val]) -> tuple[str, list[Column]]:
    """One kind for several branches."""
    kinds = {v.kind for v in values} - {BLANK}
    if not kinds:
        return BLANK, [v.col for v in values]
    if len(kinds) == 1:
        kind = kinds.pop()
        cast = {NUM: "double", DATE: "double", BOOL: "boolean", TEXT: "string"}[kind]
        return kind, [v.col.cast(cast) if v.kind == BLANK else v.col for v in values]
    if TEXT in kinds:
        return TEXT, [F.when(v.col.isNotNull(), as_text(v)) if v.kind != BLANK else v.col.cast("string") for v in values]
    return NUM, [as_number(v).col if v.kind != BLANK else v.col for v in values]
