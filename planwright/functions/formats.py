"""How numbers are written: named formats and spreadsheet-like patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Named formats as patterns, and currency signs.
NAMED = {
    "percent": "0.0%", "pct": "0.0%", "%": "0.0%", "currency": "$#,##0", "money": "$#,##0", "usd": "$#,##0", "dollars": "$#,##0",
    "multiple": '#,##0.0"x"', "times": '#,##0.0"x"', "x": '#,##0.0"x"', "int": "#,##0", "integer": "#,##0", "count": "#,##0",
    "number": "#,##0", "decimal": "#,##0.00", "dec": "#,##0.00", "date": "date", "text": "text", "general": "",
}
SIGNS = {"usd": "$", "eur": "€", "gbp": "£", "jpy": "¥", "chf": "CHF ", "cad": "CA$", "aud": "A$", "inr": "₹", "cny": "¥"}
PATTERN = re.compile(r'(?:\[\$(?P<code>[^\]]{1,6})\]|(?P<sign>CHF |CA\$|A\$|R\$|[$€£¥₹]))?(?P<digits>[#0,]*(?:\.[#0]*)?)(?P<pct>%?)(?:"(?P<after>[^"]{0,8})")?')


@dataclass(frozen=True)
class Format:
    prefix: str = ""
    suffix: str = ""
    decimals: int | None = None
    thousands: bool = True
    percent: bool = False
    date: bool = False


def read_format(spec: object) -> Format | None:
    """A format by name, by currency (currency:EUR) or by pattern; None if it says nothing."""
    raw = str(spec or "").strip()
    low = raw.lower()
    money = re.fullmatch(r"currency:([a-z]{3})", low)
    if money or (low in SIGNS and low != "usd"):
        code = money[1] if money else low
        return Format(SIGNS.get(code, f"{code.upper()} "), decimals=0)
    pattern = NAMED.get(low, raw)
    if pattern == "date":
        return Format(date=True, thousands=False)
    m = PATTERN.fullmatch(pattern)
    if not pattern or pattern == "text" or not m or not m[0]:
        return None
    digits = m["digits"] or ""
    prefix = SIGNS.get(m["code"].lower(), f"{m['code']} ") if m["code"] else m["sign"] or ""
    decimals = len(digits.split(".")[1]) if "." in digits else 0 if digits else None
    return Format(prefix, m["after"] or "", decimals, "," in digits, bool(m["pct"]))


def write_number(value: float | None, fmt: Format | None = None, parentheses: bool = False) -> str:
    """A number as its format says; without decimals in it, as many as its size deserves."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return ""
    fmt = fmt or Format()
    if fmt.date:
        import datetime as dt

        return (dt.date(1970, 1, 1) + dt.timedelta(days=int(value))).isoformat()
    n = value * 100 if fmt.percent else value
    size = abs(n) * (1 + 2.220446049250313e-16)
    places = fmt.decimals if fmt.decimals is not None else 0 if size >= 1000 else 1 if size >= 100 else 2
    body = f"{size:,.{places}f}" if fmt.thousands else f"{size:.{places}f}"
    if fmt.decimals is None and "." in body:
        body = body.rstrip("0").rstrip(".")
    text = f"{fmt.prefix}{body}{'%' if fmt.percent else ''}{fmt.suffix}"
    return text if n >= 0 else f"({text})" if parentheses else f"-{text}"
