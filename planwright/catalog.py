"""Databases, models, tables, pivots and rules: what the driver knows about the data.

A table is a DataFrame with an ``id``, a hidden row order ``_ord`` and typed fields; its order is data.  A
pivot is a dense cube over dimension tables; one dimension may hold line items, one may be time.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import PlanError
from .lang.syntax import RuleText, parse_rules

ORD = "_ord"
SPARK_TYPES = {"number": "double", "text": "string", "date": "date", "bool": "boolean", "ref": "string"}


@dataclass
class Field:
    id: str
    type: str = "text"
    ref: str | None = None
    name: str | None = None
    format: str | None = None
    computed: bool = False

    @classmethod
    def of(cls, spec: "str | dict | Field", id: str | None = None) -> "Field":
        """From a dict, or from 'number', 'ref:table', with a trailing * where computed."""
        if isinstance(spec, Field):
            return spec
        if isinstance(spec, str):
            computed, kind = spec.endswith("*"), spec.rstrip("*")
            ref = kind[4:] if kind.startswith("ref:") else None
            return cls(id or "", "ref" if ref else kind, ref, computed=computed)
        ref = spec.get("ref")
        return cls(spec.get("id", id), "ref" if ref else spec.get("type", "text"), ref, spec.get("name"), spec.get("format"), bool(spec.get("computed")))


@dataclass
class Table:
    id: str
    fields: dict[str, Field]
    df: DataFrame
    rules: list["Rule"] = field(default_factory=list)
    grain: str | None = None
    distinct_of: tuple[str, str] | None = None
    tracked: bool = False
    source: dict | None = None
    version: int = 0

    def has(self, name: str) -> str | None:
        """The id of a field by id or display name."""
        if name == "id" or name in self.fields:
            return name
        return next((f.id for f in self.fields.values() if f.name == name), None)


@dataclass
class Dim:
    id: str
    table: str


@dataclass
class Measure:
    id: str = "value"
    type: str = "number"
    format: str | None = None


@dataclass
class Pivot:
    id: str
    dims: list[Dim]
    measures: list[Measure]
    line_dim: str | None = None
    time_dim: str | None = None
    rules: list["Rule"] = field(default_factory=list)
    inputs: dict[tuple, object] = field(default_factory=dict)  # (members in dim order, measure) -> value
    input_df: DataFrame | None = None  # dims, measure, value: inputs in bulk
    version: int = 0

    def dim(self, id: str) -> Dim | None:
        return next((d for d in self.dims if d.id == id), None)

    @property
    def axes(self) -> list[Dim]:
        """All dimensions but the line items."""
        return [d for d in self.dims if d.id != self.line_dim]


@dataclass
class Rule:
    text: RuleText
    target: str
    line: str | None = None
    valid: bool = True
    problem: str | None = None


@dataclass
class Iterate:
    """Settings for circular rules; passes are held between 1 and 10,000."""

    max_iterations: int = 100
    tolerance: float = 0.001

    def __post_init__(self) -> None:
        self.max_iterations = max(1, min(10_000, int(self.max_iterations)))


@dataclass
class Model:
    id: str
    tables: dict[str, Table] = field(default_factory=dict)
    pivots: dict[str, Pivot] = field(default_factory=dict)
    iterate: Iterate | None = None

    def table(self, id: str) -> Table:
        if id not in self.tables:
            raise PlanError("SCHEMA_NO_TABLE", f"no table {id!r} in model {self.id!r}")
        return self.tables[id]

    def pivot(self, id: str) -> Pivot:
        if id not in self.pivots:
            raise PlanError("SCHEMA_NO_TABLE", f"no pivot {id!r} in model {self.id!r}")
        return self.pivots[id]


def with_order(df: DataFrame) -> DataFrame:
    """Adds the row order of a frame as it is read."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


def typed(column: Column, kind: str) -> Column:
    return column.cast(SPARK_TYPES[kind])


def as_date(value: object) -> object:
    return dt.date.fromisoformat(value[:10]) if isinstance(value, str) else value


def rows_frame(spark: SparkSession, fields: dict[str, Field], rows: list[dict], start: int = 0) -> DataFrame:
    """Inline rows; a missing id is the row's number."""
    names = list(fields)
    schema = ", ".join(["id string", f"{ORD} long", *(f"`{n}` {SPARK_TYPES[fields[n].type]}" for n in names)])

    def cell(n: str, v: object) -> object:
        kind = fields[n].type
        if v is None:
            return None
        if kind == "number":
            try:
                return float(v)
            except (TypeError, ValueError):
                return None
        if kind == "date":
            return as_date(v)
        return bool(v) if kind == "bool" else str(v)

    data = [(str(r.get("id", start + i + 1)), start + i, *(cell(n, r.get(n)) for n in names)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def install(owner: Table | Pivot, text: str, model: Model, replace: bool = True) -> list[Rule]:
    """Parse rules and find what each one writes: a field, a measure or a line item."""
    found = []
    for r in parse_rules(text):
        name = r.target[-1]
        if isinstance(owner, Table):
            fid = owner.has(name)
            if not fid:
                raise PlanError("UNKNOWN_TARGET", f"{name!r} is no field of {owner.id!r}")
            owner.fields[fid].computed = True if not r.format else owner.fields[fid].computed
            found.append(Rule(r, fid))
        else:
            measures = {m.id for m in owner.measures}
            if name in measures:
                found.append(Rule(r, name))
            else:
                found.append(Rule(r, owner.measures[0].id, name))
    owner.rules = found if replace else [*owner.rules, *found]
    owner.version += 1
    return found
