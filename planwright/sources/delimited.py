"""Delimited text: header names, column types by what all values look like, ids, references, profiles.

A number may carry $, commas and %; a date is ISO or m/d/y; true, false, yes, no are booleans.  Types come
from one aggregation over all columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ORD, Field, Model, Table
from ..errors import PlanError
from ..operators import merge

# What a number, a date and a boolean look like.
NUMBER = r"^-?\(?\$?-?[0-9][0-9,]*(\.[0-9]+)?([eE][+-]?[0-9]+)?%?\)?$|^-?\$?\.[0-9]+%?$"
DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
BOOL = r"^(?i)(true|false|yes|no)$"


def slug(name: str) -> str:
    """'Cost Center (USD)' is cost_center_usd."""
    s = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"
    return f"_{s}" if s[0].isdigit() else s


def header(names: list[str]) -> list[str]:
    """Slugs, later ones of a kind numbered from _2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        s = slug(n)
        seen[s] = seen.get(s, 0) + 1
        out.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text under slugged names, with row order; blank rows are dropped."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": True, "inferSchema": False}
    names = spark.read.csv(path, header=False, **options).first()  # as written: a header read by Spark renames its repeats
    df = spark.read.csv(path, header=True, **options).toDF(*header([(n or "").strip() for n in names]))
    blank = None
    for c in df.columns:
        b = F.coalesce(F.trim(c), F.lit("")) == ""
        blank = b if blank is None else blank & b
    return df.filter(~blank).withColumn(ORD, F.monotonically_increasing_id())


def infer_types(df: DataFrame) -> dict[str, str]:
    """number, date, bool or text of each column, in one pass."""
    names = [c for c in df.columns if c != ORD]
    aggs = []
    for i, c in enumerate(names):
        v = F.trim(F.col(c))
        some = v != ""
        aggs.append(F.count_if(some).alias(f"n{i}"))
        aggs += [F.count_if(some & v.rlike(p)).alias(f"{k}{i}") for k, p in (("d", DATE), ("x", NUMBER), ("b", BOOL))]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        kind = next((k for k, t in (("x", "number"), ("d", "date"), ("b", "bool")) if n and row[f"{k}{i}"] == n), None)
        out[c] = {"x": "number", "d": "date", "b": "bool", None: "text"}[kind]
    return out


def coerce(text: Column, kind: str) -> Column:
    """A text as a value of the type; what cannot be read is null."""
    t = F.trim(text)
    if kind == "number":
        bare = F.regexp_replace(t, r"[$,%\s()]", "")
        n = F.when(bare != "", bare.try_cast("double"))
        n = F.when(t.endswith("%") | t.endswith("%)"), n / 100).otherwise(n)
        return F.when(t.startswith("("), -n).otherwise(n)
    if kind == "date":
        return F.coalesce(F.try_to_date(F.substring(t, 1, 10), "yyyy-M-d"), F.try_to_date(t, "M/d/yyyy"))
    if kind == "bool":
        return F.when(F.lower(t).isin("true", "yes"), True).when(F.lower(t).isin("false", "no"), False)
    return F.when(t != "", text)


def profile(df: DataFrame) -> DataFrame:
    """column, type, distinct (case-folded), nulls, samples."""
    types = infer_types(df)
    packs = []
    for c in types:
        v = F.trim(F.col(c))
        some = F.when(v != "", v)
        packs.append(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.count_distinct(F.lower(some)).alias("distinct"), F.count_if(some.isNull()).alias("nulls"), F.slice(F.sort_array(F.collect_set(F.when(F.col(ORD) < 1000, some))), 1, 3).alias("samples")))
    return df.agg(F.array(*packs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def id_column(df: DataFrame, types: dict[str, str]) -> str | None:
    """``id`` if unique and full, else a unique text column named like one."""
    names = [c for c in types if c == "id" or (types[c] == "text" and re.search(r"(id|key|code)$", c))]
    if not names:
        return None
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(F.when(F.trim(c) != "", F.col(c))).alias(f"u{i}") for i, c in enumerate(names))).first()
    ok = [c for i, c in enumerate(names) if row[f"u{i}"] == row["n"] and row["n"]]
    return "id" if "id" in ok else ok[0] if ok else None


def reference_candidates(df: DataFrame, types: dict[str, str], model: Model, leave: str | None = None) -> dict[str, str]:
    """Text columns all of whose values are ids of one table."""
    out = {}
    for c, kind in types.items():
        if kind != "text" or c == leave:
            continue
        values = df.select(F.trim(c).alias("id")).filter("id <> ''").distinct()
        if values.isEmpty():
            continue
        for t in model.tables.values():
            if values.join(t.df.select("id"), "id", "left_anti").isEmpty():
                out[c] = t.id
                break
    return out


@dataclass
class LoadPlan:
    types: dict[str, str]
    refs: dict[str, str]
    id: str | None
    mode: str
    inserted: int = 0
    updated: int = 0
    changed: int = 0
    deleted: int = 0
    problems: list[str] = field(default_factory=list)


def load(engine, model: str, table: str, df: DataFrame, mode: str = "create", types: dict | None = None, refs: dict | None = None, id: str | None = None, add_fields: bool = False, ignore: tuple = (), dry_run: bool = False) -> LoadPlan:
    """create, append, upsert or replace a table's rows from text columns (see ``read_delimited``).

    Checks come first (duplicate ids, unknown references, values that cannot be read); with ``dry_run``
    they are all that happens.
    """
    m = engine.model(model)
    df = df.drop(*[c for c in ignore if c in df.columns])
    found = infer_types(df) | (types or {})
    key = id or id_column(df, {c: found[c] for c in df.columns if c != ORD})
    have = m.tables.get(table)
    if mode == "create" or have is None:
        links = reference_candidates(df, found, m, key) | (refs or {})
        fields = {c: Field(c, "ref" if c in links else found[c], links.get(c)) for c in df.columns if c not in (ORD, key)}
    else:
        names = {c: have.has(c) or next((f.id for f in have.fields.values() if slug(f.name or f.id) == c), None) for c in df.columns if c != ORD}
        extra = [c for c, f in names.items() if f is None and c != key]
        if add_fields:
            for c in extra:
                if not dry_run:
                    engine.add_field(model, table, Field(c, found[c]))
                names[c] = c
        df = df.select(ORD, *(F.col(c).alias(f) for c, f in names.items() if f and not (f != "id" and f in have.fields and have.fields[f].computed)))
        key = names.get(key) if key else None
        if mode in ("upsert", "replace") and key is None:
            raise PlanError("LOAD_NO_ID", f"{mode} needs an id column")
        fields = {c: have.fields.get(c) or Field(c, found.get(c, "text")) for c in df.columns if c not in (ORD, "id", key)}
        if not fields:
            raise PlanError("LOAD_NO_COLUMNS", f"no column of the file is one of {table!r}")
    ids = F.trim(F.col(key)) if key else None
    if ids is None:
        from ..plans.tables import row_index

        df = row_index(df, "_n")
        ids = (F.col("_n") + 1 + (have.df.count() if have is not None and mode == "append" else 0)).cast("string")
    typed = df.select(ids.alias("id"), ORD, *(coerce(F.col(c), "text" if f.type == "ref" else f.type).alias(c) for c, f in fields.items()))
    plan = LoadPlan(found, {c: f.ref for c, f in fields.items() if f.ref}, key, mode)
    row = merge.duplicates(typed).first()
    if row:
        plan.problems.append(f"LOAD_DUPLICATE_ID: {row['id']!r} comes twice")
    for c, f in fields.items():
        if f.type in ("number", "date", "bool"):
            bad = df.filter((F.trim(c) != "") & coerce(F.col(c), f.type).isNull()).select(c).first()
            if bad:
                plan.problems.append(f"LOAD_BAD_VALUE: {c}: {bad[0]!r} is no {f.type}")
        if f.ref:
            bad = merge.unknown_refs(typed, c, m.table(f.ref).df).first()
            if bad:
                plan.problems.append(f"LOAD_UNKNOWN_REF: {c}: {bad[0]!r} is no row of {f.ref}")
    if have is None or mode == "create":
        plan.inserted = typed.count()
    else:
        if mode == "append":
            row = merge.clashes(have.df, typed.select("id")).first()
            if row:
                plan.problems.append(f"LOAD_DUPLICATE_ID: {row['id']!r} is there already")
        c = merge.changes(have.df, typed.drop(ORD), list(fields)).agg(F.count_if("inserted").alias("i"), F.count_if(~F.col("inserted")).alias("u"), F.count_if("changed").alias("c")).first()
        plan.inserted, plan.updated, plan.changed = c["i"], c["u"], c["c"]
        if mode == "replace":
            plan.deleted = have.df.join(typed.select("id"), "id", "left_anti").count()
    if dry_run:
        return plan
    if plan.problems:
        code, _, text = plan.problems[0].partition(": ")
        raise PlanError(code, text)
    if have is None or mode == "create":
        engine._new(model, table)
        m.tables[table] = Table(table, fields, typed)
        engine._wrote("load", True, model=model, table=table)
    elif mode == "append":
        engine.insert_rows(model, table, typed.drop(ORD))
    else:
        engine.upsert_rows(model, table, typed.drop(ORD), replace=mode == "replace")
    return plan
