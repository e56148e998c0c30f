"""Keeping a database: Parquet for tables and inputs, JSON for the catalog, and a log of operations.

A snapshot holds what was put in, not what rules compute.  The log is JSON lines; ``recover`` is the
newest snapshot and what the log has after it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Dim, Field, Iterate, Measure, Model, Pivot, Table, install


def save(engine, path: str) -> None:
    """One Parquet folder a table and a pivot's inputs, and the catalog, under ``path``."""
    catalog: dict = {"version": engine.version, "models": []}
    for m in engine.models.values():
        entry: dict = {"id": m.id, "iterate": None if m.iterate is None else vars(m.iterate), "tables": [], "pivots": []}
        for t in m.tables.values():
            t.df.write.mode("overwrite").parquet(f"{path}/{m.id}/table/{t.id}")
            entry["tables"].append({"id": t.id, "fields": [vars(f) for f in t.fields.values()], "grain": t.grain, "distinct_of": t.distinct_of, "tracked": t.tracked, "rules": rules_text(t)})
        for p in m.pivots.values():
            rows = [(json.dumps(list(c)), x, json.dumps(v)) for (c, x), v in p.inputs.items()]
            engine.spark.createDataFrame(rows, "coords string, measure string, value string").write.mode("overwrite").parquet(f"{path}/{m.id}/inputs/{p.id}")
            if p.input_df is not None:
                p.input_df.write.mode("overwrite").parquet(f"{path}/{m.id}/bulk/{p.id}")
            entry["pivots"].append({"id": p.id, "dims": [vars(d) for d in p.dims], "measures": [vars(x) for x in p.measures], "line_dim": p.line_dim, "time_dim": p.time_dim, "rules": rules_text(p), "bulk": p.input_df is not None})
        catalog["models"].append(entry)
    engine.spark.createDataFrame([(json.dumps(catalog),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")


def rules_text(owner) -> str:
    out = []
    for r in owner.rules:
        when = f"[{', '.join(map(selector_text, r.text.when))}]" if r.text.when else ""
        body = json.dumps(r.text.body.value) if r.text.format else r.text.text
        out.append(f"{'format ' if r.text.format else ''}{'.'.join(map(quoted, r.text.target))}{when} = {body}")
    return "\n".join(out)


def quoted(name: object) -> str:
    if isinstance(name, bool):
        return str(name).lower()
    if isinstance(name, float):
        return f"{name:g}"
    s = str(name)
    return s if s.isidentifier() and s.lower() not in ("and", "or", "not", "in", "true", "false", "blank", "first", "last", "this", "all") else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def selector_text(s) -> str:
    path = ".".join(map(str, s.path))
    if s.kind == "set":
        return f"{path} {s.op} ({', '.join(map(quoted, s.values))})"
    if s.kind == "test":
        return f"{path} {s.op} {quoted(s.value)}"
    return f"{path} {s.op} {s.value.word or quoted(s.value.member)}"


def open_snapshot(spark: SparkSession, path: str):
    from ..engine import Engine

    catalog = json.loads(spark.read.text(f"{path}/catalog").first()["value"])
    e = Engine(spark)
    e.version = catalog["version"]
    for entry in catalog["models"]:
        m = Model(entry["id"], iterate=Iterate(**entry["iterate"]) if entry["iterate"] else None)
        e.models[m.id] = m
        for t in entry["tables"]:
            m.tables[t["id"]] = Table(t["id"], {f["id"]: Field(**f) for f in t["fields"]}, spark.read.parquet(f"{path}/{m.id}/table/{t['id']}"), grain=t["grain"], distinct_of=tuple(t["distinct_of"]) if t["distinct_of"] else None, tracked=t["tracked"])
        for p in entry["pivots"]:
            pivot = Pivot(p["id"], [Dim(**d) for d in p["dims"]], [Measure(**x) for x in p["measures"]], p["line_dim"], p["time_dim"])
            for r in spark.read.parquet(f"{path}/{m.id}/inputs/{p['id']}").collect():  # as many as were set one by one
                pivot.inputs[(tuple(json.loads(r["coords"])), r["measure"])] = json.loads(r["value"])
            if p["bulk"]:
                pivot.input_df = spark.read.parquet(f"{path}/{m.id}/bulk/{p['id']}")
            m.pivots[p["id"]] = pivot
        for x in entry["tables"]:
            install(m.tables[x["id"]], x["rules"], m)
        for x in entry["pivots"]:
            install(m.pivots[x["id"]], x["rules"], m)
    return e


class Log:
    """Operations as JSON lines: each is an Engine method's name and arguments."""

    WRITES = {"create_model", "set_iterate", "create_table", "create_periods", "create_distinct", "create_pivot", "add_dim", "add_measure", "add_field", "patch_field", "patch_measure", "drop_field", "drop_table", "drop_model", "track_table", "insert_rows", "upsert_rows", "delete_rows", "set_cell", "set_value", "set_rules"}

    def __init__(self, engine, path: str, first: int = 0):
        self.engine, self.path, self.seq = engine, path, first

    def run(self, op: str, *args: object, **kw: object):
        """Do and, if it was done, append."""
        if op not in self.WRITES:
            raise ValueError(f"{op} is no write")
        out = getattr(self.engine, op)(*args, **kw)
        self.seq += 1
        line = json.dumps({"seq": self.seq, "at": self.engine.log[-1]["at"], "by": self.engine.who, "op": op, "args": args, "kw": kw})
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line + "\n")
        return out


def replay(engine, path: str, after: int = 0) -> int:
    """Applies the log's operations after a number, in order; a torn last line is left out."""
    last = after
    with open(path, encoding="utf-8") as f:
        for line in f:
            try:
                r = json.loads(line)
            except ValueError:
                break
            if r["seq"] > after:
                getattr(engine, r["op"])(*r["args"], **r["kw"])
                last = r["seq"]
    return last


LOG_SCHEMA = "seq long, at string, by string, op string, args string, kw string"


def history(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Newest first: seq, at, by, op, args."""
    return spark.read.schema(LOG_SCHEMA).json(path).filter(F.col("seq").isNotNull()).orderBy(F.desc("seq")).limit(limit)


def since(spark: SparkSession, path: str, seq: int) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path).filter(F.col("seq") > seq).orderBy("seq")
