"""Recurrences over time, across pivots, as one fold; circular rules as a bounded iteration in its step.

Each coordinate's periods are collected in order, and ``aggregate`` walks them: a step computes the group's
cells of one period from those before and from columns planned earlier.  Cells within a step are bound one
after another, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Iterate
from ..errors import PlanError
from ..functions.values import BOOL, DATE, NUM, TEXT, Val

SQL = {NUM: "double", DATE: "double", TEXT: "string", BOOL: "boolean"}


def step_order(group: list, inside: list) -> tuple[list, bool]:
    """The group's cells so that those of the same period come after what they read; and whether that is circular."""
    needs = {n: {d for m, d, how, _ in inside if m == n and how == "now"} for n in group}
    out: list = []
    while len(out) < len(group):
        free = [n for n in group if n not in out and needs[n] <= set(out)]
        if not free:
            return out + [n for n in group if n not in out], True
        out += free
    return out, False


def fold(planner, group: list, inside: list, backwards: bool = False) -> None:
    from .planner import Scope

    frames = {n: planner.frame(planner.models[n[0]], planner.models[n[0]].pivots[n[1]]) for n in group}
    pivots = list(dict.fromkeys((n[0], n[1]) for n in group))
    base = frames[group[0]]
    axes = _aligned(planner, pivots, base)
    if axes is None:
        return planner._levels(group)
    order, circular = step_order(group, inside)
    lags = {by for *_, how, by in inside if how == "shift"}
    number = {n: i for i, n in enumerate(order)}
    used: dict[tuple[str, str], dict[str, str]] = {p: {} for p in pivots}

    def note(pivot_key):
        def column(name: str) -> Column:
            used[pivot_key].setdefault(name, f"p{pivots.index(pivot_key)}_{name}")
            return F.col(name)

        return column

    # Once through the rules for the columns that they need and the kinds that they give.
    kinds = {n: (TEXT if _measure(frames[n], n).type == "text" else NUM) for n in group}

    def seen(node, cells):
        return Val(kinds[node], F.lit(None).cast(SQL[kinds[node]]), F.lit(None).cast("string")) if node in number else None

    for n in order:
        planner.model = frames[n].model
        v, _ = planner.cell_value(Scope(frames[n], n[2], note((n[0], n[1])), seen), n)
        kinds[n] = v.kind if v.kind in SQL else NUM

    merged = _merge(planner, pivots, axes, used, base)
    time = base.pivot.time_dim if lags else None

    def values(x, before, now, st):
        """Val of each of the group's cells, bound one after another; returns the struct of all."""

        def chain(i: int, bound: dict) -> Column:
            if i == len(order):
                return F.struct(*(bound[n].alias(f"n{k}") for k, n in enumerate(order)))
            n = order[i]
            key = (n[0], n[1])

            def read(node, cells):
                if node not in number:
                    return None
                if cells.here:
                    s = bound[node] if node in bound else st[f"n{number[node]}"]
                else:
                    by = next(p.by for p in cells.picks.values() if p.how == "shift")
                    s = before(abs(by))[f"n{number[node]}"]
                return Val(kinds[node], s["v"], s["e"])

            planner.model = frames[n].model
            v, state = planner.cell_value(Scope(frames[n], n[2], lambda name: now(x, used[key][name]), read), n)
            e = F.lit(None).cast("string") if v.err is None else v.err
            s = F.struct(v.col.cast(SQL[kinds[n]]).alias("v"), e.alias("e"), state.alias("s"))
            return F.element_at(F.transform(F.array(s), lambda b: chain(i + 1, {**bound, n: b})), 1)

        return chain(0, {})

    row_type = "struct<" + ",".join(f"n{i}:struct<v:{SQL[kinds[n]]},e:string,s:int>" for i, n in enumerate(order)) + ">"

    def solved(x, before, now) -> Column:
        if not circular:
            return values(x, before, now, None)
        settings: Iterate | None = planner.models[order[0][0]].iterate
        rounds = settings.max_iterations if settings else len(order) + 1
        first = "CAST(NULL AS STRING)" if settings else "'CYCLE'"
        zero = {n: "0D" if settings and kinds[n] == NUM else "NULL" for n in order}
        blank_row = F.expr("named_struct(" + ",".join(f"'n{i}',named_struct('v',CAST({zero[n]} AS {SQL[kinds[n]]}),'e',{first},'s',0)" for i, n in enumerate(order)) + f")").cast(row_type)
        start = F.struct(blank_row.alias("row"), F.lit(False).alias("done"))

        def again(acc, _):
            new = values(x, before, now, acc["row"])

            def close(i: int, s) -> Column:
                a, b = acc["row"][f"n{i}"], s[f"n{i}"]
                moved = F.abs(a["v"] - b["v"]) <= (settings.tolerance if settings else 0.0)
                both = a["v"].isNull() & b["v"].isNull()
                return (both | F.coalesce(moved, F.lit(False))) if kinds[order[i]] in (NUM, DATE) else a["v"].eqNullSafe(b["v"])

            def judge(s) -> Column:
                done = F.lit(bool(settings))
                for i in range(len(order)):
                    done = done & close(i, s)
                return F.struct(s.alias("row"), done.alias("done"))

            return F.when(acc["done"], acc).otherwise(F.element_at(F.transform(F.array(new), judge), 1))

        def finish(acc) -> Column:
            if not settings:
                return acc["row"]
            late = ~acc["done"]
            return F.struct(*(F.struct(F.when(acc["done"], acc["row"][f"n{i}"]["v"]).alias("v"), F.when(late & (acc["row"][f"n{i}"]["s"] != 2), F.lit("ITER")).otherwise(acc["row"][f"n{i}"]["e"]).alias("e"), acc["row"][f"n{i}"]["s"].alias("s")).alias(f"n{i}") for i in range(len(order))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again, finish)

    names = [f"d_{d}" for d in axes]
    if time is None:
        out = merged.withColumn("_row", solved(None, None, lambda x, name: F.col(name)))
    else:
        keys = [f"d_{d}" for d in axes if d != time]
        leaves = [c for c in merged.columns if c not in keys]
        item = F.struct(F.col(f"o_{time}"), *(F.col(c) for c in leaves if c != f"o_{time}"))
        grouped = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=not backwards).alias("_steps"))

        def step(acc, x):
            before = lambda k: F.try_element_at(acc, F.lit(-k))["row"]
            row = solved(x, before, lambda x, name: x[name])
            return F.concat(acc, F.array(F.struct(x[f"d_{time}"].alias("at"), row.cast(row_type).alias("row"))))

        empty = F.array().cast(f"array<struct<at:string,row:{row_type}>>")
        rows = grouped.withColumn("_all", F.aggregate("_steps", empty, step)).select(*keys, F.explode("_all").alias("_x"))
        out = rows.select(*keys, F.col("_x.at").alias(f"d_{time}"), F.col("_x.row").alias("_row"))
    for key in pivots:
        _spread(planner, key, [n for n in order if (n[0], n[1]) == key], frames, number, kinds, out, names, axes)


def _measure(frame, node):
    return next(m for m in frame.pivot.measures if m.id == node[3])


def _aligned(planner, pivots: list, base) -> list[str] | None:
    """The base's axes, if every pivot has one over each of the same tables."""
    axes = [(d.id, d.table) for d in base.pivot.axes]
    for m, p in pivots:
        other = [(d.id, d.table) for d in planner.models[m].pivots[p].axes]
        if sorted(t for _, t in other) != sorted(t for _, t in axes) or len({t for _, t in axes}) != len(axes) and other != axes:
            return None
    return [d for d, _ in axes]


def _axis_map(planner, key, base) -> dict[str, str]:
    """The pivot's axis for each of the base's."""
    pivot = planner.models[key[0]].pivots[key[1]]
    out = {}
    for d in base.pivot.axes:
        out[d.id] = d.id if pivot.dim(d.id) else next(x.id for x in pivot.axes if x.table == d.table)
    return out


def _merge(planner, pivots, axes, used, base):
    """One frame of the axes and of the columns that the group's rules need, under prefixed names."""
    merged = None
    for key in pivots:
        frame = planner.frames[key]
        other = _axis_map(planner, key, base)
        picked = [F.col(f"d_{other[a]}").alias(f"d_{a}") for a in axes]
        if merged is None:
            picked += [F.col(f"o_{other[a]}").alias(f"o_{a}") for a in axes]
        df = frame.df.select(*picked, *(F.col(c).alias(n) for c, n in used[key].items()))
        if merged is None:
            merged = df
        else:
            merged = merged.join(df, [f"d_{a}" for a in axes]) if axes else merged.crossJoin(df)
    return merged


def _spread(planner, key, nodes, frames, number, kinds, out, names, axes) -> None:
    """The group's cells of one pivot as columns of its frame."""
    from .planner import Cell

    frame = planner.frames[key]
    other = _axis_map(planner, key, frames[next(iter(number))])
    picked, made = [], {}
    for n in nodes:
        v, e, s = planner.fresh("v_"), planner.fresh("e_"), planner.fresh("s_")
        i = number[n]
        picked += [F.col(f"_row.n{i}.v").alias(v), F.col(f"_row.n{i}.e").alias(e), F.col(f"_row.n{i}.s").alias(s)]
        made[n] = Cell(kinds[n], v, e, s)
    if axes:
        keys = [planner.fresh("k_") for _ in axes]
        side = out.select(*(F.col(f"d_{a}").alias(k) for a, k in zip(axes, keys, strict=True)), *picked)
        cond = None
        for a, k in zip(axes, keys, strict=True):
            c = F.col(f"d_{other[a]}") == F.col(k)
            cond = c if cond is None else cond & c
        frame.df = frame.df.join(side, cond).drop(*keys)
    else:
        frame.df = frame.df.crossJoin(out.select(*picked))
    frame.cells.update(made)


__all__ = ["PlanError", "fold", "step_order"]
