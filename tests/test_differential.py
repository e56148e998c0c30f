"""Random models: every cell of the planner's frames against an evaluator that recurses cell by cell."""

import random

import pytest

from planwright.engine import Engine
from planwright.lang.syntax import Call, Lit, Op, Ref, parse_rules

PERIODS = ["jan26", "feb26", "mar26", "apr26", "may26"]
REGIONS = {"r0": ("a", 1.0), "r1": ("a", 2.5), "r2": ("b", 0.0), "r3": ("b", 4.0)}
LINES = [f"l{i}" for i in range(5)]


class Bad(Exception):
    pass


class Cells:
    """The rule language over dictionaries, for numbers."""

    def __init__(self, rules, facts, inputs):
        self.rules, self.facts, self.inputs, self.done = parse_rules(rules), facts, inputs, {}

    def cell(self, line, r, t):
        """A number, None, or an error's code in a tuple."""
        key = (line, r, t)
        if key not in self.done:
            self.done[key] = ("CYCLE",)
            self.done[key] = self.compute(line, r, t)
        return self.done[key]

    def compute(self, line, r, t):
        if (line, r, t) in self.inputs:
            return self.inputs[(line, r, t)]
        for rule in reversed(self.rules):
            if rule.target[0] == line and all(self.test(s, r, t) for s in rule.when):
                try:
                    return self.value(rule.body, r, t)
                except Bad as e:
                    return (e.args[0],)
        return None

    def test(self, s, r, t):
        have = {"frame": "hist" if t < 3 else "fcst", "region": r, "zone": REGIONS[r][0]}[s.path[-1]]
        return have in s.values if s.kind == "set" else (have == s.value.member) == (s.op == "=")

    def read(self, line, r, t):
        v = self.cell(line, r, t) if 0 <= t < len(PERIODS) else None
        if isinstance(v, tuple):
            raise Bad(v[0])
        return v

    def number(self, x, r, t):
        return self.value(x, r, t) or 0.0

    def value(self, x, r, t):
        if isinstance(x, Lit):
            return x.value
        if isinstance(x, Op):
            a = self.number(x.args[0], r, t)
            if x.op == "neg":
                return -a
            b = self.number(x.args[1], r, t)
            if x.op == "/":
                if b == 0:
                    raise Bad("DIV0")
                return a / b
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, ">": lambda: a > b}[x.op]()
        if isinstance(x, Ref):
            if x.parts == ("region", "weight"):
                return REGIONS[r][1]
            return self.read(x.parts[0], r, t + sum(s.value for s in x.selectors))
        return self.call(x, r, t)

    def call(self, x: Call, r, t):
        if x.name == "IF":
            return self.value(x.args[1] if self.value(x.args[0], r, t) else x.args[2], r, t)
        if x.name == "IFERROR":
            try:
                return self.value(x.args[0], r, t)
            except Bad:
                return self.value(x.args[1], r, t)
        if x.name == "PREV":
            return self.read(x.args[0].parts[0], r, t - 1)
        vs = self.many(x, r, t)
        vs = [v for v in vs if v is not None]
        if x.name in ("SUM", "CUMSUM"):
            return sum(vs)
        if x.name in ("AVG", "TRAILING"):
            return sum(vs) / len(vs) if vs else None
        if x.name == "COUNT":
            return float(len(vs))
        return max(vs) if vs else None

    def many(self, x, r, t):
        if x.name == "CUMSUM":
            return [self.read(x.args[0].parts[0], r, k) for k in range(t + 1)]
        if x.name == "TRAILING":
            return [self.read(x.args[0].parts[0], r, k) for k in range(max(0, t - 2), t + 1)]
        if len(x.args) > 1:
            return [self.value(a, r, t) for a in x.args]
        ref = x.args[0]
        if ref.parts[0] == "facts":
            return [f["amount"] for f in self.facts if f["region"] == r and f["period"] == PERIODS[t] and all(f["kind"] == s.value.member for s in ref.selectors)]
        lines, regions, times = [ref.parts[0]], [r], [t]
        for s in ref.selectors:
            if s.path == ("line",):
                lines = list(s.values)
            elif s.path == ("region", "zone"):
                regions = [k for k, v in REGIONS.items() if v[0] == s.value.member]
            elif s.path == ("region",):
                regions = [k for k in REGIONS if s.value.word == "all" or k != s.value.member]
            elif s.kind == "range":
                times = range(0, t + 1)
        return [self.read(n, k, u) for n in lines for k in regions for u in times]


def random_rules(r: random.Random) -> str:
    out = []

    def leaf(i):
        lower = [f"l{j}" for j in range(i)]
        kinds = ["num", "facts", "filtered", "weight"] + ["line"] * 3 + ["all", "mask", "zone", "cum", "trail", "lines", "lag"] if i else ["num", "facts", "filtered", "weight"]
        k, n = r.choice(kinds), r.choice(lower or ["l0"])
        return {
            "num": lambda: str(r.randint(-3, 9)), "facts": lambda: f"{r.choice(['SUM', 'AVG', 'MAX', 'COUNT'])}(facts.amount)", "filtered": lambda: f"SUM(facts.amount[kind={r.choice('xy')}])",
            "weight": lambda: "region.weight", "line": lambda: n, "all": lambda: f"SUM({n}[region=all])", "mask": lambda: f"SUM({n}[region != r{r.randint(0, 3)}])", "zone": lambda: f"{r.choice(['SUM', 'MAX'])}({n}[region.zone={r.choice('ab')}])",
            "cum": lambda: f"CUMSUM({n})", "trail": lambda: f"TRAILING({n}, 3, AVG)", "lines": lambda: f"SUM(value[line in ({', '.join(lower[-3:])})])", "lag": lambda: f"{n}[period-2]",
        }[k]()

    def tree(i, depth):
        if depth == 0 or r.random() < 0.3:
            return leaf(i)
        a, b = tree(i, depth - 1), tree(i, depth - 1)
        return r.choice([f"({a} + {b})", f"({a} - {b})", f"({a} * 0.5)", f"IF({a} > {b}, {a}, {b})", f"MAX(0, {a})", f"IFERROR({a} / {b}, -1)", f"({a} / {b})"])

    for i in range(len(LINES)):
        out.append(f"l{i} = {tree(i, 2)}")
        if r.random() < 0.5:
            out.append(f"l{i}[{r.choice(['frame=fcst', 'zone=a', 'region in (r1, r3)'])}] = {tree(i, 1)}")
        if r.random() < 0.5:
            out.append(f"l{i}[frame=fcst] = PREV(l{i}) * 0.5 + {tree(i, 1)}")
    return "\n".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_model(spark, seed):
    r = random.Random(seed)
    facts = [{"id": str(i), "region": r.choice([*REGIONS]), "period": r.choice(PERIODS), "amount": r.choice([None, *range(1, 9)]), "kind": r.choice("xy")} for i in range(60)]
    rules = random_rules(r)
    inputs = {(r.choice(LINES), r.choice([*REGIONS]), r.randrange(5)): float(r.randint(1, 9)) for _ in range(6)}
    e = Engine(spark)
    e.create_model("m")
    e.create_periods("m", "periods", "2026-01", 5, "month", "2026-03-31")
    e.create_table("m", "regions", {"zone": "text", "weight": "number"}, [{"id": k, "zone": z, "weight": w} for k, (z, w) in REGIONS.items()])
    e.create_table("m", "facts", {"region": "ref:regions", "period": "ref:periods", "amount": "number", "kind": "text"}, facts)
    e.create_table("m", "lines", {}, [{"id": n} for n in LINES])
    e.create_pivot("m", "p", [("region", "regions"), ("line", "lines"), ("period", "periods")], "line", "period")
    for (line, k, t), v in inputs.items():
        e.set_value("m", "p", {"line": line, "region": k, "period": PERIODS[t]}, v)
    e.set_rules("m", "p", rules)
    want = Cells(rules, facts, inputs)
    for row in e.cells("m", "p").collect():
        v = want.cell(row["line"], row["region"], PERIODS.index(row["period"]))
        where = (row["line"], row["region"], row["period"], rules)
        if isinstance(v, tuple):
            assert row["error"] is not None, where
        elif v is None:
            assert row["value"] is None and row["error"] is None, where
        else:
            assert row["error"] is None and row["value"] == pytest.approx(float(v), rel=1e-9, abs=1e-9), where


def test_sets_inside_a_recurrence(spark):
    """Each period's shares of last period's total: a recurrence with a set in it, walked pass by pass."""
    e = Engine(spark)
    e.create_model("m")
    e.create_periods("m", "periods", "2026-01", 4, "month")
    e.create_table("m", "regions", {}, [{"id": "a"}, {"id": "b"}])
    e.create_table("m", "lines", {}, [{"id": "x"}])
    e.create_pivot("m", "p", [("region", "regions"), ("line", "lines"), ("period", "periods")], "line", "period")
    e.set_rules("m", "p", "x = 1 + SUM(x[region=all, period-1]) / 2\nx[period=jan26] = 2")
    want = {"jan26": 2.0}
    for before, now in zip(PERIODS, PERIODS[1:4], strict=False):
        want[now] = 1 + 2 * want[before] / 2
    assert {(r["region"], r["period"]): r["value"] for r in e.cells("m", "p").collect()} == {(k, p): v for k in "ab" for p, v in want.items()}
