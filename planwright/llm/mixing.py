"""Mixing sources to target weights by pivotal dependent rounding.

A source of size S and target T takes each of its documents T/S times: the whole part outright, the
fraction by pivotal rounding.  Two fractional documents at a time pass words (not copies) to one another,
at odds that leave both expectations as they were, until one is whole; the other goes on.  Documents go by
size, largest first, powers of two apart; what a power leaves open is paired with all smaller documents
together, where they can take its words.  So the words taken stay at the target but for one small document
a source, and every document's expected copies are its share.  Chunks of a source reduce side by side and
leave one residual each; residuals reduce again in a tree, and at its root the last is rounded by a draw.
Only where that misses by over ``NEAR`` of the target (a source of few documents, or with one too large for
the rest to make up for) documents at the root are exchanged to come nearer, against the odds.

Draws are hashes of the two documents, so reruns agree.  Rows alike in source, doc_id and size are one
unit and share their number of copies.  Null sources are a source of their own (last); null texts have
size 0 and take 0.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: Units in one chunk of a source, and residuals in one chunk of a later level.
CHUNK = 2_000
#: Sources whose totals the driver may hold.
MOST_SOURCES = 1_000_000
#: Share of a source's target that the last rounding may miss it by.
NEAR = 0.01
#: slack: words by which a source may miss its target; null below the root.
UNITS = "source string, doc_id long, size long, m long, whole long, fraction double, chunk long, slack double"
CLOSE = 1e-12


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> dict[str | None, float]:
    """Each source's target: shares by weight, none above ``most`` times its size."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    out: dict[str | None, float] = {}
    left = float(sum(size.values()))
    free = dict(weight)
    while free:
        share = left / sum(free.values())
        over = [s for s in free if free[s] * share > most * size[s]]
        if not over:
            return out | {s: w * share for s, w in free.items()}
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
            del free[s]
    return out


def draw(*parts: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / (1 << 56)


def reduce_chunk(rows: list[tuple], seed: int, slack: float | None) -> list[float]:
    """Fractions after pivoting, 0.0 or 1.0; without ``slack`` (below the root) one may stay open.  rows: (doc_id, words, fraction)."""
    out = np.array([p for *_, p in rows], float)
    words = np.array([n for _, n, _ in rows], float)
    order = np.array(sorted(np.flatnonzero((out > 0) & (out < 1)), key=lambda k: (-rows[k][1], rows[k][0] is None, rows[k][0] or 0)), int)
    power = np.frexp(words[order])[1]
    held, at = None, 0
    while at < len(order):
        end = at + int(np.searchsorted(-power[at:], -power[at], side="right"))
        for j in order[at:end]:
            if 0 < out[j] < 1:
                held = j if held is None else pivot(out, words, held, j, draw(seed, rows[held][0], rows[j][0]))
        if held is not None and end < len(order) and pool(out, words, held, order[end:], draw(seed, rows[held][0], "rest")):
            held = None
        at = end
    result = out.tolist()
    if held is not None and slack is not None:
        settle(rows, result, held, seed, slack)
    return result


def pivot(out: np.ndarray, words: np.ndarray, i: int, j: int, u: float) -> int | None:
    """Pass words between i and j until one is whole; the one left open, if any."""
    si, sj = words[i], words[j]
    a, b = out[i] * si, out[j] * sj
    up, down = min(si - a, b), min(a, sj - b)  # i may gain, lose
    moved = up if u * (up + down) < down else -down
    if moved > 0:
        first, whole = (i, 1.0) if si - a <= b else (j, 0.0)
    else:
        first, whole = (i, 0.0) if a <= sj - b else (j, 1.0)
    other = j if first == i else i
    out[first] = whole
    rest = (a + b - whole * words[first]) / words[other]
    out[other] = 0.0 if rest < CLOSE else 1.0 if rest > 1 - CLOSE else rest
    return other if 0 < out[other] < 1 else None


def pool(out: np.ndarray, words: np.ndarray, i: int, rest: np.ndarray, u: float) -> bool:
    """Make i whole against all of ``rest`` together, each as far as it can go both ways; False where they can't take it."""
    p, size = out[i], words[i]
    rest = rest[(out[rest] > 0) & (out[rest] < 1)]
    q, s = out[rest], words[rest]
    share = np.minimum(q * s / ((1 - p) * size), (1 - q) * s / (p * size))
    if share.sum() < 1:
        return False
    share /= share.sum()
    up = u < p
    q = q - share * (1 - p) * size / s if up else q + share * p * size / s
    out[i] = float(up)
    out[rest] = np.where(q < CLOSE, 0.0, np.where(q > 1 - CLOSE, 1.0, q))
    return True


def settle(rows: list[tuple], out: list[float], held: int, seed: int, slack: float) -> None:
    """Round the last fraction by a draw; what that adds or takes over ``slack``, others give or get, largest first."""
    up = draw(seed, rows[held][0]) < out[held]
    error = (float(up) - out[held]) * rows[held][1]
    out[held] = float(up)
    if abs(error) <= slack:
        return
    for j in sorted(range(len(rows)), key=lambda k: (-rows[k][1], draw(seed, rows[k][0]))):
        if j != held and 0 < rows[j][1] <= abs(error) and out[j] == float(error > 0):
            out[j] = 1.0 - out[j]
            error -= math.copysign(rows[j][1], error)
    # One exchange of a taken for an untaken document, where that comes nearer.
    taken = [j for j in range(len(rows)) if out[j] == 1.0]
    spare = sorted((rows[j][1], j) for j in range(len(rows)) if out[j] == 0.0 and rows[j][1])
    best = (abs(error), None, None)
    for j in taken if spare else []:
        at = bisect.bisect_left(spare, (rows[j][1] - error, -1))
        for size, k in spare[max(0, at - 1) : at + 1]:
            best = min(best, (abs(error - rows[j][1] + size), j, k), key=lambda x: x[0])
    if best[1] is not None:
        out[best[1]], out[best[2]] = 0.0, 1.0


def _level(units: DataFrame, seed: int) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
        words = (frame["size"] * frame["m"]).tolist()
        slack = frame["slack"].iloc[0]
        return frame.assign(fraction=reduce_chunk(list(zip(ids, words, frame["fraction"].tolist(), strict=True)), seed, None if pd.isna(slack) else float(slack)))

    return units.groupBy("source", "chunk").applyInPandas(run, UNITS)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Per unit: source, doc_id, size, m (rows alike), copies, source_size, target."""
    spark = docs.sparkSession
    common.prepare(spark)
    measured = docs.select(
        docs["source"].cast("string").alias("source"), docs["doc_id"].cast("long").alias("doc_id"),
        F.regexp_count(common.text_or_empty(docs), F.lit(common.WORD)).cast("long").alias("size"),
    )
    units = common.staged(measured.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.count(F.lit(1)).alias("n")).take(MOST_SOURCES + 1)
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    target = targets([(t["source"], t["words"]) for t in totals], weights, most)
    plan = []
    for t in totals:
        factor = target[t["source"]] / t["words"] if t["words"] else 0.0
        whole = min(math.floor(factor), most)
        fraction = factor - whole if most > whole else 0.0
        plan.append((t["source"], int(t["words"]), float(target[t["source"]]), whole, fraction, max(1, -(-t["n"] // chunk))))
    rates = F.broadcast(spark.createDataFrame(plan, "rate_source string, source_size long, target double, whole long, fraction double, chunks long"))
    rated = units.join(rates, units["source"].eqNullSafe(rates["rate_source"])).drop("rate_source")
    fields = [f.split()[0] for f in UNITS.split(", ")]
    mass = F.col("size") > 0
    first = rated.withColumn("fraction", F.when(mass, F.col("fraction")).otherwise(0.0)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), "chunks")).withColumn("slack", F.when(F.col("chunks") == 1, F.col("target") * NEAR))
    level = common.staged(_level(first.select(*fields), seed), "mix-level")
    open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    settled = [level.filter(~open_)]
    depth, width = 0, max((p[5] for p in plan), default=1)
    while width > 1:
        width = -(-width // chunk)
        depth += 1
        up = level.filter(open_).withColumn("chunk", F.pmod(F.col("chunk"), F.lit(width)))
        if width == 1:
            slack = rates.select(F.col("rate_source").alias("_s"), (F.col("target") * NEAR).alias("_slack"))
            up = up.join(F.broadcast(slack), up["source"].eqNullSafe(F.col("_s"))).withColumn("slack", F.col("_slack")).select(*fields)
        level = common.staged(_level(up, seed + depth), "mix-level")
        settled.append(level.filter(~open_))
    all_ = settled[0]
    for s in settled[1:]:
        all_ = all_.unionByName(s)
    all_ = all_.withColumn("copies", F.col("whole") + F.col("fraction").cast("long")).select("source", "doc_id", "size", "m", "copies")
    sized = rates.select("rate_source", "source_size", "target")
    return all_.join(F.broadcast(sized), all_["source"].eqNullSafe(sized["rate_source"])).drop("rate_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """The mixed documents: every row as often as it is taken, columns unchanged."""
    taken = copies(docs, weights, most, seed).filter("copies > 0").select(
        F.col("source").alias("_mix_source"), F.col("doc_id").alias("_mix_doc"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies")
    )
    names = docs.columns
    sized = docs.withColumn("_mix_words", F.regexp_count(common.text_or_empty(docs), F.lit(common.WORD)).cast("long"))
    same = sized["source"].cast("string").eqNullSafe(taken["_mix_source"]) & sized["doc_id"].cast("long").eqNullSafe(taken["_mix_doc"]) & (sized["_mix_words"] == taken["_mix_size"])
    joined = sized.join(taken, same).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return joined.select(*names)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken."""
    found = copies(docs, **options)
    each = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
