"""Quality rules with robust multivariate outliers.

Base rules come first (too few words, too many repeated word windows).  What passes them is judged by
Mahalanobis distance under minimum-covariance-determinant estimates, one per language and source: centre and
covariance of the ``SHARE`` of rows whose covariance (plus the least one that ``FLOOR`` allows) has the
smallest determinant.  Three starts from all rows (medians with median deviations alone, with the
correlations of their squashed values, with those of their directions) take concentration steps: the
``SHARE`` of rows nearest to the centre give the next one.  After two steps the start of the smallest
determinant goes on until no group's falls any more.  A step is one aggregation to (group, distance bin), so
a group of any size is summed where its rows lie; of the bin that the share ends in, a part counts.

A row is an outlier beyond the chi-square distance that a row of a normal sample passes once in 1 / ``FALSE``.

Groups of under ``LEAST`` rows pool by language, those again over everything; a pool still under
``LEAST`` rejects nothing.  Nulls: a null text has no words (base_failed); null language and source are
groups of their own.  Repeated rows are judged each.  Other columns pass through ``filter_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS, REPEAT_PERCENT = 50, 50
SHARE, LEAST = 0.75, 50
#: Steps with all starts, steps at most (they end much earlier), and the fall of log determinants that still counts.
FIRST_STEPS, MOST_STEPS, FALL = 2, 40, 1e-3
FALSE = 1e-7
# Statistics: log words, letters a word (64 at most), root of symbols a word, repeated lines a line,
# repeated words a word, upper-case words a word.  FLOOR: the least standard deviation of each.
FLOOR = (0.7, 0.5, 0.08, 0.08, 0.07, 0.08)
P = len(FLOOR)
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
BINS = 256  # to a doubling of the distance
X = [f"x{i}" for i in range(P)]


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def count(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    words = common.words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), sum(map(str.isupper, words)),
    )


def _mark(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def row_hash(docs: DataFrame) -> Column:
    """Of all that a verdict depends on; with doc_id, what verdicts are taken back by."""
    return F.xxhash64(common.text_or_empty(docs), _mark(docs["lang"]), _mark(docs["source"]))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_hash, and COUNTS of every row."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count(t) for t in b.column(4).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "lang", "source", "row_hash", *COUNTS])

    cast = [docs[c].cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"))]
    return docs.select(*cast, row_hash(docs).alias("row_hash"), common.text_or_empty(docs).alias("text")).mapInArrow(common.tidied(run), "doc_id long, lang string, source string, row_hash long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vector() -> list[Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.log(n), F.least(F.col("word_chars") / n, F.lit(64.0)), F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / n, F.col("n_upper") / n,
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def chi_square(x: float, degrees: int) -> float:
    """The share of a chi-square distribution of even degrees that is below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def quantile(share: float, degrees: int = P) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, degrees) < share else (lo, mid)
    return lo


def consistency() -> float:
    """What makes the covariance of the nearest SHARE of a normal sample that of the whole."""
    return SHARE / chi_square(quantile(SHARE), P + 2)


def cutoff() -> float:
    """Squared distance beyond which a row is an outlier."""
    return quantile(1 - FALSE)


PARAMS = "pg string, start int, mean array<double>, inverse array<double>, log_det double, fall double"
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _params(g: str, start: int, mean: np.ndarray, cov: np.ndarray, before: float = math.inf) -> pd.DataFrame:
    """The determinant is of the covariance plus the floor's, the one that concentration steps lower."""
    cov = cov + np.diag(np.square(FLOOR))
    log_det = float(np.linalg.slogdet(cov)[1])
    return pd.DataFrame({"pg": [g], "start": [start], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "log_det": [log_det], "fall": [before - log_det]})


def _medians(rows: DataFrame) -> DataFrame:
    """g, middle and scale of each statistic, from histograms of its 1/64ths."""
    bins = rows.select("g", F.posexplode(F.array(*X)).alias("i", "x")).groupBy("g", "i", F.round(F.col("x") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        mean, scale = np.zeros(P), np.ones(P)
        for i, h in f.groupby("i"):
            h = h.sort_values("bin")
            x, n = h["bin"].to_numpy() / 64, h["n"].to_numpy()
            mean[i] = middle = x[np.searchsorted(np.cumsum(n), n.sum() / 2)]
            off = np.abs(x - middle)
            order = np.argsort(off, kind="stable")
            scale[i] = 1.4826 * off[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        return pd.DataFrame({"pg": [f["g"].iloc[0]], "mean": [mean.tolist()], "scale": [np.maximum(scale, FLOOR).tolist()]})

    return bins.groupBy("g").applyInPandas(run, "pg string, mean array<double>, scale array<double>")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Three starts a group."""
    z = [(F.col(x) - F.col("mean")[i]) / F.col("scale")[i] for i, x in enumerate(X)]
    scaled = _joined(rows, common.staged(_medians(rows), "rule-medians"), few).select("g", "mean", "scale", *(c.alias(x) for c, x in zip(z, X, strict=True)))
    length = F.greatest(F.sqrt(sum((F.col(x) * F.col(x) for x in X), F.lit(0.0))), F.lit(1e-9))
    sums = []
    for name, of in (("t", F.tanh), ("u", lambda c: c / length)):
        sums += [F.sum(of(F.col(X[i])) * of(F.col(X[j]))).alias(f"{name}{i}_{j}") for i, j in PAIRS]
    found = scaled.groupBy("g").agg(F.first("mean").alias("mean"), F.first("scale").alias("scale"), *sums)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, r in f.iterrows():
                mean, scale = np.array(r["mean"]), np.array(r["scale"])
                yield _params(r["g"], 0, mean, np.diag(np.square(scale)))
                for start, name in ((1, "t"), (2, "u")):
                    cov = np.zeros((P, P))
                    for i, j in PAIRS:
                        cov[i, j] = cov[j, i] = r[f"{name}{i}_{j}"]
                    d = np.sqrt(np.diag(cov)) + 1e-9
                    cov = cov / np.outer(d, d)
                    np.fill_diagonal(cov, 1.0)
                    yield _params(r["g"], start, mean, cov * np.outer(scale, scale))

    return found.mapInPandas(run, PARAMS)


def _distance() -> Column:
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(X)]
    total = None
    for i, j in PAIRS:
        term = d[i] * d[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


#: Rows of groups or their parameters that may be broadcast; beyond, a shuffled join, which splits hot groups.
FEW = 20_000


def _joined(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(params) if few else params, rows["g"] == params["pg"]).drop("pg")


def _concentrate(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """One step of every start."""
    binned = _joined(rows, params.drop("fall"), few).withColumn("bin", F.floor(F.log2(1 + _distance()) * BINS))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
    cells = binned.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("log_det").alias("before"), *sums)
    factor = consistency()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin")
        n = f["n"].to_numpy(float)
        below = np.cumsum(n) - n
        part = np.clip((np.ceil(SHARE * n.sum()) - below) / n, 0, 1)
        near = lambda c: float(f[c].to_numpy() @ part)
        total = float(n @ part)
        mean = np.array([near(f"s{i}") for i in range(P)]) / total
        cov = np.zeros((P, P))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = near(f"q{i}_{j}") / total - mean[i] * mean[j]
        return _params(f["g"].iloc[0], int(f["start"].iloc[0]), mean, cov * factor, float(f["before"].iloc[0]))

    return cells.groupBy("g", "start").applyInPandas(run, PARAMS)


def _estimates(rows: DataFrame, few: bool) -> DataFrame:
    """pg, mean, inverse: the smallest determinant's of each group."""
    params = common.staged(_starts(rows, few), "rule-start")
    for _ in range(FIRST_STEPS):
        params = common.staged(_concentrate(rows, params, few), "rule-step")
    best = params.groupBy("pg").agg(F.min_by(F.struct(*params.columns), F.struct("log_det", "start")).alias("p")).select("p.*")
    params = common.staged(best, "rule-best")
    for _ in range(MOST_STEPS):
        params = common.staged(_concentrate(rows, params, few), "rule-step")
        if (params.agg(F.max("fall")).first()[0] or 0.0) < FALL:
            break
    return params.select("pg", "mean", "inverse")


def judge(stats: DataFrame) -> DataFrame:
    """Adds base_failed, distance (null where not judged) and kept to ``statistics`` rows (best staged)."""
    key = [_mark(F.col("lang")), _mark(F.col("source"))]
    fit = stats.filter(~base_failed())
    groups = fit.groupBy(key[0].alias("gl"), key[1].alias("gs")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = groups.groupBy(F.col("gl").alias("ll")).agg(F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).alias("pool"))
    level = F.when(F.col("n") >= LEAST, F.concat_ws("\x01", "gl", "gs")).when(F.col("pool") >= LEAST, F.concat_ws("\x01", "gl", F.lit("*"))).otherwise(F.lit("*"))
    keyed = common.staged(groups.join(by_lang, F.col("gl") == F.col("ll")).select("gl", "gs", level.alias("g")), "rule-groups")
    few = keyed.limit(FEW + 1).count() <= FEW
    rows = stats.withColumns({"_l": key[0], "_s": key[1]}).withColumns(dict(zip(X, _vector(), strict=True)))
    rows = rows.join(F.broadcast(keyed) if few else keyed, (F.col("_l") == F.col("gl")) & (F.col("_s") == F.col("gs")), "left").drop("gl", "gs", "_l", "_s")
    good = rows.filter(~base_failed()).select("g", *X)
    params = _estimates(good, few)
    sizes = good.groupBy("g").agg(F.count(F.lit(1)).alias("gn")).withColumnRenamed("g", "pg2")
    params = common.staged(params.join(sizes, params["pg"] == F.col("pg2")).filter(F.col("gn") >= LEAST).drop("pg2", "gn"), "rule-params")
    judged = rows.join(F.broadcast(params) if few else params, rows["g"] == params["pg"], "left")
    judged = judged.withColumn("base_failed", base_failed()).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff())
    return judged.withColumn("kept", kept).drop("g", "pg", "mean", "inverse")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, distance, kept."""
    return judge(common.staged(statistics(docs), "rule-statistics")).drop("row_hash", *X)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged, whether or not their doc_ids are null or repeated."""
    verdicts = judge(common.staged(statistics(docs), "rule-statistics")).filter(~F.col("kept"))
    gone = common.staged(verdicts.select(F.col("doc_id").alias("_k"), F.col("row_hash").alias("_h")).distinct(), "rule-verdicts")
    few = gone.limit(1_000_001).count() <= 1_000_000  # 24 bytes each at most; else both sides are shuffled
    hashed = docs.withColumn("_row_hash", row_hash(docs))
    same = hashed["doc_id"].cast("long").eqNullSafe(gone["_k"]) & (hashed["_row_hash"] == gone["_h"])
    return hashed.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)
