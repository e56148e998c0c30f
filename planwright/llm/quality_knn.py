"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are lower-cased words, word shapes ("A!!", "a###", "a.") and two page-level ones (how much of the
text repeats, how long it is), hashed to ``SPACE`` columns.  The labelled rows' TF-IDF matrix is reduced
to ``DIM`` dimensions by a randomised SVD; their vectors go to every task.  Each document's vector is
compared with all of them, block by block, and the ``NEAR`` nearest vote, weighted by similarity.

Labels are learnt from at most ``MOST`` rows of each class (those of least hash), whose votes are
weighted back to the classes' shares.  Nulls: a null text is empty; a text without terms scores the share
of label 1.  Null labels and labels of missing documents are not learnt from; with no labels every score
is 0.5.  Repeated rows are scored each; of documents that share a labelled id the one of least text hash is
learnt from, once for each class its labels name.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .rules import repeated_words

SPACE, DIM, NEAR, MOST = 4_096, 64, 15, 2_048
BLOCK = 512
REMEMBER = 150_000
#: How much more a shape says than a word.
SHAPE_WEIGHT = 4.0
POWER = 8
LETTERS, DIGITS, RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def column(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % SPACE


def shape(word: str) -> str:
    """'Über...' is 'Aa.', 'STOP!!' is 'A!', 'x1' is 'a9'."""
    s = LETTERS.sub(lambda m: "A" if (t := m[0]).isupper() and len(t) > 1 else "Aa" if t[0].isupper() else "a", word)
    return RUN.sub(r"\1", DIGITS.sub("9", s))[:12]


class Terms:
    """Term counts of a text, as (columns, weights)."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = common.words(text)
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        found: Counter = Counter()
        shapes: Counter = Counter()
        for w, n in Counter(words).items():
            t = known.get(w)
            if t is None:
                t = known[w] = column("w" + w.lower().strip(".,!|#*$%&")), column("s" + shape(w))
            found[t[0]] += n
            shapes[t[1]] += n
        total = len(words)
        weights: dict[int, float] = {c: math.log1p(n) / math.log1p(total) for c, n in found.items()}
        for c, n in shapes.items():
            weights[c] = weights.get(c, 0.0) + SHAPE_WEIGHT * math.sqrt(n / total)
        repeats = column(f"r{math.ceil(8 * repeated_words(words) / total)}")
        weights[repeats] = weights.get(repeats, 0.0) + SHAPE_WEIGHT
        size = column(f"n{min(12, total.bit_length())}")
        weights[size] = weights.get(size, 0.0) + 1.0
        return np.fromiter(weights, np.int64, len(weights)), np.fromiter(weights.values(), np.float32, len(weights))


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), SPACE), np.float32)
    for i, (c, w) in enumerate(rows):
        out[i, c] = w
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voters:
    """The projection, the labelled vectors, their labels and vote weights."""

    def __init__(self, rows: list, y: np.ndarray, weight: np.ndarray, share: float):
        self.share, self.y, self.weight = share, y.astype(np.float32), weight.astype(np.float32)
        self.vectors = None
        if len(y):
            x = dense(rows)
            self.idf = np.log((1 + len(y)) / (1 + (x > 0).sum(0))).astype(np.float32)
            x = unit(x * self.idf)
            probe = np.random.default_rng(3).normal(size=(SPACE, DIM + 16)).astype(np.float32)
            q = x @ probe
            for _ in range(3):
                q = np.linalg.qr(x @ (x.T @ np.linalg.qr(q)[0]))[0]
            basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:DIM]
            self.project = np.ascontiguousarray(basis.T)
            self.vectors = unit(x @ self.project)

    def score(self, rows: list) -> np.ndarray:
        """Exact cosines with every voter, in blocks."""
        out = np.full(len(rows), self.share)
        if self.vectors is None:
            return out
        near = min(NEAR, len(self.y))
        for a in range(0, len(rows), BLOCK):
            part = rows[a : a + BLOCK]
            q = unit((dense(part) * self.idf) @ self.project)
            cosine = q @ self.vectors.T
            top = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            vote = np.maximum(np.take_along_axis(cosine, top, 1), 0) ** POWER * self.weight[top]
            total = vote.sum(1)
            ok = (total > 1e-9) & np.array([len(c) > 0 for c, _ in part])
            out[a : a + len(part)][ok] = ((vote * self.y[top]).sum(1) / np.maximum(total, 1e-9))[ok]
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> Voters:
    common.prepare(docs.sparkSession)
    known = labels.filter(labels["quality"].isNotNull()).select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].cast("int").alias("quality"))
    pool = known.filter(learn).withColumn("_h", F.xxhash64("label_id"))
    few = [pool.filter(F.col("quality") == k).orderBy("_h", "label_id").limit(most) for k in (0, 1)]
    counts = {r["quality"]: r["n"] for r in pool.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = few[0].unionByName(few[1]).select("label_id", "quality").distinct()  # at most 2 * most rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Terms()
        for b in batches:
            x = [f(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([c for c, _ in x], pa.list_(pa.int64())), pa.array([w for _, w in x], pa.list_(pa.float32()))],
                ["doc_id", "h", "quality", "c", "w"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    joined = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["label_id"]).select("doc_id", "text", "h", "quality")
    terms_of = joined.mapInArrow(common.tidied(run), "doc_id long, h long, quality int, c array<long>, w array<float>")
    # A row an id and class, however often its document is repeated.
    found = terms_of.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "c", "w")).alias("x")).select("doc_id", "quality", "x.c", "x.w")
    found = found.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    y = found.column("quality").to_numpy().astype(float)
    lists = []
    for name in ("c", "w"):
        x = found.column(name).combine_chunks()
        offsets, flat = x.offsets.to_numpy(), x.values.to_numpy()
        lists.append([flat[i:j] for i, j in zip(offsets, offsets[1:], strict=False)])
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 0) / n[int(k)] for k in y])
    all_ = sum(counts.get(k, 0) for k in (0, 1))
    voters = Voters(list(zip(*lists, strict=True)), y, weight, counts.get(1, 0) / all_ if all_ else 0.5)
    del lists, found
    common.give_back()
    return voters


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, score of every row."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, f = shared.value, Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.score([f(t) for t in b.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    return rows.mapInArrow(common.tidied(run), "doc_id long, score double")


def held_out_score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, at: float = 0.7) -> DataFrame:
    """Learn from rows outside the held fold; score all."""
    voters = fit(docs, labels, common.fold(F.col("label_id"), folds) != held)
    out = score(docs, voters)
    return out.select("doc_id", (common.fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
