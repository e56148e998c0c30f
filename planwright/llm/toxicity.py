"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words (marks at their ends stripped) and their first four and five
letters, hashed to ``SPACE`` buckets.  A word's weight and factors are the sums of its terms'.  The score is
logistic(bias + sum of weights + sum over pairs of words of <v_i, v_j>), so two words together can mean
what neither does alone, and no word pairs with its own beginnings.

Labels are learnt from at most ``MOST`` rows of each class (those of least hash), weighted back to
their share; buckets in fewer than ``LEAST`` of these documents, and all but the ``KEEP`` that tell the
classes apart best, are left out.  A bucket tells by its own chi-square, or by that among the documents
that hold one of the ``ANCHORS`` buckets which tell most by themselves (less what the best of so many
tries has by chance): a harmless word that turns an insult into something else is kept for the pair.
The model is of fixed size.

Nulls: a null text is empty and scores by the bias; labels that are null or whose document is missing
are not learnt from; without both classes every score is the share of label 1 (0.5 with no labels).
Repeated rows are scored each; of documents that share a labelled id the one of least text hash is learnt
from, once for each class its labels name.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = 1 << 20
MOST, LEAST, KEEP = 4_000, 4, 8_192
ANCHORS, TERMS = 64, 3
RANK, EPOCHS, BATCH, RATE = 8, 10, 128, 0.05
#: Decay over all rows; squared gradients counted at the start (so that first steps are not all of full
#: length); spread of the factors' first values; their rate against the weights'.
DECAY_W, DECAY_V, FIRST, SPREAD, V_RATE = 1.0, 1.0, 1e-3, 0.003, 0.5
MARKS = ".,;:!?|#*$%&\"'()[]{}<>-_/\\"
REMEMBER = 50_000
#: Words that a scorer remembers, and characters scored at a time (one text at least), whose words are held meanwhile.
KNOWN, AT_ONCE = 100_000, 1_000_000


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % SPACE


def terms(word: str) -> tuple[int, ...]:
    """TERMS buckets of a lower-cased word, -1 where it has fewer."""
    w = word.strip(MARKS)
    if not w:
        return ()
    return (bucket(w), *(bucket(f"{k}^{w[:k]}") if len(w) > k else -1 for k in (4, 5)))


class Featurizer:
    """The terms of a text's distinct words, a row a word."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        found = set()
        for w in set(common.words(text.lower())):
            t = known.get(w)
            if t is None:
                t = known[w] = terms(w)
            if t:
                found.add(t)
        return np.array(sorted(found), np.int32).reshape(-1, TERMS)


class Machine:
    """bias, buckets in column order, weights and factors.  One more column, of zeros, is no bucket's."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias
        self.w = np.zeros(len(buckets) + 1)
        self.v = np.random.default_rng(7).normal(0, SPREAD, (len(buckets) + 1, RANK))
        self.v[-1] = 0

    def columns(self) -> np.ndarray:
        """Of every bucket, and at -1 of none."""
        at = np.full(SPACE + 1, len(self.buckets), np.int32)
        at[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return at

    def parts(self, x: np.ndarray) -> np.ndarray:
        """For each word (a row of columns): its weight, its factors, their square."""
        v = self.v[x].sum(1)
        return np.concatenate([self.w[x].sum(1)[:, None], v, np.square(v).sum(1)[:, None]], 1)

    def of_sum(self, s: np.ndarray) -> np.ndarray:
        """The scores of texts, from the sums of their words' parts."""
        raw = self.bias + s[..., 0] + 0.5 * (np.square(s[..., 1:-1]).sum(-1) - s[..., -1])
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class Scorer:
    """Scores of whole texts; a worker's words are looked up in a table of their parts."""

    def __init__(self, model: Machine):
        self.model, self.at = model, model.columns()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.of_terms: dict[tuple[int, ...], int] = {(): 0}  # words alike but for marks are one word
        self.rows = np.zeros((1, RANK + 2))  # row 0: words without a term

    def __call__(self, texts: list[str]) -> np.ndarray:
        before = np.cumsum([0, *map(len, texts)])
        start, out = 0, [np.empty(0)]
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(before, before[start] + AT_ONCE, side="right")) - 1)
            out.append(self._scores(texts[start:end]))
            start = end
        return np.concatenate(out)

    def _scores(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.forget()
        split = [set(common.words(t.lower())) for t in texts]
        new = {w: terms(w) for w in set().union(*split) if w not in self.known}
        unseen = [t for t in dict.fromkeys(new.values()) if t not in self.of_terms]
        if unseen:
            columns = self.at[np.array(unseen)]
            kept = (columns < len(self.model.buckets)).any(1)
            self.of_terms.update(zip(unseen, np.where(kept, len(self.rows) + np.cumsum(kept) - 1, 0).tolist(), strict=True))
            self.rows = np.concatenate([self.rows, self.model.parts(columns[kept])])
        self.known.update((w, self.of_terms[t]) for w, t in new.items())
        out = np.empty(len(texts))
        for i, words in enumerate(split):
            rows = np.fromiter({self.known[w] for w in words}, np.int64)
            out[i] = self.model.of_sum(self.rows[rows].sum(0))
        return out


def screen(flat: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The buckets to keep, ascending, from distinct (bucket, document) and the documents' labels."""

    def chi(n: np.ndarray, n1: np.ndarray, total: float, ones: float) -> np.ndarray:
        expected = n * ones / total
        return np.square(n1 - expected) / np.maximum(expected * (1 - ones / total) * (1 - n / total) + 1e-9, 1e-9)

    n = np.bincount(flat, minlength=SPACE)
    seen = np.flatnonzero(n >= LEAST)
    column = np.full(SPACE, -1, np.int32)
    column[seen] = np.arange(len(seen), dtype=np.int32)
    x = column[flat]
    x, doc = x[x >= 0], doc[x >= 0]
    best = chi(n[seen], np.bincount(x, weights=y[doc], minlength=len(seen)), len(y), y.sum())
    if len(seen) <= KEEP:
        return seen
    chance = 2 * np.log(ANCHORS)
    for anchor in np.argsort(-best, kind="stable")[:ANCHORS]:
        held = np.zeros(len(y), bool)
        held[doc[x == anchor]] = True
        mine = held[doc]
        among, ones = held.sum(), y[held].sum()
        here = np.bincount(x[mine], minlength=len(seen))
        found = chi(here, np.bincount(x[mine], weights=y[doc[mine]], minlength=len(seen)), among, ones) - chance
        best = np.where((here >= LEAST) & (here <= among - LEAST), np.maximum(best, found), best)
    return np.sort(seen[np.argsort(-best, kind="stable")[:KEEP]])


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, factors: bool = True) -> Machine:
    """AdaGrad on logistic loss; rows hold the terms of distinct words.  Without ``factors`` only weights are learnt."""
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(set(y.tolist())) < 2:
        return Machine(np.empty(0, np.int64), bias)
    # A text's distinct buckets, four bytes each: the driver holds MOST rows of each class, whole.
    distinct = [np.unique(r[r >= 0]) for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in distinct])
    m = Machine(screen(np.concatenate(distinct), owner, y), bias)
    del distinct, owner
    none = len(m.buckets)
    if not factors:
        m.v[:] = 0
    columns = m.columns()
    kept = [c[(c < none).any(1)] for c in (columns[r] for r in rows)]
    words = np.concatenate(kept)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in kept])
    del kept
    bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
    gw, gv, gb = np.full(none + 1, FIRST), np.full((none + 1, RANK), FIRST), FIRST
    weight = weight / weight.mean()
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
            x = np.concatenate([words[bounds[b] : bounds[b + 1]] for b in batch])
            d = np.repeat(np.arange(len(batch)), bounds[batch + 1] - bounds[batch])
            parts = m.parts(x)
            s = np.zeros((len(batch), RANK + 2))
            np.add.at(s, d, parts)
            error = (m.of_sum(s) - y[batch]) * weight[batch] / len(batch)
            u, back = np.unique(x, return_inverse=True)
            back = back.ravel()
            dw = np.bincount(back, weights=np.repeat(error[d], TERMS), minlength=len(u)) + DECAY_W * m.w[u] / len(rows)
            real = u < none
            u, dw = u[real], dw[real]
            gw[u] += np.square(dw)
            m.w[u] -= RATE * dw / np.sqrt(gw[u])
            if factors:
                slope = error[d][:, None] * (s[d, 1:-1] - parts[:, 1:-1])
                dv = np.stack([np.bincount(back, weights=np.repeat(slope[:, k], TERMS), minlength=len(real)) for k in range(RANK)], 1).astype(float)[real]
                dv += DECAY_V * m.v[u] / len(rows)
                gv[u] += np.square(dv)
                m.v[u] -= RATE * V_RATE * dv / np.sqrt(gv[u])
            gb += error.sum() ** 2
            m.bias -= RATE * error.sum() / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> Machine:
    """``learn``: which rows of ``docs`` (doc_id, text) may be learnt from."""
    common.prepare(docs.sparkSession)
    known = labels.filter(labels["toxic"].isNotNull()).select(labels["doc_id"].cast("long").alias("label_id"), labels["toxic"].cast("int").alias("toxic"))
    pool = known.filter(learn).withColumn("_h", F.xxhash64("label_id"))
    few = [pool.filter(F.col("toxic") == k).orderBy("_h", "label_id").limit(most) for k in (0, 1)]
    counts = {r["toxic"]: r["n"] for r in pool.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = few[0].unionByName(few[1]).select("label_id", "toxic").distinct()  # at most 2 * most rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for b in batches:
            x = [f(t).ravel() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "h", "toxic", "x"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    joined = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["label_id"]).select("doc_id", "h", "text", "toxic")
    terms_of = joined.mapInArrow(common.tidied(run), "doc_id long, h long, toxic int, x array<int>")
    # A row an id and class, however often its document is repeated.
    found = terms_of.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", "x"))["x"].alias("x")).toArrow()
    ids, y = found.column("doc_id").to_numpy(), found.column("toxic").to_numpy().astype(float)
    x = found.column("x").combine_chunks()
    del found
    order = np.lexsort((y, ids))
    offsets, flat = x.offsets.to_numpy(), x.values.to_numpy()
    rows_x, y = [flat[offsets[i] : offsets[i + 1]].reshape(-1, TERMS) for i in order], y[order]
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 0) / n[int(k)] for k in y])
    del x, offsets, flat
    model = train(rows_x, y, weight)
    del rows_x
    common.give_back()
    return model


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score of every row."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    return rows.mapInArrow(common.tidied(run), "doc_id long, score double")


def held_out_score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn from rows outside the held fold; score all."""
    model = fit(docs, labels, common.fold(F.col("label_id"), folds) != held)
    out = score(docs, model)
    return out.select("doc_id", (common.fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows scored under 0.5, columns unchanged, in one pass over whole rows."""
    spark = docs.sparkSession
    model = fit(docs, labels, common.fold(F.col("label_id"), folds) != held)
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(f([t or "" for t in b.column(at).to_pylist()]) < 0.5))

    return docs.mapInArrow(common.tidied(run), docs.schema)
