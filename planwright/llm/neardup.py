"""MinHash near-dedup with min-max signatures.

Every permutation of the shingle hashes gives two values, its minimum and its maximum, so signatures cost
half the hash evaluations.  Bands take values of one kind, each from another permutation: five, or
as few as the likeness asked for needs.  Texts of
one shingle set are one class.  Classes that share a band are candidates; a link is confirmed on the full
shingle sets, as whole numbers.

Groups are never squared: each class is first confirmed against one leader of its buckets, then pairs are
looked at only across components that a bucket still holds apart, after a comparison of signatures, and
again until nothing new links.

Nulls: a null text is empty; a text without words links with nothing.  Null doc_ids are members but name
no component unless all of it is null.  Repeated rows are one class.  Other columns are ignored (kept by
``filter_documents``).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Values in a band at most, and the share of pairs that bands may miss at the likeness asked for.
BAND_ROWS, MISSED = 5, 1e-6
PERMUTATIONS = 100
SEED = 20_240_607
U = np.uint64
REMEMBER = 50_000
#: Values kept of a signature for comparisons before the exact one, a byte each.
SKETCH = 2 * PERMUTATIONS
#: Rows of ids that may be broadcast (24 bytes each at most).
BROADCAST_ROWS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ x >> U(31)
    x = x * U(0x7FB5D329728EA185)
    x = x ^ x >> U(27)
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ x >> U(33)


MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, PERMUTATIONS).astype(U) * U(2) + U(1)
ROW_MULTIPLIERS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BAND_ROWS).astype(U) * U(2) + U(1)
BAND_SALT = mix(np.arange(1, SKETCH + 1, dtype=U) * U(0x9E3779B97F4A7C15))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.powers = np.cumprod(np.full(width, 0x2545F4914F6CDD1D, U)) | U(1)

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = common.words(text)
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        try:
            codes = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.translate(common.LOWER_ASCII).encode("utf-8", "surrogatepass"))
            codes = [known[w] for w in words]
        x = np.array(codes, U)
        n, k = len(x), min(self.width, len(x))
        if not n:
            return x
        rolled = np.full(n - k + 1, k, U)
        for i in range(k):
            rolled += x[i : n - k + 1 + i] * self.powers[i]
        return np.unique(mix(rolled))


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima, then as many maxima."""
    low = np.full(PERMUTATIONS, ~U(0))
    high = np.zeros(PERMUTATIONS, U)
    for a in range(0, len(shingles), 1024):
        h = shingles[None, a : a + 1024] * MULTIPLIERS[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def band_rows(percent: int) -> int:
    """The most values in a band that let at most MISSED of the pairs of that likeness go by."""
    for rows in (5, 4, 2, 1):  # a kind's values are dealt out whole
        if (1 - (percent / 100) ** rows) ** (SKETCH // rows) <= MISSED:
            return rows
    raise ValueError(f"signatures of {SKETCH} values do not find pairs of {percent} percent likeness")


def sketch_least(percent: int) -> float:
    """A sketch share under which no pair of that likeness falls: six deviations below it, 0.63 from 80 percent on."""
    p = min(percent, 80) / 100
    return max(0.0, np.floor((p - 6 * np.sqrt(p * (1 - p) / SKETCH)) * 100) / 100)


def bands(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for every ``rows`` values of each signature."""
    grouped = signatures.reshape(len(signatures), SKETCH // rows, rows)
    return mix((mix(grouped) * ROW_MULTIPLIERS[:rows]).sum(2, dtype=U) ^ BAND_SALT[: SKETCH // rows])


def text_hash(docs: DataFrame) -> Column:
    """With doc_id, what verdicts are taken back by: ids may be null or repeat."""
    return F.xxhash64(common.text_or_empty(docs))


SIGNED = "doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>, sketch binary"


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), k1 and k2 (a checksum of the set), bands, sketch."""
    common.prepare(docs.sparkSession)
    per = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Shingler(width)
        for b in batches:
            sets = [f(t) for t in b.column(2).to_pylist()]
            with np.errstate(over="ignore"):
                k1 = np.array([mix(s).sum(dtype=U) for s in sets], U)
                k2 = np.array([mix(s ^ U(SEED)).sum(dtype=U) for s in sets], U)
                full = [signature(s) for s in sets if len(s)]
                keys = bands(np.array(full), per) if full else np.empty((0, SKETCH // per), U)
            mixed = iter(zip(keys.astype(np.int64), (mix(x) for x in full), strict=True))
            rows = [next(mixed) if len(s) else (np.empty(0, np.int64), np.empty(0, U)) for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)),
                pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([(r[1] >> U(56)).astype(np.uint8).tobytes() for r in rows], pa.binary()),
            ], ["doc_id", "text_hash", "n", "k1", "k2", "bands", "sketch"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), common.text_or_empty(docs).alias("text"))
    return rows.mapInArrow(common.tidied(run), SIGNED)


#: Rounds against leaders before components are compared pair by pair; they only save work.
ROUNDS = 2
#: Members up to which a bucket's pairs are joined outright; larger ones are compared block by block.
SMALL_BUCKET, BLOCK = 32, 512


def _count_upto(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _compatible(na: Column, nb: Column, percent: int) -> Column:
    """Set sizes that allow the likeness at all."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda x: nodes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    least = sketch_least(percent)
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(_compatible(F.col("na"), F.col("nb"), percent)).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, SKETCH) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= least))

    return rows.mapInArrow(common.tidied(run), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cid, shingles of the wanted classes (cid, rep), from whole texts."""
    few = _count_upto(wanted, BROADCAST_ROWS)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    joined = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(wanted["rep"])).select("cid", "n", "k1", "k2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Shingler(width)
        for b in batches:
            sets, keep = [], []
            for t, n, k1 in zip(*(b.column(i).to_pylist() for i in (4, 1, 2)), strict=True):
                s = f(t)
                same = len(s) == n and int(mix(s).sum(dtype=U).astype(np.int64)) == k1  # ids may repeat
                keep.append(same)
                if same:
                    sets.append(s.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), pa.array(sets, pa.list_(pa.int64()))], ["cid", "shingles"])

    return joined.mapInArrow(common.tidied(run), "cid long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.withColumn("both", both).withColumn("either", F.size("sa") + F.size("sb") - F.col("both"))
    return rows.filter(100 * F.col("both") >= percent * F.col("either")).select("a", "b")


def _to_leaders(placed: DataFrame, turn: int) -> DataFrame:
    """For each component, its most shared pair with a leader of another one's in a bucket they share."""
    order = lambda salt: F.struct(F.xxhash64("cid", F.lit(salt)).alias("h"), F.col("cid"), F.col("comp"))
    lead = placed.groupBy("band").agg(F.min(order(2 * turn)).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    own = placed.groupBy("band", "comp").agg(F.min(order(2 * turn + 1))["cid"].alias("cid"))
    met = own.join(lead.select("band", "lead"), "band").filter(F.col("comp") != F.col("lead.comp"))
    votes = met.groupBy("comp", "cid", F.col("lead.cid").alias("leader")).agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("comp").agg(F.max(F.struct("c", "cid", "leader")).alias("x"))
    return best.select(F.least("x.cid", "x.leader").alias("a"), F.greatest("x.cid", "x.leader").alias("b")).distinct()


def labelled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node reachable) of the links u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label[a], new[b])
        np.minimum.at(new, label[b], new[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """node, label (least node reachable) of every node of links (a, b).

    Up to ``BROADCAST_ROWS`` links (16 bytes each) are joined in one task; more by stars that grow and
    shrink, over shuffled partitions.
    """
    edges = common.staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    if _count_upto(edges, BROADCAST_ROWS):

        def run(frames):
            import pandas as pd

            got = [(f["u"].to_numpy(), f["v"].to_numpy()) for f in frames]
            if got:
                nodes, label = labelled(*(np.concatenate(x) for x in zip(*got, strict=True)))
                yield pd.DataFrame({"node": nodes, "label": label})

        return edges.coalesce(1).mapInPandas(run, "node long, label long")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        joined = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("m", "u"))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            # Every row of a node points it to the least; so its own link to the least is among them.
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        return out.filter("u <> v")

    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        edges = common.staged(star(star(edges, True), False).distinct(), "near-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough to join them.  members: band, cid, comp."""
    split = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    open_ = common.staged(members.join(split.select("band", "size"), "band"), "near-open")
    small = open_.filter(F.col("size") <= SMALL_BUCKET)
    a, b = (small.select("band", F.col("cid").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    joined = a.join(b, "band").filter("a < b and ca <> cb").select("a", "b").distinct()
    found = _confirmed(_similar(joined, nodes, percent), sets, percent)
    large = open_.filter(F.col("size") > SMALL_BUCKET)
    if large.isEmpty():
        return found
    # Components of over BLOCK members get blocks of their own; smaller ones share blocks, whole.
    sizes = large.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    large = large.drop("size").join(sizes, ["band", "comp"])
    own = F.col("c") > BLOCK
    part = F.when(own, F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("size") / BLOCK)))
    large = large.withColumn("owner", F.when(own, F.col("comp"))).withColumn("part", part)
    large = common.staged(large.select("band", "cid", "comp", F.xxhash64("owner", "part").alias("block"), "owner"), "near-large")
    blocks = large.select("band", "owner", "block").distinct()
    x, y = (blocks.select("band", F.col("owner").alias(f"o{s}"), F.col("block").alias(f"k{s}")) for s in "xy")
    tasks = x.join(y, "band").filter("kx <= ky and (ox is null or oy is null or ox <> oy)").select("band", "kx", "ky")
    rows = large.join(nodes.select("cid", "n", "sketch", "bands"), "cid").join(sets, "cid").withColumnRenamed("band", "_band")
    side = lambda of, key, number: of.join(rows, (F.col("band") == F.col("_band")) & (F.col(key) == F.col("block"))).select("band", "kx", "ky", "cid", "comp", "n", "sketch", "bands", "shingles", F.lit(number).alias("side"))
    both = side(tasks, "kx", 0).union(side(tasks.filter("kx <> ky"), "ky", 1))

    least = sketch_least(percent)

    def compare(f):
        import pandas as pd

        band = f["band"].iloc[0]
        p = f[f["side"] == 0]
        q = f[f["side"] == 1] if (f["side"] == 1).any() else p
        sp, sq = (np.frombuffer(b"".join(z["sketch"]), np.uint8).reshape(len(z), SKETCH) for z in (p, q))
        bp, bq = np.stack(p["bands"]), np.stack(q["bands"])
        np_, nq, cp, cq = p["n"].to_numpy(), q["n"].to_numpy(), p["comp"].tolist(), q["comp"].tolist()
        ip, iq, xp, xq = p["cid"].to_numpy(), q["cid"].to_numpy(), p["shingles"].tolist(), q["shingles"].tolist()
        root = {c: c for c in {*cp, *cq}}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i in range(len(p)):
            mine = find(cp[i])
            ok = (100 * np.minimum(nq, np_[i]) >= percent * np.maximum(nq, np_[i])) & np.fromiter((find(c) != mine for c in cq), bool, len(cq))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            at = at[(sq[at] == sp[i]).mean(1) >= least]
            # Each pair is looked at in the first bucket that it shares.
            at = at[bp[i][(bq[at] == bp[i]).argmax(1)] == band]
            for j in at.tolist():
                if find(cp[i]) == find(cq[j]):
                    continue
                both = len(np.intersect1d(xp[i], xq[j], assume_unique=True))
                if 100 * both >= percent * (np_[i] + nq[j] - both):
                    out.append((min(ip[i], iq[j]), max(ip[i], iq[j])))
                    root[find(cp[i])] = find(cq[j])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return found.union(both.groupBy("band", "kx", "ky").applyInPandas(compare, "a long, b long"))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, cid, component_id, comp (the group's own label; null without words): one row a row of ``docs``."""
    rows = common.staged(signed(docs, width, percent), "near-signed").withColumn("cid", F.xxhash64("n", "k1", "k2"))
    full = rows.filter("n > 0")
    nodes = full.groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    )
    nodes = common.staged(nodes, "near-nodes")
    banded = nodes.select("cid", F.explode("bands").alias("band"))
    shared = common.staged(banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band"), "near-buckets")
    members = common.staged(banded.join(shared, "band").select("band", "cid"), "near-members")
    met = common.staged(members.select("cid").distinct().join(nodes.select("cid", "rep", "n", "k1", "k2", "sketch", "bands"), "cid"), "near-met")
    sets = common.staged(_sets(docs, met.drop("sketch", "bands"), width), "near-sets")
    links, reached = None, met.select(F.col("cid").alias("node"), F.col("cid").alias("label"))
    for turn in range(ROUNDS + 1):
        placed = members.join(reached, members["cid"] == reached["node"], "left").select("band", "cid", F.coalesce("label", "cid").alias("comp"))
        placed = common.staged(placed, "near-placed")
        last = turn == ROUNDS
        found = _across(placed, met, sets, percent) if last else _confirmed(_similar(_to_leaders(placed, turn), met, percent), sets, percent)
        new = common.staged(found, "near-links")
        links = new if links is None else links.union(new)
        if turn == 0 or not new.isEmpty():
            reached = common.staged(components(links), "near-components")
    named = nodes.select("cid", "rep").join(reached, nodes["cid"] == reached["node"], "left").select("cid", "rep", F.coalesce("label", "cid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "comp").select("cid", "comp", "component_id")
    return rows.select("doc_id", "text_hash", "n", "cid").join(classes, "cid", "left")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, kept: one row a row of ``docs``."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return _grouped(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("cid").alias("class_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def filter_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, columns unchanged; rows without words all stay.

    Verdicts hold for doc_id and text together, so rows whose doc_id is null or repeated are told apart.
    """
    found = common.staged(_grouped(docs, width, percent).filter("n > 0").groupBy("comp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")), "near-result")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = found.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").select(F.col("comp").alias("_comp"), "first")
    key = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    gone = common.staged(found.join(first, found["comp"] == first["_comp"]).filter(order != F.col("first")).select(*key), "near-gone")
    repeated = found.filter("c > 1").select(*key)
    hashed = docs.withColumn("_text_hash", text_hash(docs))

    def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if _count_upto(keys, BROADCAST_ROWS) else keys
        return rows.join(keys, rows["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (rows["_text_hash"] == keys["_hash"]), how)

    stay = matching(hashed, gone, "left_anti")
    if not repeated.isEmpty():
        again = matching(stay, repeated, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
        stay = matching(stay, repeated, "left_anti").unionByName(again)
    return stay.select(*docs.columns)
