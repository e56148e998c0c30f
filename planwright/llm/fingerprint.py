"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle (five lower-cased words; a shorter text is one shingle) is hashed once; the top bits pick
one of 256 bins, which keeps its least hash.  An empty bin copies the first filled bin in an order that
depends on the bin alone: hashed attempts first, then all bins by a hash rank, so that bins of two texts
meet as often as their shingles do.  Four low-order bits of each bin's value are stored, as one hex digit;
``likeness`` takes off the matches that four bits give by chance.

Nulls: a null text is empty; a text without words has the fingerprint '', like only to itself.  Null
doc_ids come last in descending order.  Repeated rows and equal ids are rows each, ordered by text.
Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
BINS, BIN_SHIFT = 256, 55
LOW_BITS = 4
ATTEMPTS = 24
BLANKS = " \t\n\x0b\x0c\r"
LEAST_ID = -(1 << 63)


def _bin(h: Column) -> Column:
    return F.shiftright(h, BIN_SHIFT).cast("int")


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name`` (256 hex digits, or '') of the whole ``text`` column.

    Each step is a column of its own, so that no array is computed once an element.
    """
    t, w, s, b, d = (f"_{name}_{x}" for x in "twsbd")
    kept = df.columns
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    out = df.withColumn(t, F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    empty = (F.size(t) == 1) & (F.get(t, F.lit(0)) == "")
    out = out.withColumn(w, F.when(~empty, F.transform(t, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    n = F.size(w)
    positive = lambda h: F.shiftrightunsigned(h, 1)
    rolled = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: positive(F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH)))))
    short = F.when(n > 0, F.array(positive(F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(s, F.sort_array(F.when(n >= WIDTH, rolled).otherwise(short)))
    # The first of each bin's run in the sorted hashes.
    out = out.withColumn(b, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    nothing = F.lit(None).cast("long")
    gap = lambda x, i: _bin(x) - F.when(i == 0, -1).otherwise(_bin(F.get(b, i - 1))) - 1
    filled = F.flatten(F.transform(b, lambda x, i: F.concat(F.array_repeat(nothing, gap(x, i)), F.array(x))))
    out = out.withColumn(d, F.concat(filled, F.array_repeat(nothing, BINS - F.size(filled))))

    def value(x: Column, i: Column) -> Column:
        tries = [F.get(d, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]
        ranked = F.transform(b, lambda h: F.struct(F.xxhash64(_bin(h), i, F.lit(ATTEMPTS)).alias("r"), h.alias("v")))
        return F.coalesce(x, *tries, F.array_min(ranked)["v"])

    # Hashed with its bin: two hashes that agree in some bits by chance do so in that bin only.
    low = lambda x, i: F.xxhash64(value(x, i), i).bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    digits = F.array_join(F.transform(d, lambda x, i: F.lower(F.hex(low(x, i)))), "")
    return out.withColumn(name, F.when(F.size(b) > 0, digits).otherwise("")).select(*kept, name)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1."""
    same = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    chance = 1 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(estimate)


def _nested(values: list[int], coarse: int) -> tuple[list[int], list[list[int]]]:
    parts = [values[i : i + coarse] for i in range(0, len(values), coarse)]
    return [p[0] for p in parts], parts


def buckets(docs: DataFrame, count: int) -> tuple[Column, list[int]]:
    """A column that numbers ranges of doc_id ascending, by its quantiles; and their bounds."""
    at = [i / count for i in range(1, count)]
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST_ID))
    found = docs.agg(F.percentile_approx(F.col("doc_id"), at, 10_000).alias("q")).first()["q"] if at else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0), bounds
    heads, parts = _nested(bounds, max(1, math.isqrt(len(bounds))))
    under = lambda values: F.size(F.filter(values, lambda x: x <= key))
    i = under(F.lit(heads))
    inside = under(F.element_at(F.lit([[LEAST_ID], *([*p] for p in parts)]), i + 1))
    return F.when(i == 0, 0).otherwise((i - 1) * len(parts[0]) + inside), bounds


def with_next(docs: DataFrame, columns: dict[str, str], add=lambda df: df) -> DataFrame:
    """Adds, for each of ``columns`` (name: new name), its value in the next row by descending doc_id;
    the last row takes the first's.  ``add`` computes columns after rows have been dealt out.

    Rows are dealt by ranges of doc_id once; the first row of each range goes to the range above as well.
    """
    spark = docs.sparkSession
    bucket, _ = buckets(docs, 4 * common.shuffle_width(spark))
    keyed = docs.withColumn("_bucket", bucket)
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST_ID))
    # One row a range, and their number is a setting's.
    heads = sorted((r["_bucket"], r["top"]) for r in keyed.groupBy("_bucket").agg(F.max(key).alias("top")).collect())
    above = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    ghosts = F.broadcast(spark.createDataFrame(above, "_top long, _above int"))
    place = lambda at, ghost: F.struct(F.col(at).alias("b"), F.lit(ghost).alias("ghost"))
    own = F.array(place("_bucket", 0))
    places = F.when(F.col("_above").isNull(), own).otherwise(F.array(place("_bucket", 0), place("_above", 1)))
    both = keyed.join(ghosts, key == F.col("_top"), "left").withColumn("_at", F.explode(places))
    dealt = both.select(*docs.columns, F.col("_at.b").alias("_b"), F.col("_at.ghost").alias("_ghost")).repartition("_b")
    from pyspark.sql import Window

    order = Window.partitionBy("_b").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "text")
    out = add(dealt)
    out = out.withColumns({new: F.lead(F.col(old)).over(order) for old, new in columns.items()})
    return out.filter("_ghost = 0").drop("_b", "_ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, of every row."""
    return add_fingerprint(docs.select("doc_id", common.text_or_empty(docs).alias("text")), "text", "fingerprint").select("doc_id", "fingerprint")


def edited_report(docs: DataFrame) -> DataFrame:
    """Each document against its edited text (its last third replaced from the next document) and the next document."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    out = with_next(rows, {"text": "_next", "fingerprint": "_next_fingerprint"}, lambda df: add_fingerprint(df, "text", "fingerprint"))
    out = out.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    whole, cut = F.col("n_chars").cast("int"), F.col("_cut")
    edited = F.concat(F.col("text").substr(F.lit(1), whole - cut), F.col("_next").substr(F.lit(1), cut))
    out = out.withColumn("_edited", edited).drop("text", "_next").withColumn("edited_sha256", F.sha2("_edited", 256))
    out = add_fingerprint(out, "_edited", "edited_fingerprint")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("_next_fingerprint").alias("near_next"),
    )
