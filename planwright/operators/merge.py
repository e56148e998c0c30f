"""Row sets: append, upsert, replace, delete, distinct dimensions, checks, audit columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ORD
from ..errors import PlanError

AUDIT = {"added_by": "text", "added_at": "date", "changed_by": "text", "changed_at": "date"}


def next_order(df: DataFrame) -> int:
    return (df.agg(F.max(ORD)).first()[0] or 0) + 1


def append(df: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rows below; fields not given are blank."""
    new = new.withColumn(ORD, F.lit(next_order(df)) + F.monotonically_increasing_id())
    return df.unionByName(new, allowMissingColumns=True).select(*df.columns)


def clashes(df: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose id is taken."""
    return new.join(df.select("id"), "id", "left_semi")


def duplicates(new: DataFrame) -> DataFrame:
    return new.groupBy("id").count().filter("count > 1").select("id")


def check_new(df: DataFrame, new: DataFrame) -> None:
    for found in (duplicates(new), clashes(df, new)):
        row = found.first()
        if row:
            raise PlanError("LOAD_DUPLICATE_ID", f"id {row['id']!r} is there already")


def unknown_refs(new: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Values of a reference column that no row of the target has."""
    values = new.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    return values.join(known.select(F.col("id").alias("v")), "v", "left_anti")


def upsert(df: DataFrame, new: DataFrame, given: list[str], replace: bool = False) -> DataFrame:
    """Rows of known ids take the given fields, others are added below; with ``replace``, rows not in ``new`` go."""
    row = duplicates(new).first()
    if row:
        raise PlanError("LOAD_DUPLICATE_ID", f"id {row['id']!r} comes twice")
    side = new.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_n_{c}") for c in given), (F.lit(next_order(df)) + F.monotonically_increasing_id()).alias("_new"))
    both = df.join(side, df["id"] == side["_id"], "right" if replace else "full")
    fresh = F.col("_id").isNotNull()
    columns = [F.coalesce("id", "_id").alias("id"), F.coalesce(ORD, "_new").alias(ORD)]
    for c in df.columns:
        if c not in ("id", ORD):
            columns.append((F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)) if c in given else F.col(c)).alias(c))
    return both.select(*columns).select(*df.columns)


def changes(df: DataFrame, new: DataFrame, given: list[str]) -> DataFrame:
    """What an upsert would do: id, inserted, changed."""
    side = new.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_n_{c}") for c in given))
    both = side.join(df, df["id"] == side["_id"], "left")
    differs = F.lit(False)
    for c in given:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    return both.select(F.col("_id").alias("id"), F.col("id").isNull().alias("inserted"), (F.col("id").isNotNull() & differs).alias("changed"))


def null_dangling(df: DataFrame, column: str, target: DataFrame) -> DataFrame:
    """References to rows that are gone become blank."""
    known = target.select(F.col("id").alias("_known")).distinct()
    return df.join(known, df[column] == F.col("_known"), "left").withColumn(column, F.col("_known")).drop("_known").select(*df.columns)


def distinct_dimension(df: DataFrame, column: str) -> DataFrame:
    """A column's values in first-seen order, blanks left out: id, _ord, name."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("id")).agg(F.min(ORD).alias(ORD))
    return seen.select("id", ORD, F.col("id").alias("name"))


def audit(df: DataFrame, who: str, day: dt.date, new: bool) -> DataFrame:
    who_, day_ = F.lit(who), F.lit(day).cast("date")
    if new:
        return df.withColumns({"added_by": who_, "added_at": day_, "changed_by": who_, "changed_at": day_})
    return df.withColumns({"changed_by": who_, "changed_at": day_})


def audit_merge(df: DataFrame, touched: DataFrame, who: str, day: dt.date) -> DataFrame:
    """Stamps the touched rows; those without a first stamp get one."""
    mark = touched.select(F.col("id").alias("_t")).distinct()
    hit = F.col("_t").isNotNull()
    out = df.join(mark, df["id"] == F.col("_t"), "left")
    stamps = {"changed_by": F.lit(who), "changed_at": F.lit(day).cast("date")}
    first = {"added_by": F.coalesce("added_by", F.lit(who)), "added_at": F.coalesce("added_at", F.lit(day).cast("date"))}
    for c, v in {**stamps, **first}.items():
        out = out.withColumn(c, F.when(hit, v).otherwise(F.col(c)))
    return out.drop("_t").select(*df.columns)
