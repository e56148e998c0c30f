"""Generated calendars: months, quarters or years in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError

MONTHS = {"month": 1, "quarter": 3, "year": 12}


def periods(spark: SparkSession, start: str, count: int, grain: str = "month", hist_until: str | None = None) -> DataFrame:
    """id, _ord, name, start, end, frame (hist or fcst), year, quarter, idx; ids like jan26, q1_2026, fy2026."""
    if grain not in MONTHS:
        raise PlanError("BAD_ARG", f"a grain is one of {', '.join(MONTHS)}")
    step = MONTHS[grain]
    first = F.to_date(F.lit(f"{start[:7]}-01"))
    df = spark.range(count).withColumn("start", F.add_months(first, F.col("id").cast("int") * step))
    df = df.withColumn("end", F.last_day(F.add_months("start", step - 1)))
    year, quarter = F.year("end"), F.quarter("end")
    if grain == "month":
        id, name = F.lower(F.date_format("start", "MMMyy")), F.date_format("start", "MMM yyyy")
    elif grain == "quarter":
        id, name = F.format_string("q%d_%d", quarter, year), F.format_string("Q%d %d", quarter, year)
    else:
        id, name = F.format_string("fy%d", year), F.format_string("FY%d", year)
    frame = F.lit("fcst") if hist_until is None else F.when(F.col("end") <= F.to_date(F.lit(hist_until[:10])), "hist").otherwise("fcst")
    return df.select(
        id.alias("id"), F.col("id").alias("_ord"), name.alias("name"), "start", "end", frame.alias("frame"),
        year.cast("double").alias("year"), quarter.cast("double").alias("quarter"), F.col("id").cast("double").alias("idx"),
    )
