"""Units of the revenues of business segments, found by what makes them add up to the firm's revenue.

A table's line of totals is told by the shares: it has all of it, and so have the others without it. The others' sum is
held against the firm's revenue of the year: a scale of one, a thousand or a million brings it near, or the shares,
where they are whole, give the amounts anew; what neither explains is kept and not trusted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Scales, the bounds of a sum against the firm's revenue, of shares that are whole, of shares that can be trusted, and of a line of totals.
SCALES = (1, 1_000, 1_000_000)
NEAR, WHOLE, SHARES, ALL = (0.75, 1.35), (95.0, 105.0), (85.0, 115.0), (98.0, 102.0)


def total_rows(segments: DataFrame) -> DataFrame:
    """segments (corp, year, name, revenue, ratio) with is_total; a firm's year needs three shares for that."""
    year, own = W.partitionBy("corp", "year"), W.partitionBy("corp", "year", "name")
    rest = F.sum("ratio").over(year) - F.sum("ratio").over(own)
    whole = (F.count("ratio").over(year) >= 3) & F.col("ratio").between(*ALL) & F.round(rest, 6).between(*WHOLE)
    return segments.withColumn("is_total", F.coalesce(whole, F.lit(False)))


def repaired_units(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """segments with is_total, status, revenue in the firm's units, revenue_trusted and ratio_trusted.

    totals (corp, year, revenue) has one row per firm and year. status of a firm's year is no_total (nothing to hold
    against), ok, scaled, rebuilt (from shares) or unknown. Lines of totals keep their figures and are not trusted.
    ratio_trusted is null without shares. The segments of one firm's year are few.
    """
    s = total_rows(segments)
    part = lambda c: F.when(~F.col("is_total"), F.col(c))
    sums = s.groupBy("corp", "year").agg(F.sum(part("revenue")).alias("seg_sum"), F.sum(part("ratio")).alias("shares"))
    sums = sums.join(totals.select("corp", "year", F.col("revenue").alias("total")), ["corp", "year"], "left")
    near = lambda scale: F.col("seg_sum").cast("double") * scale / F.col("total")
    fits = [F.when(near(k).between(*NEAR), F.struct(F.abs(near(k) - 1).alias("off"), F.lit(i).alias("i"), F.lit(k).cast("long").alias("scale"))) for i, k in enumerate(SCALES)]
    scale = F.least(*fits)["scale"]
    comparable = (F.coalesce("total", F.lit(0)) != 0) & (F.coalesce("seg_sum", F.lit(0)) != 0)
    status = F.when(~comparable, "no_total").when(scale == 1, "ok").when(scale > 1, "scaled").when(F.round("shares", 6).between(*WHOLE), "rebuilt").otherwise("unknown")
    sums = sums.select("corp", "year", "total", scale.alias("scale"), status.alias("status"), F.round("shares", 6).between(*SHARES).alias("ratio_trusted"))
    j = s.join(sums, ["corp", "year"])
    of_share = F.round(F.col("total").cast("decimal(24,0)") * F.col("ratio").cast("decimal(10,4)") / 100, 0).cast("long")
    amount = F.when(~F.col("is_total") & (F.col("status") == "scaled"), F.col("revenue") * F.col("scale")).when(~F.col("is_total") & (F.col("status") == "rebuilt") & F.col("ratio").isNotNull(), of_share).otherwise(F.col("revenue"))
    trusted = ~F.col("is_total") & F.col("status").isin("ok", "scaled", "rebuilt")
    return j.select("corp", "year", "name", "is_total", "status", amount.alias("revenue"), "ratio", trusted.alias("revenue_trusted"), "ratio_trusted")
