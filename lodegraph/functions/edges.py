"""Column functions on edges: freshness, verdict, score, visibility. All stay in generated code; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def iso_date(column: Column) -> Column:
    """The date of a string's first ten characters; null where they are none."""
    text = F.substring(column, 1, 10)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def assess(today: str) -> dict[str, Column]:
    """status, days_since and factor from is_current, valid_until, last_seen and refresh_cycle_days.

    In this order: ended, run out (the last day still counts), never seen, without cycle, within the grace, stale.
    """
    now = F.lit(today).cast("date")
    until, seen, cycle = iso_date(F.col("valid_until")), iso_date(F.col("last_seen")), F.col("refresh_cycle_days")
    ended, out = ~F.coalesce("is_current", F.lit(True)), F.coalesce(until < now, F.lit(False))
    days = F.datediff(now, seen)
    free = F.coalesce(cycle, F.lit(0)) == 0
    late = days > cycle * S.GRACE
    case = lambda a, b, c, d, e, f: F.when(ended, a).when(out, b).when(seen.isNull(), c).when(free, d).when(late, f).otherwise(e)
    lit = F.lit
    return {
        "status": case(lit("expired"), lit("expired"), lit("unknown"), lit("current"), lit("current"), lit("stale")),
        "reason": case(lit("ended"), lit("run_out"), lit("never_seen"), lit("no_cycle"), lit("in_cycle"), lit("overdue")),
        "days_since": F.when(ended, lit(None).cast("int")).when(out, F.datediff(now, until)).otherwise(days),
        "factor": case(lit(S.EXPIRED), lit(S.EXPIRED), lit(S.UNKNOWN), lit(1.0), lit(1.0), lit(S.STALE)),
    }


def or_default(column: str, default: float) -> Column:
    """Null and zero both count as not given."""
    c = F.col(column)
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def verdict() -> Column:
    return F.when(~F.coalesce("suspect", F.lit(False)), "supported").otherwise(F.coalesce(F.when(F.col("stage1") != "", F.col("stage1")), F.lit("unfounded")))


def effective_confidence() -> Column:
    """Here only null counts as not given, and as 1."""
    return three(F.coalesce("confidence", F.lit(1.0)) * F.col("factor"))


def score() -> Column:
    """confidence * freshness * support * verdict, of an edge that has factor and verdict."""
    more = F.least(F.greatest(or_default("corroboration", 1) - 1, F.lit(0)), F.lit(4)) * 0.05 + 1.0
    return or_default("confidence", S.DEFAULT_CONFIDENCE) * F.col("factor") * more * F.when(F.col("verdict") == "wrong_type", S.WRONG_TYPE_PENALTY).otherwise(1.0)


def three(value: Column, digits: int = 3) -> Column:
    """Rounded through a decimal, so that equal numbers round alike on every engine."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def live(today: str) -> Column:
    """Not suspect, not ended, not run out."""
    return ~F.coalesce("suspect", F.lit(False)) & F.coalesce("is_current", F.lit(True)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= today))


def visible_to_propagation() -> Column:
    return ~F.coalesce("suspect", F.lit(False)) | F.coalesce(F.col("stage1") == "wrong_type", F.lit(False))


def category(edge_type: str = "type") -> Column:
    """The category of an edge type."""
    pairs = [F.lit(x) for e, c, *_ in S.EDGE_MATRIX for x in (e, c)]
    return F.element_at(F.create_map(*pairs), F.col(edge_type))


def hub_penalty(degree: Column) -> Column:
    return F.lit(S.HUB_HALF) / (F.lit(S.HUB_HALF) + F.greatest(degree - 1, F.lit(0)))
