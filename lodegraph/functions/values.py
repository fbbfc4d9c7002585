"""Column functions on dates, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_missing


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once a row: neither later columns nor filters that are moved down repeat it."""
    return df.select(*[k for k in df.columns if k != name], F.explode(F.array(c)).alias(name))


def dotted_date(c: Column) -> Column:
    """1977.01.01 as an ISO date; null in any other form."""
    t = clean_missing(c)
    return F.when(t.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.replace(t, F.lit("."), F.lit("-")))


def korean_date(c: Column) -> Column:
    """2028년 3월 18일, or 1960년 12월, as an ISO date or month; null in any other form."""
    t = clean_missing(c)
    part = lambda i: F.regexp_extract(t, r"^(\d{4})년\s*(\d{1,2})월(?:\s*(\d{1,2})일)?$", i)
    month = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"))
    return F.when(part(1) != "", F.when(part(3) != "", F.concat_ws("-", month, F.lpad(part(3), 2, "0"))).otherwise(month))


def compact_date(c: Column) -> Column:
    """20280318 as an ISO date; null for zero and for what lies before 1901."""
    n = F.try_to_number(c.cast("string"), F.lit("99999999"))
    s = c.cast("string")
    return F.when(n > 19000000, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))


def tenure_months(c: Column) -> Column:
    return F.expr("try_cast(null as int)") if c is None else F.nullif(F.regexp_extract(clean_missing(c), r"(\d+)\s*개월", 1), F.lit("")).cast("int")


def number(c: Column, kind: str = "double") -> Column:
    """A number with thousands commas; null for a dash and for anything else."""
    return F.replace(clean_missing(c), F.lit(","), F.lit("")).try_cast(kind)


def month_number(c: Column) -> Column:
    """Months since year 0 of an ISO date's or month's text; null if it has none."""
    y, m = F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 2).try_cast("int")
    return y * 12 + m


def months_apart(a: Column, b: Column) -> Column:
    """Far apart, 99, where either is missing."""
    return F.coalesce(F.abs(month_number(a) - month_number(b)), F.lit(99))


def ratio(top: Column, bottom: Column, digits: int = 2) -> Column:
    """Rounded decimal quotient; null unless the denominator is positive."""
    d = lambda c: c.cast("decimal(28,6)")
    return F.when(bottom > 0, F.round(d(top) / d(bottom), digits).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance_to_similarity(d: Column) -> Column:
    """A squared distance of unit vectors as a similarity between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 - d / 2) / 2))


def bucket(similarity: Column, width: float = 0.05) -> Column:
    """The number of the nearest bucket, halves to the even one."""
    return F.bround(similarity / width).cast("int")


def plausible(value: Column, types: Column, low: float, high: float) -> Column:
    """A value only where its edge type may carry it and it lies in (low, high]."""
    return F.when(types & (value > low) & (value <= high), value)


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """A name from the hash of parts; nulls count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, length))


def ordered_union(*arrays: Column) -> Column:
    """Distinct elements in order of first sight, nulls left out."""
    return F.array_distinct(F.array_compact(F.concat(*arrays)))


def percent_of(top: Column, bottom: Column) -> Column:
    """Of a statement's figures: percent to two digits; null where either is missing or the denominator is zero."""
    d = lambda c: c.cast("decimal(28,6)")
    return F.when(top.isNotNull() & (bottom != 0), F.round(d(top) * 100 / d(bottom), 2).cast("double"))


def ratio_in_percent(value: Column, text: Column) -> Column:
    """A share given as a fraction becomes percent if the text shows a hundred times it and not itself; else it stays."""
    shown = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), 1), lambda p: p.cast("double"))
    near = lambda v: F.exists(shown, lambda p: F.abs(p - v) < 0.01)
    return F.when(near(value), value).when(near(value * 100), F.round((value * 100).cast("decimal(28,10)"), 4).cast("double")).otherwise(value)


def news_event_id(name_key: Column, occurred_at: Column) -> Column:
    """One event under one name and month, whichever articles tell of it."""
    return F.concat(F.lit("evt_news_"), F.substring(F.sha1(F.concat(name_key, F.lit("|"), F.substring(F.coalesce(occurred_at, F.lit("")), 1, 7)).cast("binary")), 1, 12))


def timeline_entry(c: Column) -> Column:
    """period|name|id as a struct; a shorter entry leaves nulls."""
    part = lambda i: F.get(F.split(c, r"\|"), i)
    return F.struct(part(0).alias("period"), part(1).alias("name"), part(2).alias("id"))
