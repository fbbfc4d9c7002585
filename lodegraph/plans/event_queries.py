"""Events merged under several names, over all events. Taking pairs in order has no SQL; the test is by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_merge
from ..sources import scratch
from .record_queries import Rows
from .registry import query

NAMED = Rows(
    "events",
    (
        "CAST(event_id AS STRING) AS event_id", "'회사' || CAST(user_id % 199 AS STRING) AS company", "CASE WHEN event_id % 4 = 0 THEN '회사' || CAST(user_id % 61 AS STRING) END AS other", "event_id % 3 AS role", "CAST(2020 + event_id * 7 % 5 AS STRING) || '-' || CAST(10 + event_id * 11 % 3 AS STRING) || '-01' AS day",
        "CASE event_id * 5 % 9 WHEN 0 THEN '청주' WHEN 1 THEN '이천' WHEN 2 THEN '평택' WHEN 3 THEN '테일러' WHEN 4 THEN '세종' WHEN 5 THEN '아산' WHEN 6 THEN '구미' WHEN 7 THEN '회사' || CAST(user_id % 199 AS STRING) ELSE 'HBM4용' END || ' ' || CASE event_id * 3 % 7 WHEN 0 THEN '캠퍼스' WHEN 1 THEN '공장' WHEN 2 THEN '신사옥' WHEN 3 THEN '노조' WHEN 4 THEN '장비' WHEN 5 THEN '생산라인' ELSE 'HBM4' END || ' ' || CASE event_id * 13 % 8 WHEN 0 THEN '화재' WHEN 1 THEN '총파업 결의' WHEN 2 THEN '착공' WHEN 3 THEN '준공 지연' WHEN 4 THEN '공급계약' WHEN 5 THEN '리콜' WHEN 6 THEN '투자 확대' ELSE '압수수색' END AS name",
    ),
)


def named_events(spark, d):
    e = NAMED.df(spark, d)
    subjects = F.when(F.col("role") == 0, F.array("company")).when(F.col("role") == 1, F.array(F.coalesce("other", "company"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", "name", F.array_compact(F.array("company", "other")).alias("companies"), subjects.alias("subjects"), F.array("day").alias("dates"), (F.col("role") + 1).cast("long").alias("degree"))


@query(None, with_graph=False)
def event_merge_groups(spark, d):
    return event_merge.merge(named_events(spark, d), scratch.written)


@query(None, with_graph=False)
def event_merge_timelines(spark, d):
    events = named_events(spark, d)
    lines = event_merge.timelines(events, event_merge.merge(events, scratch.written))
    return lines.select("grp", "keeper", F.array_join(F.transform("timeline", lambda t: F.concat_ws("|", t["at"], t["label"], t["event_id"])), ";").alias("timeline"))
