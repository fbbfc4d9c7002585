"""Firms by common members, and persons of one name that are one, over all events as posts."""

from __future__ import annotations

from ..operators import people
from ..sources import scratch
from .record_queries import Rows
from .registry import query

ROSTERS = Rows("events", ("user_id % 400 AS company", "event_id * 7919 % 1009 AS member"))
PERSONS = Rows("events", ("event_id AS key", "'name' || CAST(event_id * 31 % 97 AS STRING) AS name", "CASE event_id % 5 WHEN 0 THEN '1960-01' WHEN 1 THEN '1971-07' END AS birth", "event_id % 41 = 0 AS self_owner", "user_id % 400 AS company"))


@query(f"WITH r AS (SELECT DISTINCT * FROM {ROSTERS.sql}) SELECT x.company AS a, y.company AS b, CAST(count(*) AS INT) AS n FROM r x JOIN r y ON x.member = y.member AND x.company < y.company GROUP BY ALL HAVING count(*) >= 2", with_graph=False)
def roster_pairs(spark, d):
    return people.roster_pairs(ROSTERS.df(spark, d), 2, scratch.written)


@query(None, with_graph=False)
def person_merge(spark, d):
    p = PERSONS.df(spark, d)
    return people.merge_persons(p.drop("company"), p.select("key", "company"), ROSTERS.df(spark, d), scratch.written, overlap=2)
