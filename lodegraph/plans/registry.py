"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import graph

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: The day on which the graph is looked at; order dates end in 2001 and events in January 2024.
TODAY, EVENT_DAY = "2001-06-01", "2024-01-31"
#: The companies of the workspace in the queries.
WORKSPACE = ("S1", "S2", "S3", "S5", "C1", "C4", "C7", "C10")


def query(sql: str | None = None, with_graph: bool = True):
    """Registers a function (spark, sf_dir) under its own name; sql follows the graph's tables in a WITH clause."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.replace(":today", f"'{TODAY}'").replace(":event_day", f"'{EVENT_DAY}'").replace(":ws", str(WORKSPACE))
            ORACLES[f.__name__] = f"WITH {graph.SQL.strip()}\n{', ' + body if body.lstrip().startswith('/*+with*/') else body}" if with_graph else body
        return f

    return put
