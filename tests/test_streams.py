"""Streams over a table of many files in shuffled time order, where later batches hold rows of earlier hours."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodegraph.plans import catalogue


@pytest.mark.parametrize(("name", "shifts"), [("stream_tumbling", (0,)), ("stream_sliding", (0, 6))])
def test_no_row_is_dropped_as_late(spark, tmp_path, name, shifts):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    first = datetime(2024, 1, 1)
    rows = [(i, i % 3, ("view", "click")[i % 2], first + timedelta(hours=i)) for i in range(600)]
    files = [rows[at : at + 25] for at in range(0, 600, 25)]
    for n, at in enumerate(sorted(range(24), key=lambda x: -(x * 7 % 24))):  # the newest file is in the first batch
        ids, users, types, times = zip(*files[at], strict=True)
        table = pa.table({"event_id": pa.array(ids, pa.int64()), "user_id": pa.array(users, pa.int64()), "event_type": types, "ts": pa.array(times, pa.timestamp("us"))})
        pq.write_table(table, folder / f"part-{n:05d}.parquet")
    want = Counter()
    for _, _, kind, ts in rows:
        start = ts.replace(hour=ts.hour // 6 * 6)
        for shift in shifts:
            want[start - timedelta(hours=shift), kind] += 1
    got = catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.start, r.event_type): r.n for r in got} == want
