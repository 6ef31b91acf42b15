import os
from datetime import datetime, timedelta

from trailstat.streaming.episodes import windowed_counts


def test_files_in_any_order_and_events_without_a_time(spark, tmp_path):
    path = tmp_path / "events.parquet"
    path.mkdir()
    first = datetime(2026, 1, 1, 12)
    for k, days in enumerate((60, 30, 0, None)):
        ts = None if days is None else first + timedelta(days=days)
        rows = spark.createDataFrame([(ts, "a", 1.0), (ts, "a", 2.0), (None, "b", 4.0)], "ts timestamp, event_type string, value double")
        rows.coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        (part,) = (tmp_path / f"w{k}").glob("*.parquet")
        part.rename(path / f"{k}.parquet")
        os.utime(path / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    got = {(r["day"] and (r["day"] - first.date()).days, r["event_type"]): (r["n_events"], r["total"]) for r in windowed_counts(spark, str(path), files_per_trigger=1).collect()}
    assert got == {(60, "a"): (2, 3.0), (30, "a"): (2, 3.0), (0, "a"): (2, 3.0), (None, "a"): (2, 3.0), (None, "b"): (4, 16.0)}
