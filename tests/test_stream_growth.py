"""Streams whose lots have many files and whose keys are worked out by the block."""

import glob
from types import SimpleNamespace

import duckdb
import pandas as pd
from conftest import SF
from pyspark.sql import functions as F

from factloom import queries_documents
from factloom.streaming import stateful


def test_a_call_works_out_a_block_of_keys():
    """One call of Python for each key and batch: at 6 GB stream_state would have taken more than its limit."""
    state = []
    held = SimpleNamespace(get=lambda: iter(list(state)), exists=lambda: False, put=lambda rows: state.__setitem__(slice(None), rows), update=lambda row: None)
    own = stateful.Rolling()
    own.init(SimpleNamespace(getListState=lambda name, schema: held, getValueState=lambda name, schema: held))
    frame = lambda *rows: pd.DataFrame(rows, columns=["user_id", "at", "event_id", "event_type", "cents"])
    call = lambda *frames: sorted(tuple(r) for f in own.handleInputRows((0,), iter(frames), None) for r in f.itertuples(index=False))
    assert call(frame((1, 50, 7, "a", 10), (2, 30, 8, "b", 20)), frame((1, 50, 9, "c", 1), (1, 40, 10, "d", 2))) == [(1, 3, 13, 50, 9, "c", 0), (2, 1, 20, 30, 8, "b", 0)]
    assert call(frame((1, 49, 11, "e", 5), (3, 1, 12, "f", 6)), frame((1, 60, 13, "g", 5), (1, 50, 14, "h", 5))) == [(1, 6, 28, 60, 13, "g", 1), (3, 1, 6, 1, 12, "f", 0)]
    assert call(frame((2, 29, 15, "i", 1))) == [(2, 2, 21, 30, 8, "b", 1)]  # held through a batch without rows of its own


def test_rows_without_a_key_or_a_time(spark, tmp_path):
    """A row without a user ended the run; the SQL leaves such rows out."""
    rows = [(0, 100, 5, "x", 1.0), (1, None, 5, "y", 2.0), (2, 90, None, "z", 4.0), (3, 200, 300, "x", 8.0), (4, 300, -1, "w", 16.0)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stateful.rolling(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "state"), str(tmp_path / "out"))
    got = {r.user_id: (r.n, r.cents, r.last_at, r.last_id, r.n_late) for r in stateful.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {5: (2, 300, 100_000_000, 0, 0), 300: (1, 800, 200_000_000, 3, 0), -1: (1, 1600, 300_000_000, 4, 0)}


def test_lots_of_many_files(spark, monkeypatch, tmp_path):
    """Every lot was written by one task, into one file."""
    seen, rolling = [], stateful.rolling

    def watched(spark, source, schema, checkpoint, out, files=1):
        rolling(spark, source, schema, checkpoint, out, files)
        seen.append((files, len(glob.glob(f"{source.removeprefix('file://')}/*.parquet")), len(glob.glob(f"{out.removeprefix('file://')}/batch=*"))))

    monkeypatch.setattr(queries_documents, "_LOT_ROWS", 100, raising=False)
    monkeypatch.setattr(stateful, "rolling", watched)
    got = sorted(map(tuple, queries_documents.stream_state(spark, SF).collect()))
    files = seen[0][0]
    assert files > 1 and seen == [(files, 2 * files, 2), (files, 3 * files, 3)]  # a batch takes one lot
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    assert got == sorted(con.sql(queries_documents.SQL["stream_state"]).fetchall())
