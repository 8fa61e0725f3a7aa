"""Alarms with state against the batch operator on the same rows, and runs that are killed and resumed."""

import random
from datetime import datetime, timedelta

import pytest

from tracewright.operators.assess import VERDICTS
from tracewright.streaming import windows

SCHEMA = "user string, ts timestamp, idx bigint, verdict string, suppressed boolean"
START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def _run(spark, tmp_path, batches):
    """Each batch is a file that the stream takes alone."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "made" / str(n)))
        (source,) = (tmp_path / "made" / str(n)).glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{n:03d}.parquet")
        stream = windows.alarm_sessions(windows.read_events(spark, str(tmp_path / "in"), SCHEMA), ["user"], timedelta(minutes=10), "30 minutes")
        windows.write_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    return sorted(map(tuple, windows.read_once(spark, str(tmp_path / "out"), stream.schema).collect()), key=str)


def test_stream_equals_batch(spark, tmp_path, store):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), START + timedelta(minutes=rng.randrange(600), milliseconds=rng.randrange(1000)), i, rng.choice(VERDICTS), rng.random() < 0.2) for i in range(120)]
    rows += [("a", START + timedelta(minutes=5), 500, "no verdict", False), ("a", None, 501, VERDICTS[0], False)]
    rows.sort(key=lambda r: (r[1] or START) + timedelta(minutes=rng.randrange(25)))  # out of order, but never older than the watermark
    flush = [("zz", START + timedelta(days=2), 999, VERDICTS[0], False)]
    got = _run(spark, tmp_path, [rows[:50], rows[50:90], rows[90:], flush, [("zz", START + timedelta(days=4), 1000, VERDICTS[0], False)]])
    want = windows.alarm_runs(spark.createDataFrame(rows + flush, SCHEMA), ["user"], timedelta(minutes=10)).collect()
    assert got == sorted(map(tuple, want), key=str) and len(got) > 20


def test_late_rows_do_not_count(spark, tmp_path, store):
    at = lambda m: START + timedelta(minutes=m)
    got = _run(spark, tmp_path, [[("a", at(0), 1, VERDICTS[1], False)], [("a", at(300), 2, VERDICTS[2], False)], [("a", at(1), 3, VERDICTS[2], False), ("a", at(280), 4, VERDICTS[0], True)], [("a", at(900), 5, VERDICTS[0], False)]])
    assert [(r[3], r[4]) for r in got] == [("SUFFICIENT_BENIGN", 1), ("INSUFFICIENT_DATA", 4), ("SUFFICIENT_SUSPICIOUS", 2)]


def test_killed_and_resumed(spark, tmp_path):
    """A run dies after it has written a batch and before that is noted, and one dies in the middle of a write: each row is there once."""
    schema = "id bigint"
    for n in range(4):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "made" / str(n)))
        (source,) = (tmp_path / "made" / str(n)).glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{n}.parquet")
    out, check, seen = str(tmp_path / "out"), str(tmp_path / "c"), []

    def dies(df):
        seen.append(1)
        if len(seen) == 3:
            df.write.parquet(f"{out}/_part-2")  # half of a write
            raise RuntimeError("killed")
        return df

    with pytest.raises(Exception, match="killed"):
        windows.write_once(windows.read_events(spark, str(tmp_path / "in"), schema), out, check, dies)
    assert sorted(r.id for r in windows.read_once(spark, out, schema).collect()) == list(range(20))
    (commit,) = (tmp_path / "c" / "commits").glob("1")
    for f in (commit, tmp_path / "c" / "commits" / ".1.crc"):
        f.unlink(missing_ok=True)  # the second batch was written, but not noted
    windows.write_once(windows.read_events(spark, str(tmp_path / "in"), schema), out, check)
    assert sorted(r.id for r in windows.read_once(spark, out, schema).collect()) == list(range(40))
