"""Streams of events: rules by window, correlation by session and alarms by state. They give what the batch operators give on the same rows."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.operators.assess import HARDNESS, VERDICTS, combine_alarm


def read_events(spark, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rule_counts(events: DataFrame, by: list[str], least: int, window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(start, by, n): windows in which a key has at least least events; rows later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), *by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, by: list[str], gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(start, by, n): runs of events of a key without a gap longer than gap, of two events or more."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n")).where("n >= 2").select(F.col("session_window.start").alias("start"), *by, "n")


def alarms(decisions: DataFrame, by: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, verdict, counts): the hardest verdict of a key's events in each window; of equals the first's event."""
    hard = F.create_map(*[F.lit(x) for kv in HARDNESS.items() for x in kv])[F.col("verdict")]
    best = F.max(F.struct(hard.alias("h"), (-F.col("idx")).alias("o"), "verdict", "idx")).alias("b")
    g = decisions.withWatermark("ts", late).groupBy(F.window("ts", window), *by).agg(best, *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS])
    return g.select(F.col("window.start").alias("start"), *by, F.col("b.verdict").alias("verdict"), F.col("b.idx").alias("by_event"), *[v.lower() for v in VERDICTS])


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into a table in memory; for tests and back-fills."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _alarm_processor(by: list[str], gap_ms: int):
    """The state of a key's open alarms. Made in a function, so that what it needs is sent along."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    order = {v: h for v, h in HARDNESS.items()}

    class Alarms(StatefulProcessor):
        """Open alarms of a key, in a list; each is an array of numbers: first and last time, hardness, event, counts by verdict, suppressed events."""

        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", "first bigint, last bigint, hard int, event bigint, c0 bigint, c1 bigint, c2 bigint, n_suppressed bigint")

        def _settle(self, alarms: list[list[int]]) -> list[list[int]]:
            """Alarms that touch become one: the hardest event's, of equals the first's."""
            out: list[list[int]] = []
            for a in sorted(alarms):
                if out and a[0] <= out[-1][1] + gap_ms:
                    b = out[-1]
                    best = max((b[2], -b[3]), (a[2], -a[3]))
                    out[-1] = [b[0], max(a[1], b[1]), best[0], -best[1], *[x + y for x, y in zip(a[4:], b[4:], strict=True)]]
                else:
                    out.append(a)
            return out

        def _keep(self, alarms: list[list[int]]) -> None:
            self.open.put([tuple(a) for a in alarms]) if alarms else self.open.clear()
            wanted = {a[1] + gap_ms + 1 for a in alarms}
            for t in list(self.handle.listTimers()):
                if t not in wanted:
                    self.handle.deleteTimer(t)
            for t in wanted:
                self.handle.registerTimer(t)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            alarms = [[int(x) for x in a] for a in self.open.get()] if self.open.exists() else []
            for df in rows:
                for ms, idx, verdict, suppressed in zip(df["at_ms"], df["idx"], df["verdict"], df["suppressed"], strict=True):
                    alarms.append([int(ms), int(ms), order[verdict], int(idx), *[int(verdict == v) for v in VERDICTS], int(bool(suppressed))])
                alarms = self._settle(alarms)
            self._keep(alarms)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            now = expiredTimerInfo.getExpiryTimeInMs()
            alarms = [[int(x) for x in a] for a in self.open.get()] if self.open.exists() else []
            closed = [a for a in alarms if a[1] + gap_ms < now]
            self._keep([a for a in alarms if a[1] + gap_ms >= now])
            hardest = {h: v for v, h in order.items()}
            for a in closed:
                yield pd.DataFrame([[*key, pd.Timestamp(a[0], unit="ms", tz="UTC"), pd.Timestamp(a[1], unit="ms", tz="UTC"), hardest[a[2]], *a[3:]]], columns=names)

        def close(self) -> None:
            pass

    names = [*by, "first", "last", "verdict", "by_event", *[v.lower() for v in VERDICTS], "n_suppressed"]
    return Alarms()


def alarm_sessions(decisions: DataFrame, by: list[str], gap: timedelta = timedelta(hours=1), late: str = "1 hour") -> DataFrame:
    """(by, first, last, verdict, by_event, counts, n_suppressed): an alarm a run of a key's decisions(by, ts, idx, verdict, suppressed) with gaps up to gap, once event time has passed its end by more than that.

    A timer of event time closes an alarm; until then rows in any order join it, and runs that a row connects become one. Rows older than the watermark are late and don't count.
    Rows without time or with an unknown verdict are left out; times count by the millisecond. Sessions need the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    gap_ms = int(gap / timedelta(milliseconds=1))
    told = decisions.withWatermark("ts", late).where(F.col("ts").isNotNull() & F.col("verdict").isin(VERDICTS)).select(*by, "ts", F.unix_millis("ts").alias("at_ms"), "idx", "verdict", "suppressed")
    kinds = ", ".join(f"`{c}` {decisions.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, first timestamp, last timestamp, verdict string, by_event bigint, {', '.join(f'{v.lower()} bigint' for v in VERDICTS)}, n_suppressed bigint"
    return told.groupBy(*by).transformWithStateInPandas(statefulProcessor=_alarm_processor(by, gap_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def alarm_runs(decisions: DataFrame, by: list[str], gap: timedelta = timedelta(hours=1)) -> DataFrame:
    """What alarm_sessions gives for all rows of a table, all alarms closed: runs by the gaps between neighbours, combined by assess.combine_alarm."""
    seconds = gap.total_seconds()
    d = decisions.where(F.col("ts").isNotNull() & F.col("verdict").isin(VERDICTS)).withColumn("_ms", F.unix_millis("ts"))
    w = Window.partitionBy(*by).orderBy("_ms", "idx")
    new = F.coalesce(F.col("_ms") - F.lag("_ms").over(w) > seconds * 1000, F.lit(True)).cast("int")
    runs = d.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = runs.groupBy(*by, "_run").agg(F.timestamp_millis(F.min("_ms")).alias("first"), F.timestamp_millis(F.max("_ms")).alias("last"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    verdicts = combine_alarm(runs, [*by, "_run"]).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_run").alias("_r"), "verdict", "by_event", *[v.lower() for v in VERDICTS], "n_suppressed")
    return span.join(verdicts, reduce(lambda a, b: a & b, same, F.col("_run") == F.col("_r"))).select(*by, "first", "last", "verdict", "by_event", *[v.lower() for v in VERDICTS], "n_suppressed")


def write_once(stream: DataFrame, path: str, checkpoint: str, make=None) -> None:
    """A run that can be killed and resumed: what is there now goes through make(batch) into a table at path, each row once.

    Every batch is a folder named by its number and appears whole, by a rename, after its rows are written. A batch that is run again, since its end wasn't noted in checkpoint, finds its folder or
    replaces its own unfinished one, so nothing is doubled or lost. Read the result with read_once.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        done, part = of(f"batch={number}"), of(f"_part-{number}")
        files = done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if files.exists(done):
            return
        (make(batch) if make else batch).write.mode("overwrite").parquet(part.toString())
        if not files.rename(part, done):
            raise OSError(f"{part} can't become {done}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_once(spark, path: str, schema) -> DataFrame:
    """The rows of all batches that write_once has finished; their folders' numbers are no column."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{path}/batch=*")
