"""Live monitoring: cell life cycles, retries, timelines, zone events, penalties and log tails as structured streams.

Keyed logic is a fold: a small state per key and a step for each row, in order of event time. Rows
wait in list state until the watermark has passed them, so their order holds across micro-batches
however files or partitions deliver them; rows later than the watermark are dropped. Event-time
timers release them, let things happen while a key is silent, and end the state of keys that stay
silent. Keys share slots by hash; a task holds one slot's rows between two watermarks, which the
source's rate limit bounds. Rows and states lie in the state store in chunks, each an Arrow table
as one value, so reaching the store costs by chunk, not by row.
State lives in Spark's state store (RocksDB), so a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.functions import text
from tessera.operators.lineage import remove
from tessera.operators.plan import upsert
from tessera.sources.readers import log_key, numbered

WATERMARK = "1 minute"
FAILED = ("failed", "drift", "collision")
#: Seconds of event time after which a silent key's state ends, where it ends: a week.
IDLE = 7 * 86400.0


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(chunks: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(c).read_all() for c in chunks)])


def tuples(table: pa.Table) -> Iterator[tuple]:
    """The rows of a table; nulls are None."""
    plain = lambda t: pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_string(t)
    return zip(*[c.to_numpy().tolist() if plain(c.type) and not c.null_count else c.to_pylist() for c in table.columns], strict=True)


class Fold(StatefulProcessor):
    """Keeps one tuple per key; ``step(state, row)`` gives the next state (None drops it) and the rows to emit.

    ``advance(state, upto, whole)`` says what happens by itself before time ``upto`` (micros; with it,
    if ``whole``): the next state, the rows to emit, and when it wants to be asked again. After
    ``idle`` micros without a row the state ends.

    Spark groups by slot, a share of the keys by hash: calls, timers and state are per slot and
    micro-batch, not per key. Waiting rows are a list of chunks; the state of a slot is one table of its keys, each
    with the time of its last row and the time when it wants to be asked again.
    """

    def __init__(self, fields: StructType, key: StructField, state: StructType, columns: list[str], step: Callable, advance: Callable | None = None, idle: int | None = None):
        self.columns, self.step, self.advance, self.idle = columns, step, advance, idle
        self.key, self.names = key.name, fields.names
        self.rows = to_arrow_schema(StructType([key, *fields.fields]))
        self.states = to_arrow_schema(StructType([key, *state.fields, StructField("last_us", LongType()), StructField("wake_us", LongType())]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = namedtuple("Row", self.names)
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.state = handle.getValueState("state", "chunk binary")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, us: int | None, fired: int | None = None) -> None:
        """Have the timer go off once the watermark has reached ``us``; a slot has one timer."""
        set_ = self.due.get()[0] if self.due.exists() else None
        if set_ is not None and set_ != fired:
            self.handle.deleteTimer(set_)
        if us is None:
            self.due.clear()
            return
        ms = -(-us // 1000) - 1  # timers go off when the watermark is past them
        ms = ms if fired is None else max(ms, fired + 1)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            came = pa.Table.from_arrays([pa.Array.from_pandas(chunk[f.name], type=f.type) for f in self.rows], schema=self.rows)
            self.waiting.appendValue((packed(came),))
            least = pc.min(came["us"]).as_py()
            first = least if first is None else min(first, least)
        set_ = self.due.get()[0] if self.due.exists() else None
        if first is not None and (set_ is None or -(-first // 1000) - 1 < set_):
            self._wake(first)
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = unpacked((r[0] for r in self.waiting.get()) if self.waiting.exists() else (), self.rows)
        passed = pc.less_equal(held["us"], now)
        ready, rest = held.filter(passed), held.filter(pc.invert(passed))
        ready = ready.sort_by([(c, "ascending") for c in (self.key, "us", "event_id")])
        kept = {r[0]: r for r in tuples(unpacked(self.state.get(), self.states))} if self.state.exists() else {}
        asking = {k for k, r in kept.items() if r[-1] is not None and r[-1] <= now}
        out: list[tuple] = []

        def go(k, mine: list[tuple]) -> None:
            after = self._pass(k, kept.get(k), mine, now, out)
            if after is None:
                kept.pop(k, None)
            else:
                kept[k] = after

        for k, mine in groupby(tuples(ready), lambda r: r[0]):
            asking.discard(k)
            go(k, [r[1:] for r in mine])
        for k in asking:
            go(k, [])
        if ready.num_rows:
            self.waiting.put([(packed(rest.combine_chunks()),)]) if rest.num_rows else self.waiting.clear()
        if kept:
            whole = [pa.array(c, f.type) for c, f in zip(zip(*kept.values(), strict=True), self.states, strict=True)]
            self.state.update((packed(pa.Table.from_arrays(whole, schema=self.states)),))
        else:
            self.state.clear()
        wishes = [r[-1] for r in kept.values() if r[-1] is not None]
        if rest.num_rows:
            wishes.append(pc.min(rest["us"]).as_py())
        self._wake(min(wishes) if wishes else None, expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame(out, columns=self.columns)

    def _pass(self, key, kept: tuple | None, ready: list[tuple], now: int, out: list[tuple]) -> tuple | None:
        """One key up to ``now``, its ready rows in order: its rows to emit go to ``out``; what is kept of it is returned."""
        seen, last = (kept[1:-2], kept[-2]) if kept else (None, None)

        def ask(upto: int, whole: bool) -> int | None:
            nonlocal seen
            if self.advance is None or seen is None:
                return None
            seen, made, again = self.advance(seen, upto, whole)
            out.extend((key, *r) for r in made)
            return again

        for row in ready:
            ask(row[0], False)
            if self.idle is not None and last is not None and row[0] - last >= self.idle:
                seen = None
            seen, made = self.step(seen, self.row(*row))
            last = row[0]
            out.extend((key, *r) for r in made)
        wishes = [ask(now, True)]
        if seen is not None and self.idle is not None:
            if now - last >= self.idle:
                seen = None
            else:
                wishes.append(last + self.idle)
        if seen is None:
            return None
        return (key, *seen, last, min((w for w in wishes if w is not None), default=None))

    def close(self) -> None:
        pass


#: Keys of a fold are dealt to so many slots, whatever their number.
SLOTS = 256


def fold(stream: DataFrame, key: str, state: str, output: str, step: Callable, advance: Callable | None = None, idle: float | None = None) -> DataFrame:
    """Rows that ``step`` emits over ``stream(key, ts, event_id, ...)``; ``output`` starts with the key. Rows carry ``us``, their ts in micros."""
    others = [c for c in stream.columns if c not in (key, "ts", "event_id")]
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot_")
    timed = stream.withWatermark("ts", WATERMARK).select(slot, key, "ts", F.unix_micros("ts").alias("us"), "event_id", *others).where("ts is not null")
    fields = StructType([f for f in timed.schema.fields if f.name not in (key, "ts", "slot_")])
    columns = [c.split()[0] for c in output.split(", ")]
    processor = Fold(fields, timed.schema[key], StructType.fromDDL(state), columns, step, advance, None if idle is None else int(idle * 1e6))
    return timed.groupBy("slot_").transformWithStateInPandas(processor, output, "Append", "EventTime")


def lifecycle(events: DataFrame, idle: float = IDLE) -> DataFrame:
    """Finished attempts ``(cell_key, attempts, status, duration_s)``: the first start after a finish opens a new attempt.

    A cell without events for ``idle`` seconds starts anew.
    """

    def step(state, row):
        attempts, started = state or (0, None)
        if row.status == "started":
            return (attempts + 1, row.us), []
        if row.status == "merged" or row.status in FAILED:
            return (attempts, None), [(attempts, row.status, round((row.us - started) / 1e6, 2) if started is not None else None)]
        return (attempts, started), []

    return fold(events.select("cell_key", "ts", "event_id", "status"), "cell_key", "attempts int, started long", "cell_key string, attempts int, status string, duration_s double", step, idle=idle)


def retries(failures: DataFrame, most: int = text.MAX_RETRIES, idle: float = IDLE) -> DataFrame:
    """``queued`` events for cells whose failure is transient, up to ``most`` per cell; ``failures(cell_key, ts, event_id, status, reason)``.

    A cell without failures for ``idle`` seconds has its retries again.
    """

    def step(state, row):
        n, reason = (state or (0,))[0], (row.reason or "").lower()
        final = row.status in text.FINAL_STATUS or any(x in reason for x in text.FINAL)
        again = any(x in reason for x in text.TRANSIENT) and not final and n < most
        return ((n + 1,), [(row.us, "queued", n + 1)]) if again else ((n,), [])

    made = fold(failures.select("cell_key", "ts", "event_id", "status", "reason"), "cell_key", "n int", "cell_key string, us long, status string, retry int", step, idle=idle)
    return made.select("cell_key", F.timestamp_micros("us").alias("ts"), "status", "retry")


def ewma(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Running mean after each positive duration: ``(worker, event_id, ewma)``."""

    def step(state, row):
        mean = row.duration_s if state is None else alpha * row.duration_s + (1 - alpha) * state[0]
        return (mean,), [(row.event_id, mean)]

    return fold(events.where("duration_s > 0").select("worker", "ts", "event_id", "duration_s"), "worker", "mean double", "worker int, event_id long, ewma double", step)


def run_end(events: DataFrame, idle: float = IDLE) -> DataFrame:
    """One row when a run's finished cells reach its total: ``(run_id, done, failed)``; ``events`` carry total.

    A run without finished cells for ``idle`` seconds is over; later ones count as a new run.
    """

    def step(state, row):
        done, failed, ended = state or (0, 0, False)
        done, failed = done + (row.status == "merged"), failed + (row.status in FAILED)
        ends = not ended and done + failed >= row.total
        return (done, failed, ended or ends), [(done, failed)] if ends else []

    finished = events.where(F.col("status").isin("merged", *FAILED)).select("run_id", "ts", "event_id", "status", "total")
    return fold(finished, "run_id", "done int, failed int, ended boolean", "run_id long, done int, failed int", step, idle=idle)


def zone_transitions(positions: DataFrame) -> DataFrame:
    """Changes of band per mover: ``(mover, event_id, before, band)``."""

    def step(state, row):
        changed = state is not None and state[0] != row.band
        return (row.band,), [(row.event_id, state[0], row.band)] if changed else []

    return fold(positions.select("mover", "ts", "event_id", "band"), "mover", "band string", "mover long, event_id long, before string, band string", step)


def dwell_penalty(positions: DataFrame, interval: float = 60.0, base: int = 1, doubles: bool = True, most: int = 20) -> DataFrame:
    """Penalties of movers that stay in the hard band, charged as time goes by: ``(mover, at, step, penalty)``.

    ``positions(mover, ts, event_id, band, died)``. The first step is charged on entering, the next
    ones each ``interval`` seconds later, whether the mover is heard of or not; what counts as now is
    the watermark. Leaving the band or dying ends the dwell; the next position in the band starts a
    new one. Steps cost base * 2^(step - 1) (the exponent is held at ``most``) or base * step.
    """
    every = int(interval * 1e6)

    def step(state, row):
        if row.died or row.band != "hard":
            return None, []
        return state or (row.us, 0), []

    def advance(state, upto, whole):
        since, charged = state
        made = []
        while (at := since + charged * every) < upto or whole and at == upto:
            charged += 1
            made.append((at, charged, float(base * (2 ** (min(charged, most) - 1) if doubles else charged))))
        return (since, charged), made, at

    made = fold(positions.select("mover", "ts", "event_id", "band", "died"), "mover", "since long, charged long", "mover long, us long, step long, penalty double", step, advance)
    return made.select("mover", F.timestamp_micros("us").alias("at"), "step", "penalty")


class Follow(StatefulProcessor):
    """The last surfaced line of a log and how many went before, kept for ``ttl`` milliseconds after the log's last line if that is set."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "line string, place long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line, place = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values(["modified", "path", "line_no"]).itertuples(index=False):
            if row.line != line:
                line, place = row.line, place + 1
                out.append((*key, place, line))
        self.state.update((line, place))
        yield pd.DataFrame(out, columns=["cell_key", "place", "line"])

    def close(self) -> None:
        pass


def log_tail(spark: SparkSession, folder: str, ttl: float | None = None, **options) -> DataFrame:
    """Surfaced lines of the cell logs in ``folder``, as they come, without repeats in a row: ``(cell_key, place, line)``.

    A log is a file or folder named ``cell-rx_rz_size.log``; it grows by further files of that name
    (in other folders, or with a suffix), which are read once each, in order of modification. Lines
    are numbered where they are read, and only those that are surfaced go on. Places count from 1 per log. With ``ttl`` the state of a log that has been
    silent for so many seconds ends; that goes by the clock, so such a stream never has nothing to
    do, and needs a trigger other than availableNow. ``options`` go to the file source, such as
    maxFilesPerTrigger.
    """
    source = spark.readStream.options(**{"recursiveFileLookup": "true"} | options).text(folder)
    meta = F.col("_metadata")
    lines = source.select(F.col("value").alias("line"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.unix_micros(meta["file_modification_time"]).alias("modified"))
    shown = lines.mapInArrow(numbered, "line string, path string, start long, modified long, line_no long").where(text.surfaces("line"))
    keyed = shown.withColumn("cell_key", log_key()).where("cell_key <> ''")
    return keyed.groupBy("cell_key").transformWithStateInPandas(Follow(None if ttl is None else int(ttl * 1000)), "cell_key string, place long, line string", "Append", "None" if ttl is None else "ProcessingTime")


def timeline(samples: DataFrame) -> DataFrame:
    """20 s buckets of ``samples(ts, event_id, active, done, failed, cpu, ram)``, each written once when the watermark has passed it; later samples are dropped."""
    last = F.struct("ts", "event_id")
    return (
        samples.withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", "20 seconds").alias("w"))
        .agg(
            F.max("active").alias("active"), F.max_by("done", last).alias("done"), F.max_by("failed", last).alias("failed"),
            F.bround(F.avg("cpu")).cast("long").alias("cpu"), F.bround(F.avg("ram")).cast("long").alias("ram"),
        )
        .select(F.col("w.start").alias("t"), "active", "done", "failed", "cpu", "ram")
    )


BUCKETS = 64


def chunk_upsert(stream: DataFrame, path: str, key: str = "id", version: str = "version"):
    """A writer that keeps the latest row per key: each micro-batch writes anew only the buckets of keys that it changes.

    Folders are ``path/batch=<n>/bucket=<k>``; :func:`latest_chunks` reads the newest of each bucket.
    A micro-batch removes what the ones before it have superseded: those are committed and will not
    be asked for again, so a bucket has two folders at most.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        known = spark.createDataFrame([], batch.schema)
        if batch_id:
            versions = [r for r in bucket_versions(spark, path) if r[1] < batch_id]
            newest = {k: b for k, b in sorted(versions)}
            for k, b in versions:
                if b < newest[k]:
                    remove(spark, f"{path}/batch={b}/bucket={k}")
            changed = batch.select(bucket).distinct()  # at most BUCKETS rows
            known = latest_chunks(spark, path, batch.schema, batch_id).join(F.broadcast(changed), "bucket", "left_semi").select(*columns)
        merged = upsert(known, batch.select(*columns), key, version).select(*columns, bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


def bucket_versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(bucket, micro-batch) of all folders of :func:`chunk_upsert`: two a bucket at most, by listing alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "batch=*/bucket=*"))
    pairs = [(f.getPath().getName(), f.getPath().getParent().getName()) for f in found or []]
    return [(int(k.split("=")[1]), int(b.split("=")[1])) for k, b in pairs]


def latest_chunks(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The table of :func:`chunk_upsert`, with ``bucket``, as of all micro-batches or of those ``before`` one."""
    newest = {k: b for k, b in sorted(bucket_versions(spark, path)) if before is None or b < before}
    whole = StructType([*schema.fields, StructField("bucket", IntegerType())])
    if not newest:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*[f"{path}/batch={b}/bucket={k}" for k, b in sorted(newest.items())]).select(*schema.names, "bucket")
