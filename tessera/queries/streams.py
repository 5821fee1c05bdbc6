"""Queries that run a structured stream over the events table to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder
from tessera.streaming import monitor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAILS = "status IN ('merged', 'failed')"
STATUSES = ("queued", "started", "merged", "failed")
#: Seconds after which the state of a silent key ends.
PAUSE = 21600.0
LINES = ("ERROR: out of memory", "ok", "still missing", "fetching tile x=1")


def shaped(e: DataFrame) -> DataFrame:
    """The events table as what each monitor reads."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    n, user = F.col("event_id"), F.col("user_id")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", user.alias("mover"), F.when(n % 17 == 0, "soft").otherwise("hard").alias("band"), (n % 23 == 0).alias("died"),
        pick(STATUSES, n * 7 + user).alias("status"), (user % 90).cast("string").alias("cell_key"), (user % 8).cast("int").alias("worker"),
        F.col("value").alias("duration_s"), (user % 20).alias("run_id"), F.lit(25).alias("total"), (user % 40).alias("cell_id"),
        F.when(n % 3 == 0, "network timeout").otherwise("disk full").alias("reason"), pick(LINES, user + n % 2).alias("line"),
        (n % 9).alias("active"), (n * 2).alias("done"), (n % 5).alias("failed"), (user % 101).cast("double").alias("cpu"), (user % 64).cast("double").alias("ram"),
    )


#: Rows of a delivered file, about; a delivery has four files at least.
FILE_ROWS = 1_000_000


def _deliveries(events: DataFrame) -> list[DataFrame]:
    """The events in two deliveries: those of the first half of their time, then the rest, with a few of the first quarter that come too late."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last, rows = events.agg(F.min(us), F.max(us), F.count("*")).first()
    first, last = first or 0, last or 0
    early = (us < first + (last - first) // 2) & ~((F.col("event_id") % 50 == 0) & (us < first + (last - first) // 4))
    return [events.where(some).repartition(max(4, -(-rows // 2 // FILE_ROWS)), F.xxhash64("event_id")) for some in (early, ~early)]


def _folder(spark: SparkSession) -> str:
    """A new folder for one stream's input, state and output; state goes to RocksDB, which keyed logic needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _ended(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Run ``build(stream)`` to the end of each delivery, with its rows in any order, going on from the checkpoint; what it has written as a table."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for some in _deliveries(events):
        some.write.mode("append").parquet(f"{folder}/in")
        stream = build(shaped(spark.readStream.schema(events.schema).parquet(f"{folder}/in")))
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_lifecycle(spark, d):
    return _ended(spark, d, lambda s: monitor.lifecycle(s, PAUSE))


def stream_timeline(spark, d):
    return _ended(spark, d, monitor.timeline).withColumn("t", F.unix_seconds("t"))


def stream_retries(spark, d):
    out = _ended(spark, d, lambda s: monitor.retries(s.where("status = 'failed'"), idle=PAUSE))
    return out.select("cell_key", "retry", F.unix_micros("ts").alias("ts_us"))


def stream_ewma(spark, d):
    return _ended(spark, d, monitor.ewma).select("worker", "event_id", F.round("ewma", 6).alias("ewma"))


def stream_run_end(spark, d):
    return _ended(spark, d, lambda s: monitor.run_end(s, PAUSE))


def stream_transitions(spark, d):
    return _ended(spark, d, monitor.zone_transitions)


def stream_dwell_penalty(spark, d):
    """Charged by timers up to the last watermark, also to movers that are not heard of any more."""
    return _ended(spark, d, lambda s: monitor.dwell_penalty(s, 43200.0)).select("mover", F.unix_micros("at").alias("at_us"), "step", "penalty")


def stream_log_tail(spark, d):
    """The events' lines as log files that grow between two runs, followed from file to file."""
    folder = _folder(spark)
    lines = shaped(spark.read.parquet(f"{d}/events.parquet")).withColumn("log", F.concat(F.lit("cell-"), "cell_id", F.lit("_0_4.log")))
    first = lines.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0] or 0
    early = F.unix_micros("ts") < first
    for some in (lines.where(early), lines.where(~early)):
        some.repartition("log").sortWithinPartitions("log", "ts", "event_id").select("line", "log").write.mode("append").partitionBy("log").text(f"{folder}/logs")
        writer = monitor.log_tail(spark, f"{folder}/logs").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("cell_key", "place", "line")


def stream_upsert(spark, d):
    """Latest status per cell, kept by batches of the stream."""
    folder = _folder(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    changes = shaped(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")).select(F.col("cell_key").alias("id"), F.col("event_id").alias("version"), "status")
    query = monitor.chunk_upsert(changes, f"{folder}/table").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    return monitor.latest_chunks(spark, f"{folder}/table", changes.schema).select("id", "version", "status")


QUERIES = {
    f.__name__: f
    for f in (
        stream_lifecycle, stream_timeline, stream_retries, stream_ewma, stream_run_end, stream_transitions, stream_dwell_penalty,
        stream_log_tail, stream_upsert,
    )
}


def _pick(values, by):
    return f"list_extract([{', '.join(f"'{v}'" for v in values)}], CAST(({by}) % {len(values)} AS INT) + 1)"


_ALL = f"""(SELECT ts, epoch_us(ts) AS us, event_id, user_id AS mover, CASE WHEN event_id % 17 = 0 THEN 'soft' ELSE 'hard' END AS band, event_id % 23 = 0 AS died, {_pick(STATUSES, 'event_id * 7 + user_id')} AS status,
 CAST(user_id % 90 AS VARCHAR) AS cell_key, CAST(user_id % 8 AS INT) AS worker, value AS duration_s, user_id % 20 AS run_id, user_id % 40 AS cell_id, event_id % 3 AS third,
 {_pick(LINES, 'user_id + event_id % 2')} AS line FROM events)"""
_IN_TIME = "NOT (event_id % 50 = 0 AND epoch_us(ts) < (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 FROM events))"
_NOW = "(SELECT (max(epoch_us(ts)) // 1000 - 60000) * 1000 FROM events)"  # the last watermark
_E = f"(SELECT * FROM {_ALL} a WHERE {_IN_TIME} AND us <= {_NOW})"


def _sessions(key, where):
    """Rows with ``turn``, which rises where the key was silent for PAUSE."""
    return f"(SELECT *, sum(paused) OVER (PARTITION BY {key} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT *, CAST(coalesce(us - lag(us) OVER (PARTITION BY {key} ORDER BY us, event_id) >= {int(PAUSE * 1e6)}, FALSE) AS INT) AS paused FROM {_E} e WHERE {where}) p)"


_ISLAND = f"(SELECT *, count(*) FILTER ({FAILS}) OVER (PARTITION BY cell_key, turn ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM {_sessions('cell_key', 'TRUE')} s)"
_OVER = "OVER (PARTITION BY mover ORDER BY us, event_id"


def dwells(rows, every, now):
    """Charges over ``rows(mover, us, event_id, band, died)`` in SQL."""
    return f"""SELECT mover, since + (k - 1) * {every} AS at_us, k AS step, pow(2.0, least(k, 20) - 1) AS penalty FROM (
 SELECT mover, since, unnest(range(1, CASE WHEN until IS NULL THEN ({now} - since) // {every} + 1 ELSE (until - since + {every} - 1) // {every} END + 1)) AS k FROM (
 SELECT mover, island, min(us) FILTER (NOT ends) AS since, lead(min(us) FILTER (ends)) OVER (PARTITION BY mover ORDER BY island) AS until FROM (
 SELECT *, count(*) FILTER (ends) OVER (PARTITION BY mover ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, died OR band <> 'hard' AS ends FROM {rows} r) e) i
 GROUP BY mover, island) d WHERE since IS NOT NULL) c"""


SQL = {
    "stream_lifecycle": f"SELECT cell_key, attempts, status, round((us - last) / 1e6, 2) AS duration_s FROM (SELECT *, CAST(count(*) FILTER (status = 'started') OVER (PARTITION BY cell_key, turn ORDER BY us, event_id) AS INT) AS attempts, max(us) FILTER (status = 'started') OVER (PARTITION BY cell_key, turn, island ORDER BY us, event_id) AS last FROM {_ISLAND} i) t WHERE {FAILS}",
    "stream_timeline": f"SELECT * FROM (SELECT CAST(floor(epoch(ts) / 20) AS BIGINT) * 20 AS t, max(event_id % 9) AS active, arg_max(event_id * 2, (ts, event_id)) AS done, arg_max(event_id % 5, (ts, event_id)) AS failed, CAST(round_even(avg(user_id % 101), 0) AS BIGINT) AS cpu, CAST(round_even(avg(user_id % 64), 0) AS BIGINT) AS ram FROM events WHERE {_IN_TIME} GROUP BY 1) b WHERE (t + 20) * 1000000 <= {_NOW}",
    "stream_retries": f"SELECT cell_key, CAST(retry AS INT) AS retry, us AS ts_us FROM (SELECT *, count(*) FILTER (third = 0) OVER (PARTITION BY cell_key, turn ORDER BY us, event_id) AS retry FROM {_sessions('cell_key', "status = 'failed'")} e) t WHERE third = 0 AND retry <= 2",
    "stream_ewma": f"SELECT worker, event_id, round(list_reduce(list(duration_s) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda a, e: 0.3 * e + 0.7 * a), 6) AS ewma FROM {_E} e WHERE duration_s > 0",
    "stream_run_end": f"SELECT run_id, CAST(d AS INT) AS done, CAST(f AS INT) AS failed FROM (SELECT *, count(*) FILTER (status = 'merged') OVER w AS d, count(*) FILTER (status = 'failed') OVER w AS f FROM {_sessions('run_id', FAILS)} e WINDOW w AS (PARTITION BY run_id, turn ORDER BY us, event_id)) t WHERE d + f = 25",
    "stream_transitions": f"SELECT mover, event_id, before, band FROM (SELECT *, lag(band) {_OVER}) AS before FROM {_E} e) t WHERE before <> band",
    "stream_dwell_penalty": dwells(_E, 43200000000, _NOW),
    "stream_log_tail": f"SELECT concat(cell_id, ',0,4') AS cell_key, row_number() OVER (PARTITION BY cell_id ORDER BY us, event_id) AS place, line FROM (SELECT *, lag(line) OVER (PARTITION BY cell_id ORDER BY us, event_id) AS before FROM {_ALL} e WHERE line LIKE 'ERROR%' OR line = 'still missing') t WHERE before IS NULL OR before <> line",
    "stream_upsert": f"SELECT cell_key AS id, max(event_id) AS version, arg_max(status, event_id) AS status FROM {_ALL} e GROUP BY cell_key",
}
