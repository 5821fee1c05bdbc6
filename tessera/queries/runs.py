"""Queries of logs, runs and zone events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.functions import text
from tessera.operators import runs
from tessera.operators import zones as zo

OLAT, OLON, SCALE = 45.0, 25.0, 0.3


def fail_label(spark, d):
    parts = view(spark, d, "fx_log_line").withColumn("part", F.col("line_no") % 50)
    return runs.log_labels(parts, F.lit(" generation failed "), "cell_id", "part")


def line_labels(spark, d):
    return view(spark, d, "fx_log_line").select("line_no", text.fail_label("line", F.lit(None).cast("string")).alias("label"))


def health_flags(spark, d):
    parts = view(spark, d, "fx_log_line").withColumn("part", F.col("line_no") % 9)
    return runs.log_health(parts, "cell_id", "part").withColumn("flags", F.array_join("flags", ","))


def retryable(spark, d):
    lines = view(spark, d, "fx_log_line").withColumn("status", F.when(F.col("line_no") % 7 == 0, "drift").otherwise("failed")).withColumn("n", F.col("line_no") % 4)
    return lines.select("line_no", text.retryable(text.fail_label("line", F.lit("failed")), "status", "n").alias("again"))


def fetch_class(spark, d):
    return view(spark, d, "fx_log_line").select("line_no", text.fetch_class("line").alias("marker"), text.fetch_again("line").alias("again"))


def tile_outcome(spark, d):
    e = view(spark, d, "events").select("event_id", (F.col("event_id") % 5 + 400).alias("code"), (F.col("event_id") % 99).alias("size"))
    return e.select("event_id", text.tile_outcome(F.when(F.col("code") == 400, 200).otherwise(F.col("code")), "size").alias("outcome"))


def surfaced_lines(spark, d):
    return view(spark, d, "fx_log_line").where(text.surfaces("line")).select("line_no", "cell_id", "line")


def warm_totals(spark, d):
    lines = view(spark, d, "events").select("event_type", F.concat((F.col("event_id") % 7).cast("string"), F.lit(" tile(s) cached, "), (F.col("user_id") % 3).cast("string"), F.lit(" failed")).alias("line"))
    ok, bad = text.warm_totals("line")
    return lines.groupBy("event_type").agg(F.sum(ok).alias("cached"), F.sum(bad).alias("failed"))


def dedupe_runs(spark, d):
    return runs.dedupe_runs(view(spark, d, "fx_log_line").withColumn("line", F.when(F.col("line_no") % 10 == 1, F.lit("ERROR: out of memory while saving")).otherwise(F.col("line")))).select("cell_id", "line_no", "line")


def progress(spark, d):
    return runs.progress(view(spark, d, "fx_log_line"))


def newest_lines(spark, d):
    return runs.newest(view(spark, d, "fx_log_line"), 150, "line_no").select("line_no", "line")


def _timing(spark, d):
    return runs.attempts(view(spark, d, "fx_cell_event"))


def attempts(spark, d):
    return _timing(spark, d).select("cell_key", "attempts", "status", "worker", "duration_s", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"))


def _cells(spark, d):
    return runs.report_cells(_timing(spark, d).where("cell_key not like '0,%'"), view(spark, d, "fx_plan"))


def report_cells(spark, d):
    times = [F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("queued", "started", "ended")]
    return _cells(spark, d).select("cell_key", "status", "worker", *times, "duration_s", "attempts")


def run_summary(spark, d):
    return runs.run_summary(_cells(spark, d), runs.timeline(_samples(spark, d)))


def _samples(spark, d):
    e = view(spark, d, "events")
    return e.select("event_id", "ts", (F.col("event_id") % 9).alias("active"), (F.col("event_id") * 2).alias("done"), (F.col("event_id") % 5).alias("failed"), (F.col("user_id") % 101).cast("double").alias("cpu"), (F.col("user_id") % 64).cast("double").alias("ram"))


def timeline(spark, d):
    t = runs.timeline(_samples(spark, d))
    return t.select(F.unix_seconds(F.col("t").cast("timestamp")).alias("t"), "active", "done", "failed", "cpu", "ram")


def merged_per_step(spark, d):
    t = runs.timeline(_samples(spark, d)).withColumn("day", F.to_date("t"))
    return runs.merged_per_step(t, "day").select(F.unix_seconds(F.col("t").cast("timestamp")).alias("t"), "merged")


def newest_buckets(spark, d):
    t = runs.timeline(_samples(spark, d)).select(F.unix_seconds(F.col("t").cast("timestamp")).alias("t"), "active")
    return runs.newest(t, 360, "t")


def ewma(spark, d):
    e = view(spark, d, "fx_cell_event").where("status = 'merged'")
    return runs.ewma(e, "worker").select("worker", F.round("ewma", 6).alias("ewma"))


def gantt_lanes(spark, d):
    return runs.gantt(_timing(spark, d).where("ended >= started"))


def top_cells(spark, d):
    return runs.top_cells(_cells(spark, d), 40)


def systematic_sample(spark, d):
    return runs.systematic(view(spark, d, "fx_point").select("point_id", "kind"), 64, "point_id").select("point_id", "kind")


def _banded(spark, d):
    p = view(spark, d, "fx_position")
    at = p.select(F.col("event_id").alias("point_id"), "lat", "lon")
    band = zo.zone_band(at, view(spark, d, "fx_zone_vertex"), OLAT, OLON, SCALE, 5.0, 15.0, 5.0).select("point_id", "band")
    return p.join(band, F.col("event_id") == F.col("point_id")).select("mover", "ts", "event_id", "band")


def zone_transitions(spark, d):
    return runs.zone_transitions(_banded(spark, d)).select("mover", "event_id", "before", "band")


def dwell_penalty(spark, d):
    e = view(spark, d, "events").select(F.col("user_id").alias("mover"), "ts", "event_id", F.when(F.col("event_id") % 17 == 0, "soft").otherwise("hard").alias("band"), (F.col("event_id") % 23 == 0).alias("died"))
    return runs.dwell_penalty(e, 43200.0).select("mover", F.unix_micros("at").alias("at_us"), "step", "penalty")


def tier_stats(spark, d):
    p = view(spark, d, "part").select(F.col("p_brand").alias("realm"), (F.col("p_size") % 3).alias("tier"), F.col("p_type").alias("species"), F.col("p_name").alias("model"))
    return runs.tier_stats(p)


QUERIES = {
    f.__name__: f
    for f in (
        fail_label, line_labels, health_flags, retryable, fetch_class, tile_outcome, surfaced_lines, warm_totals, dedupe_runs, progress,
        newest_lines, attempts, report_cells, run_summary, timeline, merged_per_step, newest_buckets, ewma, gantt_lanes, top_cells,
        systematic_sample, zone_transitions, dwell_penalty, tier_stats,
    )
}

from tessera.queries.streams import dwells  # noqa: E402
from tessera.queries.rasters import _DIST, _EB, _inside, _BX, _BZ  # noqa: E402


def _label(log, reason):
    return f"left(CASE {' '.join(f"WHEN contains(lower(right({log}, 6000)), '{m}') THEN '{n}'" for m, n in text.FAIL_MARKERS)} ELSE {reason} END, 120)"


def _any(x, words):
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


_LAB = _label("line", "'failed'")
_SURF = f"NOT {_any('line', text.NOISE)} AND {_any('line', text.SURFACE)}"
_PROG = "greatest(" + ", ".join(f"CASE WHEN contains(lower(line), '{w}') THEN {p} ELSE 0 END" for w, p in text.PROGRESS)
_PROG += r", CASE WHEN a > 0 AND a <= b AND b > 10 THEN least(95, CAST(floor(35 + a / b * 53) AS INT)) ELSE 0 END)"
_END = "status IN ('merged', 'failed', 'drift', 'collision')"
_TIMING = f"(SELECT cell_key, count(*) FILTER (status = 'started') AS attempts, arg_max(status, (ts, event_id)) AS status, arg_max(worker, (ts, event_id)) AS worker, min(ts) FILTER (status = 'queued') AS queued, max(ts) FILTER (status = 'started') AS started, max(ts) FILTER ({_END}) AS ended, arg_max(round(duration_s, 2), (ts, event_id)) FILTER ({_END}) AS duration_s FROM fx_cell_event GROUP BY cell_key)"
_CELLS = f"(SELECT coalesce(t.cell_key, p.cell_key) AS cell_key, coalesce(t.status, p.status, 'unknown') AS status, t.worker, t.queued, t.started, t.ended, t.duration_s, coalesce(t.attempts, 0) AS attempts FROM (SELECT * FROM {_TIMING} q WHERE cell_key NOT LIKE '0,%') t FULL OUTER JOIN fx_plan p ON p.cell_key = t.cell_key)"
_LINE = "(SELECT CAST(floor(epoch(ts) / 20) AS BIGINT) * 20 AS t, max(event_id % 9) AS active, arg_max(event_id * 2, (ts, event_id)) AS done, arg_max(event_id % 5, (ts, event_id)) AS failed, CAST(round_even(avg(user_id % 101), 0) AS BIGINT) AS cpu, CAST(round_even(avg(user_id % 64), 0) AS BIGINT) AS ram FROM events GROUP BY 1)"
_OK = "status = 'merged' AND duration_s > 0"
_FAILS = "status IN ('failed', 'drift', 'collision')"
_SUMMARY = f"""(SELECT c.*, l.* FROM (SELECT count(*) AS total, count(*) FILTER (status = 'merged') AS merged, count(*) FILTER ({_FAILS}) AS failed, count(*) FILTER (status <> 'merged' AND NOT {_FAILS}) AS incomplete, CAST(sum(greatest(0, attempts - 1)) AS BIGINT) AS retries,
 min(duration_s) FILTER ({_OK}) AS cell_fastest_s, max(duration_s) FILTER ({_OK}) AS cell_slowest_s, round(avg(duration_s) FILTER ({_OK}), 1) AS cell_avg_s, round(max(epoch_us(ended)) / 1e6 - min(least(epoch_us(queued), epoch_us(started))) / 1e6, 1) AS elapsed_s,
 list_sort(list(duration_s) FILTER ({_OK}))[CAST(floor(count(*) FILTER ({_OK}) / 2.0) AS INT) + 1] AS cell_median_s FROM {_CELLS} c) c
 CROSS JOIN (SELECT max(active) AS workers_peak, CAST(round_even(avg(cpu), 0) AS BIGINT) AS cpu_avg, max(cpu) AS cpu_peak, CAST(round_even(avg(ram), 0) AS BIGINT) AS ram_avg, max(ram) AS ram_peak FROM {_LINE} t) l)"""
_CELLS_ALL = f"(SELECT coalesce(t.cell_key, p.cell_key) AS cell_key, coalesce(t.status, p.status, 'unknown') AS status, t.worker, t.queued, t.started, t.ended, t.duration_s, coalesce(t.attempts, 0) AS attempts FROM {_TIMING} t FULL OUTER JOIN fx_plan p ON p.cell_key = t.cell_key)"
_SUMMARY_ALL = _SUMMARY.replace(_CELLS, _CELLS_ALL)
_POS = _inside("fx_position", "event_id")
_BANDED = f"""(SELECT p.mover, p.ts, p.event_id, CASE WHEN i.event_id IS NOT NULL THEN 'inside' WHEN d <= 1500.0 THEN 'soft' WHEN d <= 4500.0 THEN 'hard' WHEN d <= 6000.0 THEN 'trim' ELSE 'outside' END AS band
 FROM fx_position p LEFT JOIN (SELECT DISTINCT event_id FROM {_POS} i) i ON i.event_id = p.event_id JOIN (SELECT event_id, min({_DIST}) AS d FROM (SELECT event_id, {_BX.format(lon='lon')} AS x, {_BZ.format(lat='lat')} AS z FROM fx_position) q CROSS JOIN {_EB} e GROUP BY event_id) m ON m.event_id = p.event_id)"""

SQL = {
    "fail_label": f"SELECT cell_id, part, {_label('log', "'generation failed'")} AS label FROM (SELECT cell_id, line_no % 50 AS part, string_agg(line, chr(10) ORDER BY line_no) AS log FROM fx_log_line GROUP BY 1, 2) t",
    "line_labels": f"SELECT line_no, {_LAB} AS label FROM fx_log_line",
    "health_flags": "SELECT cell_id, line_no % 9 AS part, concat_ws(',', CASE WHEN bool_or(line LIKE '%is too small%') AND bool_or(line LIKE '%Re-downloading%') THEN 'terrain-tile-retry' END, CASE WHEN bool_or(line LIKE '%Failed to read ESA tile%') THEN 'landcover-404' END) AS flags FROM fx_log_line GROUP BY 1, 2",
    "retryable": f"SELECT line_no, {_any('l', text.TRANSIENT)} AND NOT (line_no % 7 = 0 OR {_any('l', text.FINAL)}) AND line_no % 4 < 2 AS again FROM (SELECT line_no, {_LAB} AS l FROM fx_log_line) t",
    "fetch_class": f"SELECT line_no, CASE {' '.join(f"WHEN contains(lower(line), '{m}') THEN '{m}'" for m in text.SPLIT_MARKERS)} END AS marker, coalesce(CASE {' '.join(f"WHEN contains(lower(line), '{m}') THEN {str(m in text.RETRY_MARKERS).upper()}" for m in text.SPLIT_MARKERS)} END, FALSE) AS again FROM fx_log_line",
    "tile_outcome": "SELECT event_id, CASE WHEN event_id % 5 IN (3, 4) THEN 'absent' WHEN event_id % 5 <> 0 OR event_id % 99 < 67 THEN 'fail' ELSE 'ok' END AS outcome FROM events".replace("IN (3, 4)", "= 3 OR event_id % 5 = 4"),
    "surfaced_lines": f"SELECT line_no, cell_id, line FROM fx_log_line WHERE {_SURF}",
    "warm_totals": "SELECT event_type, CAST(sum(event_id % 7) AS BIGINT) AS cached, CAST(sum(user_id % 3) AS BIGINT) AS failed FROM events GROUP BY event_type",
    "dedupe_runs": f"SELECT cell_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY cell_id ORDER BY line_no) AS b FROM (SELECT cell_id, line_no, CASE WHEN line_no % 10 = 1 THEN 'ERROR: out of memory while saving' ELSE line END AS line FROM fx_log_line) l WHERE {_SURF}) t WHERE b IS NULL OR b <> line",
    "progress": rf"SELECT cell_id, line_no, max(p) OVER (PARTITION BY cell_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS pct FROM (SELECT cell_id, line_no, {_PROG} AS p FROM (SELECT *, TRY_CAST(regexp_extract(line, '(\d+)\s*/\s*(\d+)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(line, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE) AS b FROM fx_log_line) l) t",
    "newest_lines": "SELECT line_no, line FROM fx_log_line ORDER BY line_no DESC LIMIT 150",
    "attempts": f"SELECT cell_key, attempts, status, worker, duration_s, epoch_us(started) AS started_us FROM {_TIMING} t",
    "report_cells": f"SELECT cell_key, status, worker, epoch_us(queued) AS queued_us, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, duration_s, attempts FROM {_CELLS} c",
    "run_summary": f"SELECT * FROM {_SUMMARY} s",
    "timeline": f"SELECT * FROM {_LINE} t",
    "merged_per_step": f"SELECT t, greatest(0, coalesce(done - lag(done) OVER (PARTITION BY CAST(floor(t / 86400.0) AS BIGINT) ORDER BY t), 0)) AS merged FROM {_LINE} l",
    "newest_buckets": f"SELECT t, active FROM {_LINE} l ORDER BY t DESC LIMIT 360",
    "ewma": "SELECT worker, round(list_reduce(list(duration_s ORDER BY ts, event_id), lambda a, e: 0.3 * e + 0.7 * a), 6) AS ewma FROM fx_cell_event WHERE status = 'merged' AND duration_s > 0 GROUP BY worker",
    "gantt_lanes": f"SELECT cell_key, lane, round((s - min(s) OVER ()) / (max(e) OVER () - min(s) OVER ()), 6) AS \"from\", round((e - min(s) OVER ()) / (max(e) OVER () - min(s) OVER ()), 6) AS \"to\" FROM (SELECT cell_key, CAST(dense_rank() OVER (ORDER BY worker) - 1 AS INT) AS lane, epoch_us(started) / 1e6 AS s, epoch_us(ended) / 1e6 AS e FROM {_TIMING} t WHERE ended >= started) b",
    "top_cells": f"SELECT cell_key, status, CAST(place AS INT) AS place FROM (SELECT cell_key, status, row_number() OVER (ORDER BY CASE WHEN {_FAILS} THEN 0 WHEN status <> 'merged' THEN 1 ELSE 2 END, coalesce(duration_s, 0) DESC, cell_key) AS place FROM {_CELLS} c) t WHERE place <= 40",
    "systematic_sample": "SELECT point_id, kind FROM (SELECT point_id, kind, row_number() OVER (ORDER BY point_id) - 1 AS p FROM fx_point) t WHERE p IN (SELECT CAST(floor(i * n / 64.0) AS BIGINT) FROM range(64) r(i) CROSS JOIN (SELECT count(*) AS n FROM fx_point) c)",
    "zone_transitions": f"SELECT mover, event_id, before, band FROM (SELECT *, lag(band) OVER (PARTITION BY mover ORDER BY ts, event_id) AS before FROM {_BANDED} b) t WHERE before <> band",
    "dwell_penalty": dwells("(SELECT user_id AS mover, epoch_us(ts) AS us, event_id, CASE WHEN event_id % 17 = 0 THEN 'soft' ELSE 'hard' END AS band, event_id % 23 = 0 AS died FROM events)", 43200000000, "(SELECT max(epoch_us(ts)) FROM events)"),
    "tier_stats": "SELECT coalesce(realm, 'ALL') AS realm, tier, species, variants FROM (SELECT p_brand AS realm, p_size % 3 AS tier, count(DISTINCT p_type) AS species, count(*) AS variants FROM part GROUP BY GROUPING SETS ((p_brand, p_size % 3), (p_size % 3))) t",
}
