"""Runs: cell timing, summaries, timelines, progress, and zone events in batch form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.lineage import cut, small
from tessera.operators.ordering import global_rank, nth_value

FAILED = ["failed", "drift", "collision"]
BUCKET = "20 seconds"


def attempts(events: DataFrame) -> DataFrame:
    """``events(event_id, ts, cell_key, status, worker, duration_s)`` per cell: attempts, latest status, worker and times."""
    latest = F.struct("ts", "event_id")
    at = lambda s: F.max(F.when(F.col("status") == s, F.col("ts")))
    over = F.col("status").isin("merged", *FAILED)
    return events.groupBy("cell_key").agg(
        F.count_if(F.col("status") == "started").alias("attempts"), F.max_by("status", latest).alias("status"), F.max_by("worker", latest).alias("worker"),
        F.min(F.when(F.col("status") == "queued", F.col("ts"))).alias("queued"), at("started").alias("started"), F.max(F.when(over, F.col("ts"))).alias("ended"),
        F.max_by(F.when(over, F.round("duration_s", 2)), F.struct(over, "ts", "event_id")).alias("duration_s"),
    )


def report_cells(timing: DataFrame, plan: DataFrame) -> DataFrame:
    """Timing with the plan: cells of either; a cell's own status first, then the plan's, else unknown."""
    t, p = timing.alias("t"), plan.select("cell_key", "status").alias("p")
    both = t.join(p, F.col("t.cell_key") == F.col("p.cell_key"), "full_outer")
    return both.select(
        F.coalesce("t.cell_key", "p.cell_key").alias("cell_key"), F.coalesce("t.status", "p.status", F.lit("unknown")).alias("status"),
        "worker", "queued", "started", "ended", "duration_s", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"),
    )


def run_summary(cells: DataFrame, line: DataFrame) -> DataFrame:
    """One row: counts by outcome, retries, durations of merged cells, the run's span, and load and workers from the timeline ``line``.

    workers_peak is the timeline's most active workers, or without any the number of worker ids.
    """
    done = F.col("status") == "merged"
    timed = done & (F.col("duration_s") > 0)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    totals = cells.agg(
        F.count("*").alias("total"), F.count_if(done).alias("merged"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
        F.count_if(~done & ~F.col("status").isin(*FAILED)).alias("incomplete"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"),
        F.min(F.when(timed, F.col("duration_s"))).alias("cell_fastest_s"), F.max(F.when(timed, F.col("duration_s"))).alias("cell_slowest_s"),
        F.round(F.avg(F.when(timed, F.col("duration_s"))), 1).alias("cell_avg_s"), (F.max("worker") + 1).alias("worker_ids"),
        F.round(F.max(seconds("ended")) - F.min(F.least(seconds("queued"), seconds("started"))), 1).alias("elapsed_s"),
    )
    times = cut(cells.where(timed).select("duration_s"))
    totals = totals.withColumn("cell_median_s", F.lit(nth_value(times, "duration_s", times.count() // 2)).cast("double"))  # the upper of two middle ones
    load = line.agg(
        F.nullif(F.coalesce(F.max("active"), F.lit(0)), F.lit(0)).alias("active_peak"), F.bround(F.avg("cpu")).cast("long").alias("cpu_avg"),
        F.max("cpu").alias("cpu_peak"), F.max("ram").alias("ram_peak"), F.bround(F.avg("ram")).cast("long").alias("ram_avg"),
    )
    both = totals.join(load)  # one row each
    peak = F.coalesce("active_peak", "worker_ids", F.lit(0)).cast("long").alias("workers_peak")
    return both.select(*[c for c in totals.columns if c != "worker_ids"], peak, "cpu_avg", "cpu_peak", "ram_avg", "ram_peak")


def timeline(samples: DataFrame) -> DataFrame:
    """``samples(event_id, ts, active, done, failed, cpu, ram)`` per 20 s: peak active, last done and failed, mean load half-even."""
    last = F.struct("ts", "event_id")
    return (
        samples.groupBy(F.window("ts", BUCKET).alias("w"))
        .agg(
            F.max("active").alias("active"), F.max_by("done", last).alias("done"), F.max_by("failed", last).alias("failed"),
            F.bround(F.avg("cpu")).cast("long").alias("cpu"), F.bround(F.avg("ram")).cast("long").alias("ram"),
        )
        .select(F.col("w.start").alias("t"), "active", "done", "failed", "cpu", "ram")
    )


def merged_per_step(line: DataFrame, *run: str) -> DataFrame:
    """Cells merged in each bucket: the rise of done, never below 0, 0 for the first."""
    before = F.lag("done").over(Window.partitionBy(*run).orderBy("t"))
    return line.withColumn("merged", F.greatest(F.lit(0), F.coalesce(F.col("done") - before, F.lit(0))))


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def dedupe_runs(lines: DataFrame) -> DataFrame:
    """Surfaced lines ``(cell_id, line_no, line)`` without those equal to the one before in their cell."""
    shown = lines.where(text.surfaces("line"))
    before = F.lag("line").over(Window.partitionBy("cell_id").orderBy("line_no"))
    return shown.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("line"))).drop("before")


def progress(lines: DataFrame) -> DataFrame:
    """Percent after each line of a cell's log; it never falls."""
    sofar = Window.partitionBy("cell_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("cell_id", "line_no", F.max(text.progress_step("line")).over(sofar).alias("pct"))


def ewma(events: DataFrame, by: str, alpha: float = 0.3) -> DataFrame:
    """Exponential mean of positive durations ``(ts, event_id, duration_s)`` in order of time; the first one seeds it.

    Written as a sum over the newest events of a group, weighted by how many came after, so no
    history is held; those whose weight is below 1e-300 change no digit of a double and are left
    out before the shuffle.
    """
    most = math.ceil(math.log(1e-300) / math.log1p(-alpha)) if alpha < 1 else 1
    newest_first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id")))
    ranked = events.where("duration_s > 0").select(by, "ts", "event_id", "duration_s").withColumn("place", newest_first).where(F.col("place") <= most)
    kept = F.pow(F.lit(1 - alpha), F.col("place") - 1)
    sums = ranked.groupBy(by).agg(F.sum(alpha * kept * F.col("duration_s")).alias("s"), F.max("place").alias("n"), F.max_by("duration_s", "place").alias("first"))
    return sums.select(by, (F.col("s") + F.col("first") * F.pow(F.lit(1 - alpha), F.col("n"))).alias("ewma"))


def log_labels(lines: DataFrame, reason, *by: str) -> DataFrame:
    """Failure label per group of ``lines(line_no, line)``, from the last characters that :func:`tessera.functions.text.fail_label` reads.

    Only lines that end among those characters are put together, so a long log is never held whole.
    """
    newest_first = Window.partitionBy(*by).orderBy(F.desc("line_no"))
    after = F.sum(F.length("line") + 1).over(newest_first.rowsBetween(Window.unboundedPreceding, -1))
    tail = lines.withColumn("after", F.coalesce(after, F.lit(0))).where(F.col("after") < text.TAIL)
    log = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return tail.groupBy(*by).agg(log.alias("log")).select(*by, text.fail_label("log", reason).alias("label"))


def log_health(lines: DataFrame, *by: str) -> DataFrame:
    """What makes the cells of ``lines(line)`` suspect, per group: the flags of :func:`tessera.functions.text.health_flags`, without putting a log together."""
    has = lambda phrase: F.coalesce(F.bool_or(F.contains("line", F.lit(phrase))), F.lit(False))
    found = lines.groupBy(*by).agg(has("is too small").alias("small"), has("Re-downloading").alias("again"), has("Failed to read ESA tile").alias("esa"))
    flags = F.array_compact(F.array(F.when(F.col("small") & F.col("again"), "terrain-tile-retry"), F.when(F.col("esa"), "landcover-404")))
    return found.select(*by, flags.alias("flags"))


def gantt(cells: DataFrame) -> DataFrame:
    """Bars ``(cell_key, lane, from, to)``: a dense index per worker and shares of the run's span, for cells that ran."""
    ran = cells.where("started is not null and ended is not null and worker is not null")
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    span = ran.agg(F.min(seconds("started")).alias("t0"), F.max(seconds("ended")).alias("t1"))
    lanes = small(global_rank(ran.select("worker").distinct(), "lane", "worker").withColumn("lane", (F.col("lane") - 1).cast("int")))
    length = F.greatest(F.lit(1e-6), F.col("t1") - F.col("t0"))
    share = lambda c: F.round((seconds(c) - F.col("t0")) / length, 6)
    return ran.join(lanes, "worker").join(F.broadcast(span)).select("cell_key", "lane", share("started").alias("from"), share("ended").alias("to"))


def top_cells(cells: DataFrame, n: int = 200) -> DataFrame:
    """Problem cells first: failed, unfinished, merged; slowest first; the first ``n``, with their place."""
    bad = F.when(F.col("status").isin(*FAILED), 0).when(F.col("status") != "merged", 1).otherwise(2)
    slow = F.coalesce("duration_s", F.lit(0.0))
    top = cells.select("cell_key", "status", bad.alias("bad"), slow.alias("slow")).orderBy("bad", F.desc("slow"), "cell_key").limit(n)
    return top.select("cell_key", "status", F.row_number().over(Window.orderBy("bad", F.desc("slow"), "cell_key")).alias("place"))


def systematic(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The rows at places floor(i * N / k), i from 0, in the given order: a row is taken iff a multiple of N/k falls on it.

    The order must tell rows apart.
    """
    total = df.count()
    if not total:
        return df.withColumn("place", F.lit(0).cast("long"))
    ranked = global_rank(df, "place", *order).withColumn("place", F.col("place") - 1)
    i = F.ceil(F.col("place") * k / total - 1e-12)  # the only multiple of N/k that can fall on this row
    return ranked.where((i < k) & (F.floor(i * total / k + 1e-12) == F.col("place")))


def zone_transitions(positions: DataFrame) -> DataFrame:
    """``positions(mover, ts, event_id, band)``: a row where the band differs from the mover's one before."""
    w = Window.partitionBy("mover").orderBy("ts", "event_id")
    return positions.withColumn("before", F.lag("band").over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col("band")))


def dwell_penalty(positions: DataFrame, interval: float = 60.0, base: int = 1, doubles: bool = True, most: int = 20, end: int | None = None) -> DataFrame:
    """Penalties of movers that stay in the hard band, up to ``end`` (micros; without it, the last position): ``(mover, at, step, penalty)``.

    ``positions(mover, ts, event_id, band, died)``. The first step is charged on entering, the next
    ones each ``interval`` seconds later, heard of or not, until a row outside the band or a death,
    which is not charged any more; the next row in the band starts a new dwell. Steps cost
    base * 2^(step - 1), the exponent held at ``most``, or base * step.
    """
    every = int(interval * 1e6)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = F.coalesce("died", F.lit(False)) | F.coalesce(F.col("band") != "hard", F.lit(True))
    w = Window.partitionBy("mover").orderBy("us", "event_id")
    marked = positions.select("mover", us.alias("us"), "event_id", ends.alias("ends"))
    island = marked.withColumn("island", F.count_if("ends").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spells = island.groupBy("mover", "island").agg(F.min(F.when(~F.col("ends"), F.col("us"))).alias("since"), F.min(F.when(F.col("ends"), F.col("us"))).alias("began"))
    closed = spells.withColumn("until", F.lead("began").over(Window.partitionBy("mover").orderBy("island"))).where("since is not null")
    now = F.lit(end) if end is not None else F.col("now")
    timed = closed if end is not None else closed.join(F.broadcast(marked.agg(F.max("us").alias("now"))))  # one row
    stay = F.coalesce(F.col("until") - 1, now) - F.col("since")  # the end itself counts, the moment of leaving does not
    charged = timed.where(stay >= 0).select("mover", "since", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.floor(stay / every) + 1)).alias("step"))
    size = F.pow(F.lit(2.0), F.least(F.col("step"), F.lit(most)) - 1) if doubles else F.col("step").cast("double")
    return charged.select("mover", F.timestamp_micros(F.col("since") + (F.col("step") - 1) * every).alias("at"), "step", (base * size).alias("penalty"))


def tier_stats(models: DataFrame) -> DataFrame:
    """``models(realm, tier, species, model)``: distinct species and variants per realm and tier, and over all realms."""
    return models.rollup("tier", "realm").agg(F.count_distinct("species").alias("species"), F.count("*").alias("variants")).where("tier is not null").select(F.coalesce("realm", F.lit("ALL")).alias("realm"), "tier", "species", "variants")
