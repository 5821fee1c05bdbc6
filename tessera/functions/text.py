"""Classification of log lines and failures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure markers in order with their labels, transient and final reasons, and words of log lines.
FAIL_MARKERS = [
    ("out of memory", "out of memory"),
    ("memoryerror", "out of memory"),
    ("no space left", "disk full"),
    ("os error 112", "disk full"),
    ("not enough space", "disk full"),
    ("rate limit", "Overpass rate limit"),
    ("too many requests", "Overpass rate limit"),
    ("timed out", "network timeout"),
    ("timeout", "network timeout"),
    ("panicked", "generator crashed (panic)"),
    ("failed to fetch", "data fetch failed"),
    ("overpass", "Overpass error"),
    ("connection", "network error"),
]
TRANSIENT = ["timeout", "rate limit", "network", "fetch failed", "out of memory", "generation failed", "no world produced", "overpass"]
FINAL = ["disk full", "panic", "merge error"]
FINAL_STATUS = ["drift", "collision"]
MAX_RETRIES = 2
SURFACE = [
    "warning", "error", "failed", "panic", "fallback", "falling back", "elevation", "still missing", "retry", "could not be fetched",
    "flat ground", "unavailable", "corrupted", "land cover", "downloading",
]
NOISE = ["fetching tile x=", "loading cached tile", "bilinear sampling"]
SPLIT_MARKERS = ["rate limited", "timed out", "request timeout", "maxsize", "too many", "timeout", "out of memory", "server overloaded"]
RETRY_MARKERS = ["rate limited", "timed out", "request timeout", "timeout", "server overloaded"]
PROGRESS = [("fetching", 8), ("processing", 20), ("ground", 35), ("generating", 55), ("saving", 90), ("done", 100)]
TAIL, LABEL = 6000, 120


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def fail_label(log, reason) -> Column:
    """Label of the first marker, in their order, in the log's last characters; else the reason, shortened."""
    tail = F.lower(F.right(col(log), F.lit(TAIL)))
    label = F.coalesce(F.trim(col(reason)), F.lit("failed"))
    for marker, name in reversed(FAIL_MARKERS):
        label = F.when(F.contains(tail, F.lit(marker)), name).otherwise(label)
    return F.substring(label, 1, LABEL)


def health_flags(log) -> Column:
    """Array of what makes a merged cell suspect."""
    log = col(log)
    retried = F.contains(log, F.lit("is too small")) & F.contains(log, F.lit("Re-downloading"))
    return F.array_compact(
        F.array(F.when(retried, "terrain-tile-retry"), F.when(F.contains(log, F.lit("Failed to read ESA tile")), "landcover-404"))
    )


def retryable(reason, status, retries) -> Column:
    low = F.lower(F.coalesce(col(reason), F.lit("")))
    final = F.coalesce(col(status).isin(*FINAL_STATUS), F.lit(False)) | any_of(low, FINAL)
    return any_of(low, TRANSIENT) & ~final & (col(retries) < MAX_RETRIES)


def surfaces(line) -> Column:
    low = F.lower(col(line))
    return ~any_of(low, NOISE) & any_of(low, SURFACE)


def fetch_class(text) -> Column:
    """First split marker in a fetch's output (null for none)."""
    low, out = F.lower(col(text)), F.lit(None).cast("string")
    for marker in reversed(SPLIT_MARKERS):
        out = F.when(F.contains(low, F.lit(marker)), marker).otherwise(out)
    return out


def fetch_again(text) -> Column:
    """Whether a fetch failed for a passing reason, so that it is tried again as it is; other marked failures need a smaller box."""
    return F.coalesce(fetch_class(text).isin(*RETRY_MARKERS), F.lit(False))


def tile_outcome(code, size) -> Column:
    return F.when(col(code).isin(403, 404), "absent").when((col(code) != 200) | (col(size) < 67), "fail").otherwise("ok")


def progress_step(line) -> Column:
    """Percent that one line tells of."""
    low, steps = F.lower(col(line)), [F.lit(0)]
    for word, pct in PROGRESS:
        steps.append(F.when(F.contains(low, F.lit(word)), pct).otherwise(0))
    part = lambda k: F.regexp_extract(col(line), r"(\d+)\s*/\s*(\d+)", k).try_cast("double")
    done, total = part(1), part(2)
    mapped = F.least(F.lit(95), F.floor(35 + done / total * 53).cast("int"))
    steps.append(F.when((done > 0) & (done <= total) & (total > 10), mapped).otherwise(0))
    return F.greatest(*steps)


def warm_totals(line) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(col(line), r"(\d+) tile\(s\) cached, (\d+) failed", k).try_cast("long")
    return part(1), part(2)
