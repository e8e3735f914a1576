"""Ingest progress, error and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.functions import text as tx

OUTCOMES = ["imported", "duplicate", "rejected", "ocr_failed", "too_large", "skip_temp", "skip_unchanged", "errors"]


def action_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("import_action").agg(F.count("*").alias("files"))


def import_stats(outcomes: DataFrame) -> DataFrame:
    """All counters in one pass over the per-file outcome."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("corpus_id").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "corpus_id")


def distinct_files(chunks: DataFrame, group: str = "corpus_id") -> DataFrame:
    """Distinct files and chunks: the first non-empty of metadata path, path, document id."""
    path = F.coalesce(
        F.nullif(F.col("metadata")["source_relative_path"], F.lit("")), F.nullif("doc_path", F.lit("")), "doc_id"
    )
    return chunks.groupBy(group).agg(F.countDistinct(path).alias("files"), F.count("*").alias("chunks"))


def error_summary(errors: DataFrame) -> DataFrame:
    return (
        errors.groupBy(tx.error_key(F.col("error")).alias("type"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "type")
    )


def ingest_yield(stats: DataFrame) -> DataFrame:
    """Adds pending_scan and import_yield_pct to counters with live_scanned and total_candidates."""
    live = F.col("live_scanned")
    return stats.withColumns(
        {
            "pending_scan": F.greatest(F.col("total_candidates") - live, F.lit(0)),
            "import_yield_pct": F.when(live > 0, F.round(F.lit(100.0) * F.col("imported") / live, 1)),
        }
    )


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def eta_hours(started: Column, now: Column, live: Column, total: Column, min_hours: float = 0.05) -> Column:
    """Hours left at the mean rate since the start; null while too early to tell."""
    elapsed = (_seconds(now) - _seconds(started)) / 3600.0
    return (
        F.when(total <= 0, F.lit(None).cast("double"))
        .when(live >= total, 0.0)
        .when(started.isNull() | (live <= 0) | (elapsed < min_hours), F.lit(None).cast("double"))
        .otherwise((total - live) / (live / elapsed))
    )


def progress_report(state: DataFrame, now: Column) -> DataFrame:
    """Percent, completeness and ETA from processed, heartbeat, total and start time."""
    live = F.greatest("processed", F.coalesce("heartbeat_index", F.lit(0)))
    total = F.col("total")
    return state.withColumn("live_progress", live).withColumns(
        {
            "percent": F.when(total > 0, F.round(F.col("live_progress") * 100.0 / total, 1)).otherwise(0.0),
            "complete": F.col("live_progress") >= total,
            "eta_hours": F.round(eta_hours(F.col("started_at"), now, F.col("live_progress"), total), 1),
        }
    )


def progress_log_rate(log: DataFrame, now: Column, group: list[str]) -> DataFrame:
    """Rate and ETA from the first and last points of each log.

    ``log``: recorded_at (timestamp), live_progress, total.
    """
    first, last = (lambda c: F.min_by(c, "recorded_at")), (lambda c: F.max_by(c, "recorded_at"))
    ends = log.groupBy(*group).agg(
        F.count("*").alias("points"),
        F.min("recorded_at").alias("first_at"),
        F.max("recorded_at").alias("last_at"),
        first("live_progress").alias("_p0"),
        last("live_progress").alias("_p1"),
        last("total").alias("_total"),
    )
    hours = (_seconds(F.col("last_at")) - _seconds(F.col("first_at"))) / 3600.0
    rate = F.when((F.col("_p1") > F.col("_p0")) & (hours > 0), (F.col("_p1") - F.col("_p0")) / hours)
    since = F.greatest((_seconds(now) - _seconds(F.col("last_at"))) / 3600.0, F.lit(0.0))
    left = F.greatest(F.col("_total") - (F.col("_p1") + F.col("_rate") * since), F.lit(0.0))
    eta = F.when((F.col("points") < 2) | F.col("_rate").isNull(), F.lit(None).cast("double")).when(
        F.col("_total") <= F.col("_p1"), 0.0
    ).otherwise(left / F.col("_rate"))
    return ends.withColumn("_rate", rate).select(
        *group,
        "points",
        (F.col("_p1") - F.col("_p0")).alias("progress_delta"),
        F.round("_rate", 1).alias("rate_per_hour"),
        F.round(eta, 2).alias("eta_hours_from_log"),
    )


def milestones(percent: Column, done: Column, thresholds: list[int] | None = None) -> Column:
    """struct(ready, next): first reached but not done threshold, first not reached."""
    steps = F.array(*[F.lit(t) for t in thresholds or fx.MILESTONES])
    ready = F.array_min(F.filter(steps, lambda t: (percent >= t) & ~F.array_contains(done, t)))
    upcoming = F.array_min(F.filter(steps, lambda t: percent < t))
    return F.struct(ready.alias("ready"), upcoming.alias("next"))


def overall_checks(checks: DataFrame, group: list[str]) -> DataFrame:
    """``verified``: every blocking check passed.  ``checks``: name, passed, blocking."""
    return checks.groupBy(*group).agg(
        F.every(F.col("passed") | ~F.col("blocking")).alias("verified"),
        F.count("*").alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def load_check(loaded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Loaded rows against distinct chunk ids, as a non-blocking check row."""
    a = loaded.agg(F.count("*").alias("loaded"))
    b = chunks.agg(F.countDistinct("chunk_id").alias("expected"))
    return a.join(b).select(
        F.lit("loaded_vs_chunks").alias("name"),
        "loaded",
        "expected",
        (F.col("loaded") >= F.col("expected")).alias("passed"),
        F.lit(False).alias("blocking"),
    )


def index_phase(complete: Column, ready: Column, done: Column) -> Column:
    return (
        F.when(done, "post_finalize")
        .when(ready, "ready_for_finalize")
        .when(complete, "reindex_complete_lock")
        .otherwise("reindexing")
    )


def next_step(phase: Column, services_ready: Column) -> Column:
    return (
        F.when(phase == "post_finalize", "checklist")
        .when(phase == "reindexing", "watch")
        .when(services_ready, "finalize")
        .otherwise("wait_for_services")
    )


def extraction_metrics(attempts: DataFrame) -> DataFrame:
    """Fallback, partial and error rates and mean duration per provider."""
    rate = lambda cond: F.round(F.avg(cond.cast("double")), 4)
    return attempts.groupBy("provider").agg(
        F.count("*").alias("documents"),
        rate(F.col("fallback_used")).alias("fallback_rate"),
        rate(F.col("ocr_status") == "partial").alias("partial_rate"),
        rate(F.col("ocr_status") == "failed").alias("error_rate"),
        F.round(F.avg("duration_ms"), 3).alias("avg_duration_ms"),
    )


def extraction_fallback(status: Column, confidence: Column, page_count: Column, chars: Column) -> Column:
    """Reason to retry with another extractor, or null."""
    return (
        F.when(status == "failed", "primary_error")
        .when(confidence < 0.65, "low_confidence")
        .when((page_count > 1) & (chars < 50), "empty_text")
    )


def compare_extractors(rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean characters per extractor over successful rows."""
    ok = rows.where(F.col("status") == "ok")
    return ok.groupBy().pivot("extractor", names).agg(F.round(F.avg("chars"), 1))


def load_rate(state: DataFrame) -> DataFrame:
    """Percent, remaining and ETA minutes of a load from offset, total and elapsed minutes."""
    rate = F.when(F.col("elapsed_min") > 0, F.col("offset") / F.col("elapsed_min"))
    left = F.greatest(F.col("total") - F.col("offset"), F.lit(0))
    return state.select(
        *state.columns,
        F.when(F.col("total") > 0, F.round(F.col("offset") * 100.0 / F.col("total"), 1)).otherwise(0.0).alias("percent"),
        left.alias("remaining"),
        F.round(rate, 3).alias("rate_per_min"),
        F.round(F.when(rate > 0, left / rate), 2).alias("eta_min"),
    )


def folder_file_counts(manifest: DataFrame) -> DataFrame:
    parent = F.regexp_replace(F.regexp_replace("relative_path", "[^/]*$", ""), "/$", "")
    visible = manifest.where(~tx.base_name(F.col("relative_path")).startswith("."))
    return visible.groupBy(parent.alias("folder")).agg(F.count("*").alias("files"))


def text_coverage(chunks: DataFrame, docs: DataFrame, script: str = "[а-яёА-ЯЁ]") -> DataFrame:
    """no_text / low_text hint per document (null when some piece reads as prose)."""
    good = F.sum(F.when(tx.text_quality(F.col("content"), script) > 0.35, 1).otherwise(0))
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), good.alias("good"))
    hint = F.when(F.col("n").isNull(), "no_text").when(F.col("good") == 0, "low_text")
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("chunks"), hint.alias("hint")
    )
