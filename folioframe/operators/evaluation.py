"""Retrieval evaluation, question suites and lesson progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as tx


def haystack(with_doc_id: bool = True) -> Column:
    cols = ["file_name", "relative_path", "snippet"] + (["doc_id"] if with_doc_id else [])
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def any_needle(hay: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: hay.contains(F.lower(n)))


def query_ranks(questions: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Rank of the first relevant result within ``k`` (0 if none), hit and reciprocal rank.

    ``questions``: trace_id, expect_any.  ``results``: trace_id, rank and the citation
    columns.
    """
    top = results.where(F.col("rank") <= k).join(questions.select("trace_id", "expect_any"), "trace_id")
    first = top.groupBy("trace_id").agg(
        F.min(F.when(any_needle(haystack(), F.col("expect_any")), F.col("rank"))).alias("_rank"),
        F.count("*").alias("citations"),
    )
    rank = F.coalesce("_rank", F.lit(0))
    return questions.join(first, "trace_id", "left").select(
        "trace_id",
        rank.alias("rank"),
        (rank > 0).alias("hit"),
        F.when(rank > 0, 1.0 / rank).otherwise(0.0).alias("rr"),
        F.coalesce("citations", F.lit(0)).alias("citations"),
    )


def hit_and_mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.col("hit").cast("double")), 3).alias("hit_at_k"),
        F.round(F.avg("rr"), 3).alias("mrr"),
    )


def _top_name() -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file_name", "relative_path", "doc_id")])


def digits_match(name: Column, digits: Column) -> Column:
    return F.forall(digits, lambda d: tx.has_doc_number(name, d))


def strict_at_1(questions: DataFrame, results: DataFrame) -> DataFrame:
    """All expected numbers in the top file name; no citation or no number counts as a hit."""
    top = results.where(F.col("rank") == 1).select("trace_id", _top_name().alias("_name"))
    j = questions.join(top, "trace_id", "left")
    ok = F.col("_name").isNull() | (F.size("expect_digits") <= 0) | digits_match(F.col("_name"), F.col("expect_digits"))
    return j.select("trace_id", ok.alias("strict_hit"))


def match_reason(questions: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """ok, or the first failed check, per question.

    Checks in order: citations exist; a keyword in the top ``k``; the path part in the
    top ``k``; the numbers in the top name.
    """
    j = results.where(F.col("rank") <= k).join(
        questions.select("trace_id", "expect_any", "expect_path", "expect_digits"), "trace_id"
    )
    agg = j.groupBy("trace_id").agg(
        F.bool_or(any_needle(haystack(), F.col("expect_any"))).alias("_key"),
        F.bool_or(haystack().contains(F.lower("expect_path"))).alias("_path"),
        F.bool_or((F.col("rank") == 1) & digits_match(_top_name(), F.col("expect_digits"))).alias("_digits"),
    )
    reason = (
        F.when(F.col("_key").isNull(), "no_citations")
        .when((F.size("expect_any") > 0) & ~F.col("_key"), "no_keyword")
        .when((F.coalesce("expect_path", F.lit("")) != "") & ~F.col("_path"), "no_path")
        .when((F.size("expect_digits") > 0) & ~F.col("_digits"), "no_number")
        .otherwise("ok")
    )
    return questions.join(agg, "trace_id", "left").select(
        "trace_id", (reason == "ok").alias("passed"), reason.alias("reason")
    )


def pass_fail(reasons: DataFrame) -> DataFrame:
    return reasons.agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total")
    )


def compare_variants(results: DataFrame, variants: list[str], k: int = 3) -> DataFrame:
    """Hits and mean score per query, one pair of columns per index variant."""
    top = results.where(F.col("rank") <= k)
    wide = top.groupBy("trace_id").pivot("variant", variants).agg(
        F.count("score").alias("hits"), F.round(F.avg("score"), 4).alias("score")
    )
    return wide.select(
        "trace_id",
        *[F.coalesce(f"{v}_hits", F.lit(0)).alias(f"{v}_hits") for v in variants],
        *[F.coalesce(f"{v}_score", F.lit(0.0)).alias(f"{v}_score") for v in variants],
    )


def quality_trend(rows: DataFrame, snapshot: str) -> DataFrame:
    """Mean score over queries with hits per snapshot; null without queries, 0 without hits."""
    scored = F.when(F.col("hits") > 0, F.col("avg_score"))
    return rows.groupBy(snapshot).agg(
        F.when(F.count("query") == 0, F.lit(None).cast("double"))
        .otherwise(F.round(F.coalesce(F.avg(scored), F.lit(0.0)), 4))
        .alias("avg_score")
    )


def intent_benchmark(rows: DataFrame) -> DataFrame:
    ok = (F.col("intent") == F.col("expected_intent")) & (F.col("citation_count") > 0)
    return rows.agg(F.count_if(ok).alias("passed"), F.count("*").alias("total"))


def suite_status(suite: DataFrame, verdicts: DataFrame, cursor: int) -> DataFrame:
    """current / last verdict / pending per suite item (``verdicts``: item_id, verdict, at)."""
    last = verdicts.groupBy("item_id").agg(F.max_by("verdict", "at").alias("_v"))
    return suite.join(last, "item_id", "left").select(
        "item_id", F.when(F.col("position") == cursor, "current").otherwise(F.coalesce("_v", F.lit("pending"))).alias("status")
    )


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "fail", "err")])


def stratified_sample(files: DataFrame, priority: list[str], target: int = 20, min_size: int = 0, skip: list[str] | None = None) -> DataFrame:
    """One file per extension in priority order (shortest name first), then fill up.

    The row number per extension keeps at most ``target`` rows of each before the
    global order, so no single task sees the whole listing.
    """
    ext = F.col("extension")
    ok = files.where((F.col("size_bytes") >= min_size) & (ext != "") & ~ext.isin(skip or []))
    w = Window.partitionBy("extension").orderBy(F.length("file_name"), "relative_path")
    ranked = ok.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= target)
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), ext)
    lead = F.when((F.col("_n") == 1) & (place > 0), place).otherwise(F.lit(len(priority) + 1))
    return ranked.withColumn("_lead", lead).orderBy("_lead", "extension", F.length("file_name"), "relative_path").limit(target).drop("_n", "_lead")


def attempt_history(attempts: DataFrame, keep: int = 20) -> DataFrame:
    """Per (user, lesson): attempts kept, whether it was ever passed, last score."""
    return attempts.groupBy("user_id", "lesson_id").agg(
        F.least(F.count("*"), F.lit(keep)).alias("kept"),
        F.bool_or("passed").alias("completed"),
        F.max_by("score", "at").alias("last_score"),
    )


def learner_progress(history: DataFrame, total_lessons: int | Column) -> DataFrame:
    total = F.lit(total_lessons) if isinstance(total_lessons, int) else total_lessons
    done = F.count_if("completed")
    return history.groupBy("user_id").agg(
        done.alias("completed"),
        F.when(F.max(total) > 0, F.round(done * 100.0 / F.max(total), 1)).otherwise(0.0).alias("percent"),
    )
