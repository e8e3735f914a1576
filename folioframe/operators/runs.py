"""Run accounting over step and event tables: streaks, budgets, transitions, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.operators import scan


def _blocked(rows: DataFrame, order: list[str], block: Column | None) -> DataFrame:
    return rows.withColumn("_block", scan.block_of(F.col(order[0])) if block is None else block)


def failure_streaks(
    steps: DataFrame,
    run: str,
    order: list[str],
    limits: dict[str, int] | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Streaks of failures, equal errors and equal tools, with the breaker decision.

    ``steps``: success, error_code, tool_name.  A success resets the streaks; the
    comparison with the last error or tool reaches across it.  A step without a tool
    neither extends nor breaks the tool streak.  Streaks are running counts minus the
    count where the streak began; ``block`` cuts long runs along the order.
    """
    lim = {**fx.BREAKER, **(limits or {})}
    key = [run]
    fail = ~F.col("success")
    uses_tool = fail & (F.coalesce("tool_name", F.lit("")) != "")
    seq = scan.running_last(
        _blocked(steps, order, block), key, order,
        _prev_error=F.when(fail, F.col("error_code")), _prev_tool=F.when(uses_tool, F.col("tool_name")),
    )
    one = lambda cond: F.when(cond, 1).otherwise(0)
    seq = scan.running_sums(seq, key, order, _fails=one(fail), _tools=one(uses_tool))
    new_error = fail & ~F.col("error_code").eqNullSafe(F.col("_prev_error"))
    new_tool = uses_tool & ~F.col("tool_name").eqNullSafe(F.col("_prev_tool"))
    seq = scan.running_last(
        seq, key, order, inclusive=True,
        _since_success=F.when(F.col("success"), F.col("_fails")),
        _since_error=F.when(F.col("success"), F.col("_fails")).when(new_error, F.col("_fails") - 1),
        _since_tool=F.when(F.col("success"), F.col("_tools")).when(new_tool, F.col("_tools") - 1),
    )
    streak = lambda total, base: F.when(fail, F.col(total) - F.coalesce(base, F.lit(0))).otherwise(0)
    out = seq.withColumns(
        {
            "failures": streak("_fails", "_since_success"),
            "same_error": streak("_fails", "_since_error"),
            "same_tool": streak("_tools", "_since_tool"),
        }
    )
    tripped = fail & (
        (F.col("failures") >= lim["failure_threshold"])
        | (F.col("same_error") >= lim["same_error_threshold"])
        | (uses_tool & (F.col("same_tool") >= lim["same_tool_threshold"]))
    )
    return out.withColumn("tripped", tripped).drop(*[c for c in out.columns if c.startswith("_")])


def run_budget(
    steps: DataFrame,
    run: str,
    order: list[str],
    budget: dict[str, float] | None = None,
    block: Column | None = None,
) -> DataFrame:
    """First step at which each limit is reached, per run.

    Only successful steps count.  A step that begins with the step limit already
    used up is the one that exceeds it.
    """
    b = budget or fx.RUN_BUDGETS["production"]
    done = F.when(F.col("success"), 1).otherwise(0)
    spent = lambda c: F.when(F.col("success"), F.col(c)).otherwise(0)
    seq = scan.running_sums(
        _blocked(steps, order, block), [run], order,
        step_index=F.lit(1), _steps=done, _tokens=spent("tokens"), _cost=spent("cost_usd"), _ms=spent("elapsed_ms"),
    )
    at = lambda cond: F.min(F.when(cond, F.col("step_index")))
    return seq.groupBy(run).agg(
        F.sum(done).cast("bigint").alias("steps_done"),
        at(F.col("_steps") - done >= b["max_steps"]).alias("steps_exceeded_at"),
        at(F.col("_tokens") > b["max_tokens"]).alias("tokens_exceeded_at"),
        at(F.round("_cost", 6) > b["max_cost_usd"]).alias("cost_exceeded_at"),
        at(F.col("_ms") > b["timeout_ms"]).alias("time_exceeded_at"),
    )


def transition_check(states: DataFrame, run: str, order: list[str], block: Column | None = None) -> DataFrame:
    """Each state change with whether the transition table (or a terminal target) allows it."""
    pairs = [(a, t) for a, targets in fx.ALLOWED_TRANSITIONS.items() for t in targets]
    table = states.sparkSession.createDataFrame(pairs, "from_state string, to_state string").withColumn(
        "_listed", F.lit(True)
    )
    moved = scan.running_last(_blocked(states, order, block), [run], order, from_state=F.col("state"))
    moved = moved.withColumns(
        {"from_state": F.coalesce("from_state", F.lit("init")), "to_state": F.col("state")}
    ).drop("_block")
    ok = F.coalesce("_listed", F.lit(False)) | F.col("to_state").isin(fx.TERMINAL_STATES)
    return moved.join(table, ["from_state", "to_state"], "left").withColumn("allowed", ok).drop("_listed", "state")


def retained(events: DataFrame, ref: Column, time_col: str = "occurred_at", severity: str = "severity") -> DataFrame:
    """Events still inside the retention of their severity."""
    days = F.create_map(*[F.lit(x) for kv in fx.RETENTION_DAYS.items() for x in kv])[F.col(severity)]
    return events.where(F.col(time_col) >= ref - F.make_dt_interval(days=days))


def payload_conformance(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Missing required and present forbidden keys per event.

    ``events``: event_type, payload (string map).  ``catalog``: event_type, required,
    forbidden (string arrays).
    """
    keys = F.map_keys("payload")
    missing = F.array_sort(F.array_except(F.coalesce("required", F.array().cast("array<string>")), keys))
    extra = F.array_sort(F.array_intersect(F.coalesce("forbidden", F.array().cast("array<string>")), keys))
    out = events.join(catalog, "event_type", "left").withColumns({"missing": missing, "forbidden_present": extra})
    return out.withColumn(
        "conforms", F.col("required").isNotNull() & (F.size("missing") == 0) & (F.size("forbidden_present") == 0)
    )


def judge(answer: Column, n_citations: Column, retrieval_ok: Column) -> Column:
    """A non-empty answer, with citations when retrieval worked."""
    from folioframe.functions import text as tx

    return (tx.strip(F.coalesce(answer, F.lit(""))) != "") & (~retrieval_ok | (n_citations > 0))
