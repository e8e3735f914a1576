"""Run accounting: runs are users, steps their events, failures the error events."""

from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.operators import ingest as ig
from folioframe.operators import reports as rp
from folioframe.operators import runs as rn
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.text_queries import _pick, _sql_pick

SQL_STEPS = """
steps AS (SELECT event_id, ts, user_id AS run, event_type NOT IN ('error', 'signup') AS success, 'E' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS error_code,
          CASE WHEN event_id % 4 <> 0 THEN 'tool_' || (CAST(json_extract_string(props, '$.k') AS INT) % 2) END AS tool_name, value FROM events)
"""


def steps(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("run"),
        (~F.col("event_type").isin("error", "signup")).alias("success"),
        F.concat(F.lit("E"), k % 3).alias("error_code"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("tool_"), k % 2)).alias("tool_name"),
        "value",
    )


DAY = lambda: F.datediff(F.col("ts"), F.lit("2024-01-01"))


def sql_walk(order: str) -> str:
    """The streaks as a step-by-step walk over each run."""
    return "WITH RECURSIVE " + SQL_STEPS.strip() + f""", s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {order}) AS n FROM steps),
      walk AS (
        SELECT run, n, event_id, CASE WHEN success THEN 0 ELSE 1 END AS failures, CASE WHEN success THEN 0 ELSE 1 END AS same_error,
               CASE WHEN NOT success AND tool_name IS NOT NULL THEN 1 ELSE 0 END AS same_tool, CASE WHEN NOT success THEN error_code END AS le,
               CASE WHEN NOT success THEN tool_name END AS lt, success, tool_name FROM s WHERE n = 1
        UNION ALL
        SELECT s.run, s.n, s.event_id, CASE WHEN s.success THEN 0 ELSE w.failures + 1 END,
               CASE WHEN s.success THEN 0 WHEN s.error_code = w.le THEN w.same_error + 1 ELSE 1 END,
               CASE WHEN s.success THEN 0 WHEN s.tool_name IS NULL THEN w.same_tool WHEN s.tool_name = w.lt THEN w.same_tool + 1 ELSE 1 END,
               CASE WHEN s.success THEN w.le ELSE s.error_code END, CASE WHEN s.success OR s.tool_name IS NULL THEN w.lt ELSE s.tool_name END, s.success, s.tool_name
        FROM walk w JOIN s ON s.run = w.run AND s.n = w.n + 1)
    """


TRIPPED = "NOT success AND (failures >= 3 OR same_error >= 2 OR (tool_name IS NOT NULL AND same_tool >= 2))"
STREAKS = "CAST(failures AS BIGINT) AS failures, CAST(same_error AS BIGINT) AS same_error, CAST(same_tool AS BIGINT) AS same_tool"


@register("failure_streaks", sql_walk("ts, event_id") + f" SELECT event_id, {STREAKS}, {TRIPPED} AS tripped FROM walk")
def failure_streaks(spark, sf):
    rows = rn.failure_streaks(steps(spark, sf), "run", ["ts", "event_id"], block=DAY())
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("event_id", big("failures"), big("same_error"), big("same_tool"), "tripped")


@register(
    "run_budget",
    "WITH " + SQL_STEPS.strip()
    + """, s AS (SELECT *, row_number() OVER w AS n, coalesce(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          sum(CASE WHEN success THEN event_id % 3000 ELSE 0 END) OVER w AS tok, round(sum(CASE WHEN success THEN value ELSE 0 END) OVER w, 6) AS cost,
          sum(CASE WHEN success THEN event_id % 7000 ELSE 0 END) OVER w AS ms FROM steps WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
      SELECT run, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS steps_done, min(CASE WHEN before >= 10 THEN n END) AS steps_exceeded_at,
        min(CASE WHEN tok > 32000 THEN n END) AS tokens_exceeded_at, min(CASE WHEN cost > 250.0 THEN n END) AS cost_exceeded_at, min(CASE WHEN ms > 120000 THEN n END) AS time_exceeded_at
      FROM s GROUP BY 1""",
)
def run_budget(spark, sf):
    rows = steps(spark, sf).withColumns(
        {"tokens": F.col("event_id") % 3000, "cost_usd": F.col("value"), "elapsed_ms": F.col("event_id") % 7000}
    )
    budget = {**fx.RUN_BUDGETS["production"], "max_cost_usd": 250.0}
    return rn.run_budget(rows, "run", ["ts", "event_id"], budget, block=DAY())


_STATES = {"signup": "context_ready", "view": "plan_ready", "click": "step_running", "purchase": "step_done", "error": "failed"}


@register(
    "transition_conformance",
    "WITH m(event_type, state) AS (VALUES " + ",".join(f"('{k}','{v}')" for k, v in _STATES.items()) + "), al(f, t) AS (VALUES "
    + ",".join(f"('{a}','{t}')" for a, ts in fx.ALLOWED_TRANSITIONS.items() for t in ts)
    + """), s AS (SELECT event_id, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'init') AS from_state, state AS to_state FROM events JOIN m USING (event_type))
      SELECT event_id, from_state, to_state, al.f IS NOT NULL OR to_state IN ('loop_complete', 'budget_exceeded', 'cancelled', 'failed') AS allowed
      FROM s LEFT JOIN al ON f = from_state AND t = to_state""",
)
def transition_conformance(spark, sf):
    from folioframe.functions import text as tx

    states = b.table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("run"), tx.lookup(_STATES, F.col("event_type")).alias("state")
    )
    rows = rn.transition_check(states, "run", ["ts", "event_id"], block=DAY())
    return rows.select("event_id", "from_state", "to_state", "allowed")


_SEV = ("debug", "info", "warning", "error", "critical")


@register(
    "retention",
    f"""SELECT event_id FROM (SELECT event_id, ts, {_sql_pick('user_id', *_SEV)} AS s FROM events)
        WHERE ts >= TIMESTAMP '2024-04-20 00:00:00' - to_days(CASE s WHEN 'debug' THEN 14 WHEN 'info' THEN 90 WHEN 'warning' THEN 180 ELSE 365 END)""",
)
def retention(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", F.col("ts").alias("occurred_at"), _pick("user_id", *_SEV).alias("severity"))
    return rn.retained(rows, F.lit("2024-04-20 00:00:00").cast("timestamp")).select("event_id")


@register(
    "payload_conformance",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE 'url' END WHEN event_type = 'purchase' THEN 'amount' ELSE '' END AS missing,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'url' ELSE '' END AS forbidden_present,
         CASE event_type WHEN 'click' THEN event_id % 2 = 0 WHEN 'view' THEN event_id % 2 = 0 WHEN 'error' THEN event_id % 2 <> 0 ELSE false END AS conforms FROM events""",
)
def payload_conformance(spark, sf):
    catalog = spark.createDataFrame(
        [("click", ["k", "url"], []), ("view", ["url"], []), ("purchase", ["k", "amount"], []), ("error", ["k"], ["url"])],
        "event_type string, required array<string>, forbidden array<string>",
    )
    props = F.from_json("props", "map<string,string>")
    extra = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("url"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = b.table(spark, sf, "events").select("event_id", "event_type", F.map_concat(props, extra).alias("payload"))
    out = rn.payload_conformance(rows, catalog)
    return out.select(
        "event_id", F.array_join("missing", ",").alias("missing"), F.array_join("forbidden_present", ",").alias("forbidden_present"), "conforms"
    )


@register(
    "judge",
    "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND (role = 'user' OR turn % 3 > 0) AS passed FROM conversations",
)
def judge(spark, sf):
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", rn.judge(F.col("text"), F.col("turn") % 3, F.col("role") != "user").alias("passed")
    )


@register(
    "error_summary",
    """SELECT CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE 'E' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) END AS type, count(*) AS n
       FROM events WHERE event_type = 'error' GROUP BY 1""",
)
def error_summary(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    msg = F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.concat(F.lit("E"), k, F.lit(": value "), F.col("value")))
    return rp.error_summary(b.table(spark, sf, "events").where("event_type = 'error'").select(msg.alias("error")))


@register("audit_counts", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def audit_counts(spark, sf):
    from folioframe.streaming import flows

    return flows.audit_counts(b.table(spark, sf, "events"))


@register(
    "feedback_cap",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20""",
)
def feedback_cap(spark, sf):
    from folioframe.operators import dialog as dg

    return dg.latest_events(b.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@register(
    "latest_error_per_run",
    "SELECT user_id AS run, max(event_id) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n = 1 GROUP BY 1",
)
def latest_error_per_run(spark, sf):
    errors = b.table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("run"), "event_id", "ts")
    return ig.latest_per_key(errors, ["run"], ["ts", "event_id"]).select("run", "event_id")
