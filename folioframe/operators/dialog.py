"""Conversation analytics and chat-sample assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as tx


def last_turns(turns: DataFrame, session: str, order: str, n: int = 24) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def model_history(
    turns: DataFrame, session: str, order: str, keep: int = 24, window: int = 8, max_answer: int = 1200
) -> DataFrame:
    """The turns sent to a model: the last few, spoken ones, long answers cut."""
    recent = last_turns(last_turns(turns, session, order, keep), session, order, window)
    body = tx.strip(F.coalesce("content", F.lit("")))
    cut = F.when(
        (F.col("role") == "assistant") & (F.length(body) > max_answer),
        F.concat(F.substring(body, 1, max_answer), F.lit("…")),
    ).otherwise(body)
    return recent.where(F.col("role").isin("user", "assistant") & (body != "")).withColumn("content", cut)


def active_documents(turns: DataFrame, session: str, order: str, limit: int = 8) -> DataFrame:
    """Ordered distinct documents of the last assistant turn that cites any."""
    cited = turns.where(F.col("role") == "assistant")
    latest = lambda c: F.max_by(F.when(F.size(c) > 0, F.col(c)), F.when(F.size(c) > 0, F.col(order)))
    distinct = lambda c: F.slice(F.array_distinct(latest(c)), 1, limit)
    return cited.groupBy(session).agg(
        distinct("doc_ids").alias("active_doc_ids"), distinct("paths").alias("active_paths")
    )


def memory_notes(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Note from the latest user and assistant turns (and the active paths when given)."""
    latest = lambda role: F.max_by(
        F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col(order))
    )
    last = turns.groupBy(session).agg(latest("user").alias("last_user"), latest("assistant").alias("last_assistant"))
    user = F.when(
        F.coalesce("last_user", F.lit("")) != "",
        F.concat(F.lit("Предыдущий вопрос: "), F.substring("last_user", 1, 300)),
    )
    answer = F.when(
        F.coalesce("last_assistant", F.lit("")) != "",
        F.concat(F.lit("Предыдущий ответ (кратко): "), F.substring("last_assistant", 1, 400)),
    )
    if "active_paths" in turns.columns:
        paths = turns.groupBy(session).agg(F.max_by("active_paths", order).alias("_p"))
        shown = F.when(
            F.size("_p") > 0,
            F.concat(F.lit("Активные документы: "), F.array_join(F.slice("_p", 1, 4), "; ")),
        )
        return last.join(paths, session, "left").select(session, F.concat_ws("\n", shown, user, answer).alias("note"))
    return last.select(session, F.concat_ws("\n", user, answer).alias("note"))


def session_query(query: Column, note: Column) -> Column:
    """A follow-up question carries the memory note."""
    extended = F.concat(query, F.lit("\n\n[Контекст диалога]\n"), note)
    return F.when(tx.is_follow_up(query) & (F.coalesce(note, F.lit("")) != ""), extended).otherwise(query)


def chat_samples(pairs: DataFrame, system: Column, context: Column, max_context: int = 8000) -> DataFrame:
    """(system?, user with context, assistant) messages of each question/answer pair."""
    ctx = F.substring(F.coalesce(context, F.lit("")), 1, max_context)
    user = F.when(
        ctx != "", F.concat(F.lit("Контекст:\n"), ctx, F.lit("\n\nВопрос: "), F.col("question"))
    ).otherwise(F.col("question"))
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.filter(
        F.array(msg("system", system), msg("user", user), msg("assistant", F.col("answer"))),
        lambda m: (m["role"] != "system") | (F.coalesce(m["content"], F.lit("")) != ""),
    )
    return pairs.where((F.col("question") != "") & (F.col("answer") != "")).withColumns(
        {"context": ctx, "messages": messages}
    )


def latest_events(events: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` events of each group."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
