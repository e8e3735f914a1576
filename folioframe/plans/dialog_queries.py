"""Conversation analytics on the given conversations."""

from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import corrections as co
from folioframe.operators import dialog as dg
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.retrieval_queries import _STRIP


def _turns(spark, sf):
    return b.table(spark, sf, "conversations").withColumnRenamed("text", "content")


@register(
    "last_n_turns",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
)
def last_n_turns(spark, sf):
    return dg.last_turns(_turns(spark, sf), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@register(
    "model_history",
    f"""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(s) > 200 THEN substr(s, 1, 200) || '…' ELSE s END AS content
        FROM (SELECT *, {_STRIP.format('text')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 AND role IN ('user', 'assistant') AND s <> ''""",
)
def model_history(spark, sf):
    rows = dg.model_history(_turns(spark, sf), "conv_id", "turn", keep=5, window=3, max_answer=200)
    return rows.select("conv_id", "turn", "role", "content")


_CITED = """
ct AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 1 THEN list_sort(list_distinct(regexp_extract_all(lower(text), '[а-яёa-z0-9]{9,}')))[1:12] ELSE []::VARCHAR[] END AS ids FROM conversations)
"""


def _cited(spark, sf):
    long_words = F.slice(F.array_distinct(F.array_sort(tx.tokens(F.col("text"), 9))), 1, 12)
    ids = F.when(F.col("turn") % 2 == 1, long_words).otherwise(F.array().cast("array<string>"))
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"), ids.alias("doc_ids"), ids.alias("paths")
    )


@register(
    "active_documents",
    "WITH " + _CITED.strip()
    + """, l AS (SELECT conv_id, arg_max(list_sort(ids), turn) AS ids FROM ct WHERE role = 'assistant' AND len(ids) > 0 GROUP BY 1)
        SELECT s.conv_id, array_to_string(list_sort(l.ids[1:8]), ' ') AS active FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') s LEFT JOIN l USING (conv_id)""",
)
def active_documents(spark, sf):
    """Long words of a turn stand for the documents it cites."""
    rows = dg.active_documents(_cited(spark, sf), "conv_id", "turn")
    return rows.select("conv_id", F.array_join(F.array_sort("active_doc_ids"), " ").alias("active"))


_NOTE = """
nt AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS u, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1),
nn AS (SELECT conv_id, concat_ws(chr(10), CASE WHEN coalesce(u, '') <> '' THEN 'Предыдущий вопрос: ' || substr(u, 1, 300) END,
         CASE WHEN coalesce(a, '') <> '' THEN 'Предыдущий ответ (кратко): ' || substr(a, 1, 400) END) AS note FROM nt)
"""


@register("last_user_assistant", "WITH " + _NOTE.strip() + " SELECT conv_id, note FROM nn")
def last_user_assistant(spark, sf):
    return dg.memory_notes(_turns(spark, sf), "conv_id", "turn")


@register(
    "session_query",
    "WITH " + _NOTE.strip()
    + """, q AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'подробнее' ELSE 'Новый вопрос по документу номер 12345' END AS q FROM (SELECT DISTINCT conv_id FROM conversations))
        SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND note <> '' THEN q || chr(10) || chr(10) || '[Контекст диалога]' || chr(10) || note ELSE q END AS query FROM q JOIN nn USING (conv_id)""",
)
def session_query(spark, sf):
    notes = dg.memory_notes(_turns(spark, sf), "conv_id", "turn")
    q = F.when(F.col("conv_id") % 2 == 0, "подробнее").otherwise("Новый вопрос по документу номер 12345")
    return notes.select("conv_id", dg.session_query(q, F.col("note")).alias("query"))




@register(
    "correction_rule_counts",
    """SELECT 'oldword' AS wrong, 'newword' AS replacement, count(*) AS count FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''
       UNION ALL SELECT 'tail1', 'tail2', count(*) FROM conversations WHERE conv_id % 2 = 0 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""",
)
def correction_rule_counts(spark, sf):
    """Each turn is taken as recognised with a wrong first (and sometimes last) word."""
    even = F.col("conv_id") % 2 == 0
    rows = b.table(spark, sf, "conversations").where(tx.squeeze(F.col("text")) != "").select(
        F.concat(F.lit("oldword "), "text", F.when(even, " tail1").otherwise("")).alias("raw_text"),
        F.concat(F.lit("newword "), "text", F.when(even, " tail2").otherwise("")).alias("corrected_text"),
    )
    return co.rule_counts(co.mine_pairs(rows))


@register(
    "learned_corrections",
    "SELECT item_id, trim(regexp_replace('New Word ' || replace(text, ' the ', ' THE '), '\\s+', ' ', 'g')) AS text FROM benchmark",
)
def learned_corrections(spark, sf):
    rows = b.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("old  word "), F.replace("text", F.lit(" the "), F.lit(" zzthe "))).alias("text"))
    return co.apply_rules(rows, [("old word", "New Word"), ("zzthe", "THE")])


@register(
    "latest_feedback",
    f"""SELECT event_id, feedback, previous FROM (SELECT conv_id * 1000 + turn AS event_id, {_STRIP.format('text')} AS feedback, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous
        FROM conversations) WHERE feedback <> ''""",
)
def latest_feedback(spark, sf):
    from pyspark.sql import Window

    key = F.col("conv_id") * 1000 + F.col("turn")
    rows = b.table(spark, sf, "conversations").select(
        key.alias("event_id"), key.alias("at"), F.col("text").alias("feedback"),
        F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous_answer"),
    )
    return co.latest_feedback(rows).select("event_id", "feedback", F.col("previous_answer").alias("previous"))
