"""Retrieval quality, question suites and lessons.

Results are the BM25 top five of every benchmark passage; the expected keyword is
the longest word of the passage.
"""

from pyspark.sql import functions as F

from folioframe.functions import scoring as sc
from folioframe.functions import text as tx
from folioframe.operators import evaluation as ev
from folioframe.operators import retrieval as rt
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.retrieval_queries import BM25, MATCHES, OPEN_ASKS, REQUIRED, T2, _rank
from folioframe.session import reuse
from folioframe.plans.text_queries import _INTENT_HEADS, _INTENTS, _pick, _sql_pick


def _with(*parts):
    return "WITH " + ", ".join(p.strip() for p in parts)


_RESULTS = f"""
top AS (SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0) WHERE rank <= 5),
res AS (SELECT trace_id, rank, score, doc_id, source_relative_path AS relative_path, regexp_extract(source_relative_path, '[^/]*$') AS file_name,
          substr(content, 1, 280) AS snippet FROM top JOIN chunks USING (chunk_id)),
qw AS (SELECT trace_id, unnest(regexp_extract_all(lower(q), '{T2}')) AS w FROM asks),
qs AS (SELECT trace_id, max(lpad(CAST(length(w) AS VARCHAR), 4, '0') || w)[5:] AS kw FROM qw GROUP BY 1),
qrels AS (SELECT a.trace_id, kw, CASE WHEN CAST(a.trace_id AS BIGINT) % 3 = 0 THEN '/en/' END AS path, CASE WHEN CAST(a.trace_id AS BIGINT) % 2 = 0 THEN a.trace_id END AS digits
          FROM asks a JOIN qs USING (trace_id)),
hay AS (SELECT r.*, lower(file_name || ' ' || relative_path || ' ' || snippet || ' ' || doc_id) AS h, file_name || ' ' || relative_path || ' ' || doc_id AS nm FROM res r),
ranks AS (SELECT q.trace_id, coalesce(min(CASE WHEN contains(h, kw) THEN rank END), 0) AS rank, count(h.trace_id) AS citations FROM qrels q LEFT JOIN hay h USING (trace_id) GROUP BY 1)
"""
_SQL = _with(b.SQL_CHUNKS, OPEN_ASKS, BM25, _RESULTS)
_NUM = "regexp_matches(nm, '(№|#|^|[^a-zA-Z0-9_])' || digits || '([^a-zA-Z0-9]|$)')"


def results(spark, sf, k=5):
    asks, scopes = b.open_requests(spark, sf)
    index = b.index(spark, sf)
    top = reuse(rt.bm25(asks, index, scopes, pool=k))  # few rows: the texts are not shuffled for them
    return rt.with_texts(top, index).select(
        *top.columns, "doc_id", F.col("source_relative_path").alias("relative_path"),
        tx.base_name(F.col("source_relative_path")).alias("file_name"), F.substring("content", 1, 280).alias("snippet"),
    )


def questions(spark, sf):
    asks, _ = b.open_requests(spark, sf)
    longest = F.array_max(F.transform(tx.tokens(F.col("query")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    n = F.col("trace_id").cast("bigint")
    none = F.array().cast("array<string>")
    return asks.select(
        "trace_id",
        F.array(longest).alias("expect_any"),
        F.when(n % 3 == 0, "/en/").otherwise("").alias("expect_path"),
        F.when(n % 2 == 0, F.array("trace_id")).otherwise(none).alias("expect_digits"),
    )


@register(
    "hit_at_k_by_query",
    _SQL + " SELECT trace_id, CAST(rank AS INT) AS rank, rank > 0 AS hit, round(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END, 6) AS rr, citations FROM ranks",
)
def hit_at_k_by_query(spark, sf):
    return ev.query_ranks(questions(spark, sf), results(spark, sf), 5).withColumn("rr", F.round("rr", 6))


@register(
    "hit_at_k",
    _SQL + """ SELECT count(*) AS questions, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS hit_at_k,
        round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 3) AS mrr FROM ranks""",
)
def hit_at_k(spark, sf):
    return ev.hit_and_mrr(ev.query_ranks(questions(spark, sf), results(spark, sf), 5))


@register(
    "strict_at_1",
    _SQL + f" SELECT q.trace_id, nm IS NULL OR digits IS NULL OR {_NUM} AS strict_hit FROM qrels q LEFT JOIN hay h ON h.trace_id = q.trace_id AND h.rank = 1",
)
def strict_at_1(spark, sf):
    return ev.strict_at_1(questions(spark, sf), results(spark, sf))


_REASONS = f"""
ag AS (SELECT q.trace_id, any_value(digits) AS digits, any_value(path) AS path, bool_or(contains(h, kw)) AS k, bool_or(contains(h, path)) AS p, bool_or(h.rank = 1 AND {_NUM}) AS d
       FROM qrels q LEFT JOIN hay h USING (trace_id) GROUP BY 1),
rs AS (SELECT trace_id, CASE WHEN k IS NULL THEN 'no_citations' WHEN NOT k THEN 'no_keyword' WHEN path IS NOT NULL AND NOT p THEN 'no_path'
         WHEN digits IS NOT NULL AND NOT d THEN 'no_number' ELSE 'ok' END AS reason FROM ag)
"""


@register("citation_match_reason", _SQL + ", " + _REASONS.strip() + " SELECT trace_id, reason = 'ok' AS passed, reason FROM rs")
def citation_match_reason(spark, sf):
    return ev.match_reason(questions(spark, sf), results(spark, sf))


@register(
    "eval_pass_fail",
    _SQL + ", " + _REASONS.strip() + " SELECT count(*) FILTER (WHERE reason = 'ok') AS passed, count(*) FILTER (WHERE reason <> 'ok') AS failed, count(*) AS total FROM rs",
)
def eval_pass_fail(spark, sf):
    return ev.pass_fail(ev.match_reason(questions(spark, sf), results(spark, sf)))


@register(
    "variant_compare",
    _with(b.SQL_CHUNKS, OPEN_ASKS, REQUIRED, MATCHES, BM25)
    + f""", t1 AS (SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM bm WHERE score > 0) WHERE rank <= 3),
       t2 AS (SELECT * FROM (SELECT trace_id, chunk_id, score, {_rank()} AS rank FROM hits WHERE score > 0) WHERE rank <= 3)
       SELECT trace_id, count(*) FILTER (WHERE v = 1) AS bm25_hits, count(*) FILTER (WHERE v = 2) AS keyword_hits,
         coalesce(round(avg(score) FILTER (WHERE v = 1), 4), 0.0) AS bm25_score, coalesce(round(avg(score) FILTER (WHERE v = 2), 4), 0.0) AS keyword_score
       FROM (SELECT *, 1 AS v FROM t1 UNION ALL SELECT *, 2 FROM t2) GROUP BY 1""",
)
def variant_compare(spark, sf):
    asks, scopes = b.open_requests(spark, sf)
    cols = ["trace_id", "rank", "score"]
    first = rt.bm25(asks, b.index(spark, sf), scopes, pool=3).select(*cols, F.lit("bm25").alias("variant"))
    second = rt.top_matches(asks, b.index(spark, sf), scopes, 3).select(*cols, F.lit("keyword").alias("variant"))
    return ev.compare_variants(first.unionByName(second), ["bm25", "keyword"])


@register(
    "quality_trend",
    """SELECT source AS snapshot, CASE WHEN count(doc_id) = 0 THEN NULL ELSE round(coalesce(avg(CASE WHEN n_chars % 4 > 0 THEN n_chars / 1000.0::DOUBLE END), 0.0), 4) END AS avg_score FROM documents GROUP BY 1""",
)
def quality_trend(spark, sf):
    rows = b.table(spark, sf, "documents").select(
        F.col("source").alias("snapshot"), F.col("doc_id").alias("query"), (F.col("n_chars") % 4).alias("hits"), (F.col("n_chars") / 1000.0).alias("avg_score")
    )
    return ev.quality_trend(rows, "snapshot")


@register(
    "intent_benchmark",
    f"SELECT count(*) FILTER (WHERE {_sql_pick('item_id', *_INTENTS)} = {_sql_pick('item_id % 5', 'open', 'summarize', 'analyze', 'summarize', 'qa')} AND item_id % 4 > 0) AS passed, count(*) AS total FROM benchmark",
)
def intent_benchmark(spark, sf):
    q = F.concat(_pick("item_id", *_INTENT_HEADS), F.col("text"))
    expected = F.get(F.array(*[F.lit(x) for x in ("open", "summarize", "analyze", "summarize", "qa")]), (F.col("item_id") % 5).cast("int"))
    rows = b.table(spark, sf, "benchmark").select(
        tx.query_intent(q).alias("intent"), expected.alias("expected_intent"), (F.col("item_id") % 4).alias("citation_count")
    )
    return ev.intent_benchmark(rows)


@register(
    "latest_verdict",
    """WITH v AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS verdict FROM events GROUP BY 1)
       SELECT c_custkey AS item_id, CASE WHEN c_custkey = 7 THEN 'current' ELSE coalesce(verdict, 'pending') END AS status FROM customer LEFT JOIN v ON user_id = c_custkey""",
)
def latest_verdict(spark, sf):
    suite = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_custkey").alias("position"))
    verdicts = b.table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("verdict"), F.struct("ts", "event_id").alias("at")
    )
    return ev.suite_status(suite, verdicts, 7)


@register(
    "verdict_stats",
    "SELECT count(*) FILTER (WHERE event_type = 'purchase') AS ok, count(*) FILTER (WHERE event_type = 'view') AS fail, count(*) FILTER (WHERE event_type = 'error') AS err FROM events",
)
def verdict_stats(spark, sf):
    v = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "fail").when(F.col("event_type") == "error", "err")
    return ev.verdict_stats(b.table(spark, sf, "events").select(v.alias("verdict")))


@register(
    "stratified_sample",
    _with(b.SQL_DOCS)
    + """, f AS (SELECT *, regexp_extract(source_relative_path, '[^/]*$') AS file_name, regexp_extract(source_relative_path, '[.][^.]*$') AS ext FROM docs WHERE n_chars >= 100),
       r AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY length(file_name), source_relative_path) AS n FROM f WHERE ext <> '.bak'),
       o AS (SELECT source_relative_path AS relative_path, ext AS extension, file_name, CASE WHEN n = 1 AND ext = '.dwg' THEN 1 WHEN n = 1 AND ext = '.pdf' THEN 2 WHEN n = 1 AND ext = '.txt' THEN 3 ELSE 4 END AS lead FROM r)
       SELECT relative_path, extension FROM o ORDER BY lead, extension, length(file_name), relative_path LIMIT 20""",
)
def stratified_sample(spark, sf):
    from folioframe.sources import archive as ar

    listing = b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path"), F.col("n_chars").alias("size_bytes"))
    rows = ev.stratified_sample(ar.manifest_columns(listing), [".dwg", ".pdf", ".txt"], 20, 100, [".bak"])
    return rows.select("relative_path", "extension")


_HIST = """
att AS (SELECT user_id, event_type AS lesson, ts, event_id, round(value, 2) AS score, value >= 60 AS passed FROM events),
hs AS (SELECT user_id, lesson, least(count(*), 20) AS kept, bool_or(passed) AS completed, arg_max(score, (ts, event_id)) AS last_score FROM att GROUP BY 1, 2)
"""


def _history(spark, sf):
    rows = b.table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("lesson_id"), F.struct("ts", "event_id").alias("at"),
        F.round("value", 2).alias("score"), (F.col("value") >= 60).alias("passed"),
    )
    return ev.attempt_history(rows)


@register("attempt_history", _with(_HIST) + " SELECT user_id, lesson AS lesson_id, kept, completed, last_score FROM hs")
def attempt_history(spark, sf):
    return _history(spark, sf)


@register(
    "learner_progress",
    _with(_HIST) + " SELECT user_id, count(*) FILTER (WHERE completed) AS completed, round(count(*) FILTER (WHERE completed) * 100.0::DOUBLE / 5, 1) AS percent FROM hs GROUP BY 1",
)
def learner_progress(spark, sf):
    return ev.learner_progress(_history(spark, sf), 5)


def _sql_keys(text, keys):
    return f"""len(list_filter({keys}, lambda k: contains(lower({text}), k) OR len(list_filter(list_distinct(regexp_extract_all(lower({text}), '{T2}')), lambda t: contains(t, k) OR contains(k, t))) > 0))"""


@register(
    "evaluate_attempt",
    f"""WITH p AS (SELECT conv_id, turn, text AS a, list_sort(list_distinct(regexp_extract_all(lower(lag(text) OVER w), '{T2}')))[1:6] AS ks, regexp_extract_all(lower(lead(text) OVER w), '{T2}')[1:12] AS rf
             FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        s AS (SELECT *, {_sql_keys('a', 'ks')} AS h, {_sql_keys('a', 'rf')} AS r FROM p WHERE ks IS NOT NULL AND rf IS NOT NULL AND len(ks) > 0 AND len(rf) > 0),
        z AS (SELECT *, h::DOUBLE / len(ks) * 0.7::DOUBLE + r::DOUBLE / len(rf) * 0.3::DOUBLE AS score FROM s)
        SELECT conv_id, turn, round(score, 6) AS score, score >= 0.55 AND h + 0 >= 0 AND
          (SELECT count(*) FROM (SELECT unnest(list_filter(ks, lambda k: contains(lower(a), k) OR len(list_filter(list_distinct(regexp_extract_all(lower(a), '{T2}')), lambda t: contains(t, k) OR contains(k, t))) > 0)) AS x
             UNION SELECT unnest(list_filter(rf, lambda k: contains(lower(a), k) OR len(list_filter(list_distinct(regexp_extract_all(lower(a), '{T2}')), lambda t: contains(t, k) OR contains(k, t))) > 0)) AS x)) >= greatest(1, len(ks) // 2) AS passed
        FROM z""",
)
def evaluate_attempt(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = b.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text",
        F.slice(F.array_sort(F.array_distinct(tx.tokens(F.lag("text").over(w)))), 1, 6).alias("keys"),
        F.lead("text").over(w).alias("reference"), F.lag("text").over(w).alias("before"),
    )
    rows = rows.where("before is not null and reference is not null").where((F.size("keys") > 0) & (F.size(tx.tokens(F.col("reference"))) > 0))
    args = (F.col("text"), F.col("keys"), F.col("reference"))
    return rows.select("conv_id", "turn", F.round(sc.attempt_score(*args), 6).alias("score"), sc.attempt_passed(*args).alias("passed"))


