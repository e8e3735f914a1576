"""Progress, coverage and health reports."""

from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.functions import text as tx
from folioframe.operators import reports as rp
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.retrieval_queries import _STRIP, sql_quality
from folioframe.plans.text_queries import _pick
from folioframe.sources import archive as ar


def _with(*parts):
    return "WITH " + ", ".join(p.strip() for p in parts)


@register(
    "action_counts",
    _with(b.SQL_DOCS)
    + " SELECT CASE WHEN doc_no % 6 = 5 THEN 'skip' WHEN doc_no % 6 = 4 THEN 'catalog_only' ELSE 'ingest_candidate' END AS import_action, count(*) AS files FROM docs GROUP BY 1",
)
def action_counts(spark, sf):
    listing = b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path"))
    return rp.action_counts(ar.manifest_columns(listing))


@register(
    "import_stats",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE doc_id % 8 = {i}) AS {o}" for i, o in enumerate(rp.OUTCOMES)) + " FROM documents",
)
def import_stats(spark, sf):
    return rp.import_stats(b.table(spark, sf, "documents").select(_pick("doc_id", *rp.OUTCOMES).alias("outcome")))


@register("corpus_counts", _with(b.SQL_CHUNKS) + " SELECT corpus_id, count(*) AS chunks FROM chunks GROUP BY 1")
def corpus_counts(spark, sf):
    return rp.corpus_counts(b.chunks(spark, sf))


@register(
    "distinct_files",
    _with(b.SQL_CHUNKS)
    + """ SELECT corpus_id, count(DISTINCT CASE WHEN page % 3 = 0 THEN source_relative_path WHEN page % 3 = 1 THEN 'p/' || source ELSE doc_id END) AS files, count(*) AS chunks FROM chunks GROUP BY 1""",
)
def distinct_files(spark, sf):
    rows = b.chunks(spark, sf).select(
        "corpus_id", "doc_id",
        F.when(F.col("page") % 3 == 1, F.concat(F.lit("p/"), "source")).otherwise("").alias("doc_path"),
        F.create_map(F.lit("source_relative_path"), F.when(F.col("page") % 3 == 0, F.col("source_relative_path")).otherwise("")).alias("metadata"),
    )
    return rp.distinct_files(rows)


@register(
    "ingest_yield",
    """SELECT source, imported, live AS live_scanned, total AS total_candidates, greatest(total - live, 0) AS pending_scan,
         CASE WHEN live > 0 THEN round(100.0::DOUBLE * imported / live, 1) END AS import_yield_pct
       FROM (SELECT source, count(*) FILTER (WHERE lang = 'en') AS imported, count(*) FILTER (WHERE lang <> 'fr') AS live, count(*) AS total FROM documents GROUP BY 1)""",
)
def ingest_yield(spark, sf):
    stats = b.table(spark, sf, "documents").groupBy("source").agg(
        F.count_if(F.col("lang") == "en").alias("imported"), F.count_if(F.col("lang") != "fr").alias("live_scanned"), F.count("*").alias("total_candidates")
    )
    return rp.ingest_yield(stats)


_PROGRESS = """
st AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS processed, max(event_id) % 300 AS hb, count(*) + user_id % 3 AS total, min(ts) AS started FROM events GROUP BY 1),
pg AS (SELECT *, greatest(processed, hb) AS live FROM st)
"""


@register(
    "progress_report",
    _with(_PROGRESS)
    + """ SELECT user_id, live AS live_progress, CASE WHEN total > 0 THEN round(live * 100.0::DOUBLE / total, 1) ELSE 0.0 END AS percent, live >= total AS complete,
         CASE WHEN live >= total THEN 0.0 ELSE round((total - live) / (live / (epoch_us(TIMESTAMP '2024-02-01') / 1e6::DOUBLE - epoch_us(started) / 1e6::DOUBLE) * 3600.0::DOUBLE) * 3600.0::DOUBLE / 3600.0::DOUBLE, 1) END AS eta_hours FROM pg""",
)
def progress_report(spark, sf):
    events = b.table(spark, sf, "events")
    state = events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("processed"),
        (F.max("event_id") % 300).alias("heartbeat_index"),
        (F.count("*") + F.col("user_id") % 3).alias("total"),
        F.min("ts").alias("started_at"),
    )
    rows = rp.progress_report(state, F.lit("2024-02-01").cast("timestamp"))
    return rows.select("user_id", "live_progress", "percent", "complete", "eta_hours")


@register(
    "progress_log_rate",
    """WITH e AS (SELECT user_id, count(*) AS points, min(ts) AS t0, max(ts) AS t1, arg_min(event_id, ts) AS p0, arg_max(event_id, ts) AS p1, arg_max(event_id, ts) + 1000 AS total FROM events GROUP BY 1),
        r AS (SELECT *, (epoch_us(t1) - epoch_us(t0)) / 3.6e9::DOUBLE AS h FROM e), q AS (SELECT *, CASE WHEN p1 > p0 AND h > 0 THEN (p1 - p0) / h END AS rate FROM r)
       SELECT user_id, points, p1 - p0 AS progress_delta, round(rate, 1) AS rate_per_hour,
         CASE WHEN points >= 2 AND rate IS NOT NULL THEN round(greatest(total - (p1 + rate * greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t1)) / 3.6e9::DOUBLE, 0.0)), 0.0) / rate, 2) END AS eta_hours_from_log FROM q""",
)
def progress_log_rate(spark, sf):
    log = b.table(spark, sf, "events").select(
        "user_id", F.col("ts").alias("recorded_at"), F.col("event_id").alias("live_progress"), (F.col("event_id") + 1000).alias("total")
    )
    return rp.progress_log_rate(log, F.lit("2024-02-01").cast("timestamp"), ["user_id"])


@register(
    "milestones",
    """WITH p AS (SELECT source, round(count(*) FILTER (WHERE lang = 'en') * 100.0::DOUBLE / count(*), 1) AS pct, max(CAST(substr(source, 4) AS INT)) % 2 = 0 AS done25 FROM documents GROUP BY 1)
       SELECT source, pct AS percent, CASE WHEN pct >= 25 AND NOT done25 THEN 25 WHEN pct >= 50 THEN 50 WHEN pct >= 75 THEN 75 WHEN pct >= 100 THEN 100 END AS ready,
         CASE WHEN pct < 25 THEN 25 WHEN pct < 50 THEN 50 WHEN pct < 75 THEN 75 WHEN pct < 100 THEN 100 END AS next,
         CASE WHEN pct >= 75 THEN 75 END AS snapshot_ready FROM p""",
)
def milestones(spark, sf):
    rows = b.table(spark, sf, "documents").groupBy("source").agg(
        F.round(F.count_if(F.col("lang") == "en") * 100.0 / F.count("*"), 1).alias("percent")
    )
    even = F.substring("source", 4, 9).cast("int") % 2 == 0
    done = F.when(even, F.array(F.lit(25))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    out = rows.select(
        "source", "percent", rp.milestones(F.col("percent"), done).alias("m"),
        rp.milestones(F.col("percent"), none, fx.SNAPSHOT_THRESHOLDS)["ready"].alias("snapshot_ready"),
    )
    return out.select("source", "percent", "m.ready", "m.next", "snapshot_ready")


@register(
    "finalize_checks",
    """WITH c AS (SELECT lang, 'has_text' AS name, min(n_chars) > 0 AS passed, true AS blocking FROM documents GROUP BY 1
          UNION ALL SELECT lang, 'labelled', count(l.doc_id) = count(*), false FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
          UNION ALL SELECT lang, 'no_long', max(n_chars) < 14000, true FROM documents GROUP BY 1)
       SELECT lang, bool_and(passed OR NOT blocking) AS verified, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed FROM c GROUP BY 1""",
)
def finalize_checks(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    agg = docs.groupBy("lang").agg(
        (F.min("n_chars") > 0).alias("has_text"), (F.count("known") == F.count("*")).alias("labelled"), (F.max("n_chars") < 14000).alias("no_long")
    )
    rows = agg.unpivot("lang", ["has_text", "labelled", "no_long"], "name", "passed")
    return rp.overall_checks(rows.withColumn("blocking", F.col("name") != "labelled"), ["lang"])


@register(
    "loaded_vs_chunks",
    _with(b.SQL_CHUNKS)
    + """ SELECT 'loaded_vs_chunks' AS name, (SELECT count(*) FROM chunks WHERE doc_no IN (SELECT doc_id FROM labels)) AS loaded, count(DISTINCT chunk_id) AS expected,
          (SELECT count(*) FROM chunks WHERE doc_no IN (SELECT doc_id FROM labels)) >= count(DISTINCT chunk_id) AS passed, false AS blocking FROM chunks""",
)
def loaded_vs_chunks(spark, sf):
    chunks = b.chunks(spark, sf).select("chunk_id", "doc_no")
    loaded = chunks.join(b.table(spark, sf, "labels").select(F.col("doc_id").alias("doc_no")), "doc_no", "left_semi")
    return rp.load_check(loaded, chunks)


@register(
    "index_phase",
    """SELECT doc_id, phase, CASE WHEN phase = 'post_finalize' THEN 'checklist' WHEN phase = 'reindexing' THEN 'watch' WHEN lang = 'en' THEN 'finalize' ELSE 'wait_for_services' END AS next_step
       FROM (SELECT d.doc_id, lang, CASE WHEN toxic = 1 THEN 'post_finalize' WHEN quality = 1 THEN 'ready_for_finalize' WHEN l.doc_id IS NOT NULL THEN 'reindex_complete_lock' ELSE 'reindexing' END AS phase
             FROM documents d LEFT JOIN labels l USING (doc_id))""",
)
def index_phase(spark, sf):
    rows = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    phase = rp.index_phase(known, F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return rows.select("doc_id", phase.alias("phase"), rp.next_step(phase, F.col("lang") == "en").alias("next_step"))


@register(
    "extraction_metrics",
    """SELECT lang AS provider, count(*) AS documents, round(avg(CASE WHEN doc_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS fallback_rate,
         round(avg(CASE WHEN n_chars < 500 AND n_chars >= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS partial_rate, round(avg(CASE WHEN n_chars < 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS error_rate,
         round(avg(n_chars), 3) AS avg_duration_ms FROM documents GROUP BY 1""",
)
def extraction_metrics(spark, sf):
    n = F.col("n_chars")
    rows = b.table(spark, sf, "documents").select(
        F.col("lang").alias("provider"), (F.col("doc_id") % 7 == 0).alias("fallback_used"),
        F.when(n < 100, "failed").when(n < 500, "partial").otherwise("ok").alias("ocr_status"), n.alias("duration_ms"),
    )
    return rp.extraction_metrics(rows)


@register(
    "extraction_fallback",
    f"""SELECT doc_id, CASE WHEN n_chars < 60 THEN 'primary_error' WHEN q < 0.65 THEN 'low_confidence' WHEN doc_id % 3 > 1 AND n_chars < 900 THEN 'empty_text' END AS reason
        FROM (SELECT doc_id, n_chars, {sql_quality('t')} AS q FROM (SELECT *, {_STRIP.format('text')} AS t FROM documents))""",
)
def extraction_fallback(spark, sf):
    n = F.col("n_chars")
    status = F.when(n < 60, "failed").otherwise("ok")
    reason = rp.extraction_fallback(status, tx.text_quality(F.col("text"), b.LATIN), F.col("doc_id") % 3, F.when(n < 900, 0).otherwise(n))
    return b.table(spark, sf, "documents").select("doc_id", reason.alias("reason"))


@register(
    "extractor_compare",
    "SELECT round(avg(n_chars) FILTER (WHERE lang = 'en'), 1) AS en, round(avg(n_chars) FILTER (WHERE lang = 'de'), 1) AS de, round(avg(n_chars) FILTER (WHERE lang = 'fr'), 1) AS fr FROM documents WHERE n_chars > 100",
)
def extractor_compare(spark, sf):
    rows = b.table(spark, sf, "documents").select(
        F.col("lang").alias("extractor"), F.col("n_chars").alias("chars"), F.when(F.col("n_chars") > 100, "ok").otherwise("skip").alias("status")
    )
    return rp.compare_extractors(rows, ["en", "de", "fr"])


@register(
    "load_rate",
    """SELECT source, n AS "offset", total, CAST(m AS DOUBLE) AS elapsed_min, CASE WHEN total > 0 THEN round(n * 100.0::DOUBLE / total, 1) ELSE 0.0 END AS percent, greatest(total - n, 0) AS remaining,
         round(CASE WHEN m > 0 THEN n / CAST(m AS DOUBLE) END, 3) AS rate_per_min, round(CASE WHEN m > 0 AND n > 0 THEN greatest(total - n, 0) / (n / CAST(m AS DOUBLE)) END, 2) AS eta_min
       FROM (SELECT source, count(*) FILTER (WHERE lang = 'en') AS n, count(*) AS total, CAST(substr(source, 4) AS INT) AS m FROM documents GROUP BY 1, 4)""",
)
def load_rate(spark, sf):
    state = b.table(spark, sf, "documents").groupBy("source").agg(
        F.count_if(F.col("lang") == "en").alias("offset"), F.count("*").alias("total"), F.substring("source", 4, 9).cast("double").alias("elapsed_min")
    )
    return rp.load_rate(state)


@register(
    "folder_file_counts",
    _with(b.SQL_DOCS) + " SELECT 'archive/' || source || '/' || lang AS folder, count(*) AS files FROM docs GROUP BY 1",
)
def folder_file_counts(spark, sf):
    return rp.folder_file_counts(b.documents(spark, sf).select(F.col("source_relative_path").alias("relative_path")))


@register(
    "low_text_coverage",
    _with(b.SQL_CHUNKS)
    + f""", q AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN {sql_quality('t')} > 0.35 THEN 1 ELSE 0 END) AS good FROM (SELECT doc_id, {_STRIP.format('content')} AS t FROM chunks) GROUP BY 1)
       SELECT d.doc_id, coalesce(n, 0) AS chunks, CASE WHEN n IS NULL THEN 'no_text' WHEN good = 0 THEN 'low_text' END AS hint FROM docs d LEFT JOIN q USING (doc_id)""",
)
def low_text_coverage(spark, sf):
    return rp.text_coverage(b.chunks(spark, sf), b.documents(spark, sf), b.LATIN)


@register(
    "index_percent",
    _with(b.SQL_CHUNKS) + " SELECT count(*) AS chunks, round(count(*) * 100.0::DOUBLE / 100804, 3) AS percent FROM chunks",
)
def index_percent(spark, sf):
    n = F.count("*")
    return b.chunks(spark, sf).agg(n.alias("chunks"), F.round(n * 100.0 / 100804, 3).alias("percent"))


