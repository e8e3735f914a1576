"""Chunking, row preparation and citations."""

from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import chunking as ch
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.retrieval_queries import _STRIP


def _with(*parts):
    return "WITH " + ", ".join(p.strip() for p in parts)


@register(
    "chunk_windows",
    _with(b.SQL_CHUNKS)
    + " SELECT doc_no, CAST(page AS BIGINT) AS idx, start_offset, end_offset, md5(content) AS content_md5 FROM chunks",
)
def chunk_windows(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_no"), "text")
    rows = ch.chunk_windows(docs)
    return rows.select("doc_no", F.col("idx").cast("bigint").alias("idx"), "start_offset", "end_offset", F.md5("content").alias("content_md5"))


@register(
    "build_chunks",
    _with(b.SQL_CHUNKS)
    + " SELECT chunk_id, doc_id, page, department_id, folder_id, classification, start_offset, end_offset, content FROM chunks",
)
def build_chunks(spark, sf):
    return b.chunks(spark, sf).select(
        "chunk_id", "doc_id", "page", "department_id", "folder_id", "classification", "start_offset", "end_offset", "content"
    )


@register(
    "context_pieces",
    f"""WITH d AS (SELECT doc_id, {_STRIP.format('text')} AS body FROM documents),
        w AS (SELECT doc_id, body, i * 2200 AS s FROM d, unnest(range(0, CASE WHEN length(body) <= 2400 THEN 1
              ELSE CAST(ceil((length(body) - 2400) / 2200.0) AS BIGINT) + 1 END)) t(i) WHERE body <> ''),
        p AS (SELECT doc_id, s, least(length(body), s + 2400) AS e, {_STRIP.format("substr(body, CAST(s + 1 AS BIGINT), 2400)")} AS piece FROM w)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS piece_id, CAST(s AS INT) AS start_offset,
               CAST(e AS INT) AS end_offset, md5(piece) AS piece_md5 FROM p WHERE piece <> ''""",
)
def context_pieces(spark, sf):
    rows = ch.context_pieces(b.table(spark, sf, "documents"), "doc_id")
    return rows.select("doc_id", "piece_id", "start_offset", "end_offset", F.md5("content").alias("piece_md5"))


@register(
    "fixed_blocks",
    f"""WITH w AS (SELECT doc_id, i, {_STRIP.format("substr(text, CAST(i * 1800 + 1 AS BIGINT), 1800)")} AS piece
             FROM documents, unnest(range(0, greatest(CAST(ceil(length(text) / 1800.0) AS BIGINT), 1))) t(i))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_id, md5(piece) AS piece_md5 FROM w WHERE piece <> ''""",
)
def fixed_blocks(spark, sf):
    rows = ch.fixed_blocks(b.table(spark, sf, "documents"), "doc_id")
    return rows.select("doc_id", "block_id", F.md5("content").alias("piece_md5"))


_BASE = f"""
base AS (SELECT CASE WHEN page % 3 = 0 THEN NULL ELSE chunk_id END AS chunk_id, CASE WHEN page % 2 = 0 THEN '' ELSE doc_id END AS doc_id,
         replace(source_relative_path, '/', '\\') AS raw_path, source_relative_path AS rel, {_STRIP.format('content')} AS t, page, corpus_id, classification, department_id FROM chunks)
"""


def _loadable(spark, sf):
    """Chunks with gaps in their ids, back-slash paths and NULs in the text."""
    return b.chunks(spark, sf).select(
        F.when(F.col("page") % 3 != 0, F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("page") % 2 == 0, "").otherwise(F.col("doc_id")).alias("doc_id"),
        F.replace("source_relative_path", F.lit("/"), F.lit("\\")).alias("source_relative_path"),
        F.concat(F.lit("\0"), tx.strip(F.col("content")), F.lit("\0")).alias("content"),
        "page", "company_id", "project_id", "department_id", "classification",
    )


@register(
    "prepare_load_row",
    _with(b.SQL_CHUNKS, _BASE)
    + """ SELECT coalesce(chunk_id, substr(md5(rel || ':' || substr(t, 1, 80)), 1, 16)) AS chunk_id,
            coalesce(nullif(doc_id, ''), regexp_extract(rel, '[^/]*$')) AS doc_id, '/data/' || rel AS doc_path, md5(t) AS content_md5, page,
            'main' AS corpus, rel AS source_path, classification FROM base WHERE length(t) >= 40""",
)
def prepare_load_row(spark, sf):
    rows = ch.prepare_load_rows(_loadable(spark, sf), "/data", "main")
    return rows.select(
        "chunk_id", "doc_id", "doc_path", F.md5("content").alias("content_md5"), "page",
        F.col("metadata")["corpus_id"].alias("corpus"),
        F.col("metadata")["source_relative_path"].alias("source_path"),
        F.col("metadata")["classification"].alias("classification"),
    )


@register(
    "json_safe",
    "SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events",
)
def json_safe(spark, sf):
    nul = lambda c: F.concat(F.lit("\0"), c, F.lit("\0"))
    rows = b.table(spark, sf, "events").select(
        "event_id",
        nul(F.col("event_type")).alias("kind"),
        F.transform_values(F.from_json("props", "map<string,string>"), lambda k, v: nul(v)).alias("props"),
    )
    return ch.json_safe(rows).select("event_id", "kind", F.col("props")["k"].alias("k"))


@register(
    "content_hash",
    "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, 'doc_' || substr(sha256(text), 1, 12) AS hash_doc_id FROM documents",
)
def content_hash(spark, sf):
    h = ch.content_hash(F.col("text"))
    return b.table(spark, sf, "documents").select("doc_id", h.alias("content_hash"), ch.doc_id_from_hash(h).alias("hash_doc_id"))


@register(
    "chunk_content_id",
    _with(b.SQL_CHUNKS)
    + " SELECT chunk_id, 'chunk_' || substr(md5(doc_id || ':' || page || ':' || substr(content, 1, 100)), 1, 12) AS content_id FROM chunks",
)
def chunk_content_id(spark, sf):
    return b.chunks(spark, sf).select(
        "chunk_id", ch.chunk_content_id(F.col("doc_id"), F.col("page"), F.col("content")).alias("content_id")
    )


@register(
    "citation",
    _with(b.SQL_CHUNKS)
    + """ SELECT chunk_id, doc_id, page, start_offset, end_offset, substr(content, 1, 280) AS snippet,
            CASE WHEN doc_no % 5 <> 0 THEN source_relative_path END AS relative_path,
            CASE WHEN doc_no % 5 <> 0 THEN regexp_extract(source_relative_path, '[^/]*$') END AS file_name FROM chunks""",
)
def citation(spark, sf):
    rows = b.chunks(spark, sf).withColumn(
        "source_relative_path", F.when(F.col("doc_no") % 5 != 0, F.col("source_relative_path"))
    )
    return rows.select("chunk_id", ch.citation().alias("c")).select("chunk_id", "c.*")


@register(
    "analysis_citation",
    _with(b.SQL_CHUNKS)
    + """ SELECT chunk_id, doc_id, substr(content, 1, 1200) AS snippet, regexp_extract(source_relative_path, '[^/]*$') AS file_name,
            source_relative_path AS relative_path FROM chunks""",
)
def analysis_citation(spark, sf):
    return b.chunks(spark, sf).select("chunk_id", ch.analysis_citation().alias("c")).select("chunk_id", "c.*")


@register(
    "row_to_chunk",
    _with(b.SQL_CHUNKS)
    + """ SELECT chunk_id, doc_id, 'co_default' AS company_id, 'prj_default' AS project_id,
            CASE WHEN page % 2 = 0 THEN department_id ELSE 'dept_default' END AS department_id, classification, source_relative_path, page,
            regexp_extract(source_relative_path, '[^/]*$') AS file_name FROM chunks""",
)
def row_to_chunk(spark, sf):
    none = F.lit(None).cast("string")
    meta = F.map_from_arrays(
        F.array(F.lit("department_id"), F.lit("classification"), F.lit("company_id")),
        F.array(F.when(F.col("page") % 2 == 0, F.col("department_id")), F.col("classification"), F.lit("")),
    )
    rows = b.chunks(spark, sf).select(
        "chunk_id", "doc_id", F.replace("source_relative_path", F.lit("/"), F.lit("\\")).alias("doc_path"), "content", "page",
        meta.alias("metadata"), none.alias("section"),
    )
    defaults = {"company_id": "co_default", "project_id": "prj_default", "department_id": "dept_default", "classification": "internal"}
    return ch.row_to_chunk(rows, defaults).drop("content")


@register(
    "format_report_task",
    _with(b.SQL_DOCS)
    + """ SELECT doc_id, CASE WHEN length(text) >= 80 THEN CASE doc_no % 6 WHEN 2 THEN 'format_docx_analyze' WHEN 3 THEN 'format_dwg_analyze' ELSE 'format_pdf_analyze' END END AS task FROM docs""",
)
def format_report_task(spark, sf):
    return b.documents(spark, sf).select("doc_id", ch.report_task(F.col("source_relative_path"), F.col("text")).alias("task"))


@register(
    "citation_score_fill",
    """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0.5 END::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
       SELECT conv_id, turn, coalesce(score, round(greatest(0.35::DOUBLE, 0.92::DOUBLE - i * 0.08::DOUBLE), 3)) AS score FROM r""",
)
def citation_score_fill(spark, sf):
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 0.5).alias("score"))
    return ch.fill_citation_scores(rows, ["conv_id"], ["turn"])


@register(
    "template_fill",
    """SELECT o_orderkey, 'Order ' || o_orderkey || ' of {{unknown}}: ' || o_orderpriority || ' (' || o_orderkey || ')' AS body FROM orders""",
)
def template_fill(spark, sf):
    template = F.lit("Order {{key}} of {{unknown}}: {{priority}} ({{key}})")
    fields = F.create_map(F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("priority"), F.col("o_orderpriority"))
    return b.table(spark, sf, "orders").select("o_orderkey", ch.fill_template(template, fields).alias("body"))


@register(
    "chat_samples",
    f"""WITH t AS (SELECT conv_id, turn, role, {_STRIP.format('text')} AS s FROM conversations),
        p AS (SELECT conv_id, turn, role, s AS q, lead(s) OVER (PARTITION BY conv_id ORDER BY turn) AS a,
              coalesce(first_value(CASE WHEN role = 'system' THEN s END) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ctx FROM t)
        SELECT conv_id, turn, CAST(2 + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS n_messages,
          CASE WHEN ctx <> '' THEN 'Контекст:' || chr(10) || substr(ctx, 1, 8000) || chr(10) || chr(10) || 'Вопрос: ' || q ELSE q END AS user_message, a AS answer
        FROM p WHERE a IS NOT NULL AND q <> '' AND a <> ''""",
)
def chat_samples(spark, sf):
    from pyspark.sql import Window

    from folioframe.operators import dialog as dg

    w = Window.partitionBy("conv_id").orderBy("turn")
    body = tx.strip(F.col("text"))
    pairs = b.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        body.alias("question"),
        F.lead(body).over(w).alias("answer"),
        F.first(F.when(F.col("role") == "system", body)).over(w).alias("ctx"),
    )
    system = F.when(F.col("conv_id") % 2 == 0, "Answer from the context.").otherwise("")
    rows = dg.chat_samples(pairs.where("answer is not null"), system, F.col("ctx"))
    user = F.filter("messages", lambda m: m["role"] == "user")[0]["content"]
    return rows.select("conv_id", "turn", F.size("messages").alias("n_messages"), user.alias("user_message"), "answer")
