"""Readers, writers and streams, run on files written from the given tables.

Each query writes whole tables in a source format into the shared folder and reads
them back, so the work grows with the tables.
"""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.plans import bindings as b
from folioframe.plans.registry import register
from folioframe.plans.run_queries import STREAKS, TRIPPED, sql_walk, steps
from folioframe.session import new_folder
from folioframe.sources import archive as ar
from folioframe.sources import tables as tb
from folioframe.streaming import flows


def scratch(spark, name):
    """A new folder beside the checkpoints."""
    return new_folder(spark, name)


_CH = "chunks_json"


@register(
    "read_chunks",
    "WITH " + b.SQL_CHUNKS.strip() + " SELECT chunk_id, doc_id, classification, page, md5(content) AS content_md5 FROM chunks",
)
def read_chunks(spark, sf):
    """One JSON document per source folder: {"chunks": [...]}, and bare lists for half of them."""
    path = scratch(spark, _CH)
    rows = b.chunks(spark, sf).withColumnRenamed("content", "content_preview")
    item = F.struct("chunk_id", "doc_id", "classification", "page", "content_preview")
    docs = rows.groupBy("doc_id").agg(F.collect_list(item).alias("chunks"), F.first("doc_no").alias("n"))
    text = F.when(F.col("n") % 2 == 0, F.to_json(F.struct("chunks"))).otherwise(F.to_json("chunks"))
    docs.select(F.replace(text, F.lit("\n"), F.lit(" ")).alias("value"), (F.col("n") % 500).alias("part")).repartition(
        "part"
    ).drop("part").write.text(path + "/lines")
    # every line is a whole JSON document
    lines = spark.read.text(path + "/lines")
    out = tb.parse_entries(lines, path, "chunks", tb.CHUNK)
    return out.select("chunk_id", "doc_id", "classification", "page", F.md5("content_preview").alias("content_md5"))


@register("read_progress_jsonl", "SELECT count(*) AS points, CAST(max(event_id) AS BIGINT) AS last_progress FROM events")
def read_progress_jsonl(spark, sf):
    path = scratch(spark, "progress")
    rows = b.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_id").alias("live_progress"), F.col("value").alias("percent"),
        F.struct((F.col("event_id") + 1000).alias("total_candidates")).alias("ingest"),
    )
    tb.write_jsonl_dataset(rows, path + "/log")
    log = tb.read_progress_log(spark, path + "/log")
    return log.agg(F.count("*").alias("points"), F.max("live_progress").alias("last_progress"))


@register("jsonl_dataset", "SELECT item_id, text AS question, md5(text) AS answer FROM benchmark")
def jsonl_dataset(spark, sf):
    path = scratch(spark, "qa")
    rows = b.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.md5("text").alias("answer"))
    tb.write_jsonl_dataset(rows, path + "/qa")
    return tb.read_jsonl_dataset(spark, path + "/qa", "item_id bigint, question string, answer string")


@register("write_snapshot", "SELECT lang, count(*) AS docs, 'partial_reindex' AS snapshot_kind FROM documents GROUP BY 1")
def write_snapshot(spark, sf):
    path = scratch(spark, "snapshot")
    rows = b.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    tb.write_snapshot(rows, path + "/s", snapshot_kind="partial_reindex")
    return spark.read.schema("lang string, docs bigint, snapshot_kind string").json(path + "/s")


@register(
    "read_catalog_nested",
    "SELECT r_name AS category_id, CAST(n_nationkey AS VARCHAR) AS doc_key, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def read_catalog_nested(spark, sf):
    """Regions as categories, their nations as documents."""
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    doc = F.struct(F.col("n_nationkey").cast("string").alias("doc_key"), F.col("n_name").alias("title"))
    cats = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.collect_list(doc).alias("documents"))
    raw = cats.select(F.array(F.struct(F.col("r_name").alias("id"), F.col("documents"))).alias("categories"))
    path = scratch(spark, "catalog")
    raw.write.json(path + "/c")
    schema = "categories array<struct<id:string,documents:array<struct<doc_key:string,title:string>>>>"
    return tb.flatten_catalog(spark.read.schema(schema).json(path + "/c"))


def _pack(batches):
    """Encode each document in the format of its path."""
    head = b"{\\rtf1\\ansi "
    ns_w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for pdf in batches:
        out = []
        for text, kind in zip(pdf["text"], pdf["kind"]):
            if kind == ".docx":
                buf = io.BytesIO()
                body = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{ns_w}"><w:p><w:t>{body}</w:t></w:p></w:document>')
                out.append(buf.getvalue())
            elif kind == ".zip":
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("inner.txt", text)
                out.append(buf.getvalue())
            elif kind == ".rtf":
                out.append(head + text.encode() + b"}")
            else:
                out.append(text.encode())
        yield pd.DataFrame({"name": pdf["name"], "content": out})


_KINDS = [".txt", ".docx", ".rtf", ".zip", ".pdf", ".csv"]
_T = "trim(regexp_replace(text, '[\\s]+', ' ', 'g'))"


@register(
    "extract_text",
    f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, {_T} AS t FROM (SELECT doc_id, regexp_replace(text, '[\\\\{{}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS text FROM documents)),
        e AS (SELECT *, CASE k WHEN 4 THEN '' WHEN 3 THEN CASE WHEN t = '' THEN '' ELSE '[inner.txt]' || chr(10) || t END ELSE t END AS x FROM d)
       SELECT doc_id, md5(x) AS text_md5, ['plain_text','docx_xml','rtf_strip','zip_inner','unsupported','csv'][CAST(k AS INT) + 1] AS method,
         CASE k WHEN 0 THEN CASE WHEN x <> '' THEN 0.98 ELSE 0.0 END WHEN 1 THEN CASE WHEN x = '' THEN 0.0 WHEN length(x) > 30 THEN 0.95 ELSE 0.4 END
           WHEN 2 THEN CASE WHEN length(x) > 20 THEN 0.9 ELSE 0.3 END WHEN 3 THEN CASE WHEN length(x) > 40 THEN 0.7 ELSE 0.25 END WHEN 4 THEN 0.0
           ELSE CASE WHEN x <> '' THEN 0.9 ELSE 0.0 END END::DOUBLE AS confidence FROM e""",
)
def extract_text(spark, sf):
    """Every document encoded in one of six formats, then read back."""
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 6).cast("int"))
    clean = F.regexp_replace("text", r"[\\{}\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    docs = b.table(spark, sf, "documents").select(
        F.concat(F.lit("File_"), "doc_id", kind).alias("name"), tx.squeeze(clean).alias("text"), kind.alias("kind")
    )
    files = docs.mapInPandas(_pack, "name string, content binary")
    out = ar.extract_text(files, "name")
    return out.select(
        F.regexp_extract("name", r"_(\d+)", 1).cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "method", "confidence"
    )


@register(
    "guess_suffix",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.rtf' ELSE '' END AS by_content, '.htm' AS by_name FROM pages",
)
def guess_suffix(spark, sf):
    magic = [b"%PDF-1.7", b"PK\x03\x04", b"{\\rtf1", b""]
    lead = F.get(F.array(*[F.lit(bytearray(m)) for m in magic]), (F.col("page_id") % 4).cast("int"))
    content = F.concat(lead, F.encode("html", "UTF-8"))
    name = F.concat(F.lit("page."), F.col("page_id"), F.lit(".HTM"))
    return b.table(spark, sf, "pages").select(
        "page_id",
        tx.guess_suffix(F.lit(None).cast("string"), content).alias("by_content"),
        tx.guess_suffix(name, content).alias("by_name"),
    )


@register(
    "scan_archive",
    """SELECT 'lang=' || lang || '/doc_id=' || doc_id AS folder, '.txt' AS extension, 'ingest_candidate' AS import_action,
              CAST(strlen(text) + 1 AS BIGINT) AS size_bytes, 'sha256:' || sha256(text || chr(10)) AS content_hash FROM documents""",
)
def scan_archive(spark, sf):
    """Every document written as a file in a folder of its own, then listed with hashes."""
    root = scratch(spark, "archive")
    docs = b.table(spark, sf, "documents").select("lang", "doc_id", F.col("text").alias("value"))
    ar.write_archive(docs, f"{root}/files", ["lang", "doc_id"])
    listing = ar.scan_archive(spark, f"{root}/files", compute_hash=True)
    return listing.select(
        F.regexp_extract("relative_path", "^(.*)/[^/]+$", 1).alias("folder"), "extension", "import_action", "size_bytes", "content_hash"
    )


# --- streams: the tables are split into files, which the stream reads to the end ---------------


def _drain(stream, spark, mode, keep_batch=False):
    """Run a stream over what is there and keep its output as a table in the shared folder."""
    root = scratch(spark, "stream")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out if keep_batch else out.drop("batch")


def _rocks(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _stream_of(spark, df, name, files=4):
    path = scratch(spark, name) + "/in"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@register("audit_stream", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def audit_stream(spark, sf):
    stream = _stream_of(spark, b.table(spark, sf, "events").select("event_id", "event_type"), "audit")
    counts = _drain(flows.audit_counts(stream), spark, "update")
    return counts.groupBy("event_type").agg(F.max("events").alias("events"))


@register("stream_dedup", "SELECT 'sha256:' || sha256(text) AS content_hash, count(DISTINCT sha256(text)) AS kept FROM documents GROUP BY 1")
def stream_dedup(spark, sf):
    """One row per content, whichever of its copies arrives first; times follow the ids."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 3600)
    rows = b.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), at.alias("ts")
    )
    out = _drain(flows.stream_dedup(_stream_of(spark, rows, "dedup")), spark, "append")
    return out.groupBy("content_hash").agg(F.count("*").alias("kept"))


@register(
    "stream_ingest",
    "WITH " + b.SQL_CHUNKS.strip() + " SELECT chunk_id, doc_id, md5(content) AS content_md5 FROM chunks",
)
def stream_ingest(spark, sf):
    """Documents arrive as JSON files; one trigger drains the folder."""
    root = scratch(spark, "ingest")
    docs = b.documents(spark, sf).select("doc_id", "text", F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    docs.repartition(4).write.json(f"{root}/in")
    flows.stream_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/state").awaitTermination()
    return flows.read_current(spark, f"{root}/out").select("chunk_id", "doc_id", F.md5("content").alias("content_md5"))


@register("resumable_import", "SELECT 'doc_' || doc_id AS relative_path, n_chars + coalesce(toxic, 0) AS size_bytes FROM documents LEFT JOIN labels USING (doc_id)")
def resumable_import(spark, sf):
    """Two runs over one folder: all documents, then the labelled ones again, some changed."""
    root = scratch(spark, "resume")
    docs = b.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("relative_path"), F.col("n_chars").alias("size_bytes"), F.lit(1).cast("bigint").alias("mtime_ns"), "doc_id"
    )
    docs.drop("doc_id").write.json(f"{root}/in")
    flows.resumable_import(spark, f"{root}/in", f"{root}/state", f"{root}/ckpt").awaitTermination()
    again = docs.join(b.table(spark, sf, "labels"), "doc_id").select(
        "relative_path", (F.col("size_bytes") + F.col("toxic")).alias("size_bytes"), (F.col("mtime_ns") + F.col("toxic")).alias("mtime_ns")
    )
    again.write.mode("append").json(f"{root}/in")
    flows.resumable_import(spark, f"{root}/in", f"{root}/state", f"{root}/ckpt").awaitTermination()
    from folioframe.operators import ingest as ig

    state = spark.read.parquet(f"{root}/state")
    return ig.latest_per_key(state, ["relative_path"], ["batch_id"]).select("relative_path", "size_bytes")


@register(
    "session_state",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, least(count(*), 4) AS turns_kept, max(turn) AS last_turn,
              coalesce(max_by(md5(text), turn) FILTER (role = 'assistant'), '') AS active_doc_ids FROM conversations GROUP BY 1""",
)
def session_state(spark, sf):
    """Turns arrive in many files and several batches, in no order; the last state of each session counts."""
    _rocks(spark)
    rows = b.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"), F.array(F.md5("text")).alias("doc_ids")
    )
    path = scratch(spark, "session") + "/in"
    files = max(4, spark.sparkContext.defaultParallelism)
    rows.repartition(files, "turn", "session_id").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(path)
    out = _drain(flows.session_state(stream, keep=4), spark, "update", keep_batch=True)
    last = out.groupBy("session_id").agg(F.max_by(F.struct("turns_kept", "last_turn", "active_doc_ids"), "batch").alias("s"))
    return last.select("session_id", "s.*")


RANGES = 4  # of steps, written one after another


@register(
    "breaker_state",
    sql_walk("event_id") + f" SELECT CAST(run AS VARCHAR) AS run_id, event_id AS step, {STREAKS} FROM walk WHERE {TRIPPED}",
)
def breaker_state(spark, sf):
    """Steps arrive in many files and several batches: ranges of steps one after another, a run of a range in one file."""
    _rocks(spark)
    rows = steps(spark, sf).select(
        F.col("run").cast("string").alias("run_id"), F.col("event_id").alias("step"), "success", "error_code", "tool_name"
    )
    path = scratch(spark, "breaker") + "/in"
    files = max(4, spark.sparkContext.defaultParallelism)
    low, high = rows.agg(F.min("step"), F.max("step")).first()
    width = ((high or 0) - (low or 0)) // RANGES + 1
    for k in range(RANGES):  # a stream takes files by their time, so a later batch holds no earlier step of a run
        part = rows.where(F.floor((F.col("step") - F.lit(low or 0)) / width) == k)
        part.repartition(files, "run_id").write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return _drain(flows.breaker_state(stream), spark, "append")



# --- readers on files as they come: whole JSON documents and sheets ----------------------------

FILE_ROWS = 500  # rows of a written document, so files grow in number and not in size


def _as_files(rows, part, order, value, path):
    """One text file per part, its lines in order."""
    lines = rows.select(part.cast("bigint").alias("part"), order.alias("at"), value.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)


@register(
    "read_chunks_variant",
    "WITH " + b.SQL_CHUNKS.strip() + " SELECT chunk_id, doc_id, classification, page, md5(content) AS content_md5, 0::BIGINT AS old FROM chunks"
    " UNION ALL SELECT chunk_id, doc_id, classification, page, md5(upper(doc_id)), 1::BIGINT FROM chunks",
)
def read_chunks_variant(spark, sf):
    """Chunk documents in two variants; ``auto`` takes the newer one, which is a bare list."""
    path = scratch(spark, "variants")
    rows = b.chunks(spark, sf)
    part = F.floor(F.col("doc_no") / FILE_ROWS).alias("part")
    for name, content in (("v1", F.upper("doc_id")), ("v2", F.col("content"))):
        item = F.struct("chunk_id", "doc_id", "classification", "page", content.alias("content_preview"))
        docs = rows.groupBy(part).agg(F.collect_list(item).alias("chunks"))
        text = F.to_json(F.struct("chunks")) if name == "v1" else F.to_json("chunks")
        _as_files(docs, F.col("part"), F.lit(0), text, f"{path}/{name}")
    read = lambda variant, old: tb.read_chunks_variant(spark, f"{path}/v1", f"{path}/v2", variant).select(
        "chunk_id", "doc_id", "classification", "page", F.md5("content").alias("content_md5"), F.lit(old).cast("bigint").alias("old")
    )
    return read("auto", 0).unionByName(read("v1", 1))


@register(
    "read_org_snapshot",
    """SELECT 'employees' AS entity, 'e' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'active' END AS status FROM customer
       UNION ALL SELECT 'companies', 'co' || s_suppkey, 'active' FROM supplier
       UNION ALL SELECT 'assignments', 'a' || c_custkey, 'active' FROM customer""",
)
def read_org_snapshot(spark, sf):
    """Snapshots of customers as employees with an assignment each, and suppliers as companies."""
    path = scratch(spark, "org")
    status = F.when(F.col("c_acctbal") < 0, "blocked").otherwise("active")
    people = b.table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / FILE_ROWS).alias("part")).agg(
        F.collect_list(F.struct(F.concat(F.lit("e"), "c_custkey").alias("employee_id"), status.alias("status"))).alias("employees"),
        F.collect_list(F.struct(F.concat(F.lit("a"), "c_custkey").alias("assignment_id"), F.lit("active").alias("status"))).alias("assignments"),
    )
    firms = b.table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / FILE_ROWS).alias("part")).agg(
        F.collect_list(F.struct(F.concat(F.lit("co"), "s_suppkey").alias("company_id"), F.lit("active").alias("status"))).alias("companies")
    )
    both = people.join(firms, "part", "full")
    arrays = [F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("companies", "employees", "assignments")]
    _as_files(both, F.col("part"), F.lit(0), F.to_json(F.struct(*arrays)), f"{path}/snapshot")
    org = tb.read_org_snapshot(spark, f"{path}/snapshot")
    out = None
    for entity, key in (("employees", "employee_id"), ("companies", "company_id"), ("assignments", "assignment_id")):
        rows = org[entity].select(F.lit(entity).alias("entity"), F.col(key).alias("id"), "status")
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "read_sheets",
    """SELECT 'Order, ' || o_orderkey || chr(10) || 'of ' || o_orderstatus AS task, 'owner ' || o_custkey AS owner, strftime(o_orderdate, '%Y-%m-%d') AS due,
              CAST(75 AS BIGINT) AS cells, 'last' || o_orderkey AS last FROM orders""",
)
def read_sheets(spark, sf):
    """Orders as CSV sheets of 75 columns, with commas and line breaks inside cells."""
    path = scratch(spark, "sheets")
    orders = b.table(spark, sf, "orders")
    quoted = F.concat(F.lit('"Order, '), "o_orderkey", F.lit("\n"), F.lit("of "), "o_orderstatus", F.lit('"'))
    line = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(","), quoted, F.lit(",owner "), "o_custkey", F.lit("," * 72 + "last"), "o_orderkey"
    )
    _as_files(orders, F.floor(F.col("o_orderkey") / FILE_ROWS), F.col("o_orderkey"), line, f"{path}/csv")
    cells = tb.read_sheet_cells(spark, f"{path}/csv")
    at = lambda i: F.get("values", F.lit(i))
    return cells.select(
        at(1).alias("task"), at(2).alias("owner"), at(0).alias("due"), F.size("values").cast("bigint").alias("cells"), at(74).alias("last")
    )
