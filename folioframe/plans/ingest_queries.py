"""Dedup, change detection, upserts and sync plans.

Labelled documents stand for the state stored before; a toxic label marks an entry
whose stored fingerprint differs.
"""

from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import chunking as ch
from folioframe.operators import ingest as ig
from folioframe.plans import bindings as b
from folioframe.plans.registry import register


def _with(*parts):
    return "WITH " + ", ".join(p.strip() for p in parts)


@register(
    "dedup_decision",
    """WITH a AS (SELECT doc_id AS arrival, 'co_main:' || source || ':sha256:' || sha256(text) AS k, ['public','internal'][CAST(doc_id % 2 AS INT) + 1] AS cls,
            'doc_' || doc_id AS did, doc_id % 11 = 0 AS force, CASE WHEN doc_id % 3 = 0 THEN 'idem_' || (n_chars % 97) || '_' || (doc_id % 50) END AS idem FROM documents),
        m AS (SELECT *, CASE WHEN idem IS NULL THEN arrival ELSE min(arrival) OVER (PARTITION BY idem) END AS first FROM a),
        l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival) = 1 AS is_first FROM m WHERE arrival = first),
        d AS (SELECT *, is_first OR force AS acc,
               last_value(CASE WHEN is_first OR force THEN cls END IGNORE NULLS) OVER w AS pc, last_value(CASE WHEN is_first OR force THEN did END IGNORE NULLS) OVER w AS pd
              FROM l WINDOW w AS (PARTITION BY k ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        e AS (SELECT arrival AS first, acc, CASE WHEN is_first THEN 'none' WHEN acc THEN 'reprocessed' WHEN pc = cls THEN 'skipped_processing' ELSE 'linked_existing' END AS act, did, pd FROM d)
       SELECT m.arrival, m.k AS dedup_key, CASE WHEN acc THEN 'accepted' ELSE 'duplicate' END AS ingest_status,
         CASE WHEN m.arrival <> m.first THEN 'skipped_processing' ELSE act END AS dedup_action, CASE WHEN acc THEN e.did END AS doc_id,
         CASE WHEN NOT acc THEN pd END AS matched_doc_id, CASE WHEN m.arrival = m.first AND act = 'linked_existing' THEN 'classification_differs' END AS warning
       FROM m JOIN e USING (first)""",
)
def dedup_decision(spark, sf):
    rows = b.table(spark, sf, "documents")
    arrivals = rows.select(
        F.col("doc_id").alias("arrival"),
        ig.dedup_key(F.lit("co_main"), F.col("source"), ch.content_hash(F.col("text"))).alias("dedup_key"),
        F.when(F.col("doc_id") % 2 == 0, "public").otherwise("internal").alias("classification"),
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"),
        (F.col("doc_id") % 11 == 0).alias("force_reprocess"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("idem_"), F.col("n_chars") % 97, F.lit("_"), F.col("doc_id") % 50)).alias("idempotency_key"),
    )
    return ig.dedup_decisions(arrivals, block_rows=5000)


@register(
    "dedup_with_records",
    """WITH a AS (SELECT doc_id, sha256(text) AS h, lang FROM documents), r AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id))
       SELECT a.doc_id AS arrival, CASE WHEN r.h IS NOT NULL THEN 'duplicate' WHEN row_number() OVER (PARTITION BY a.h ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS ingest_status
       FROM a LEFT JOIN r USING (h)""",
)
def dedup_with_records(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    key = ch.content_hash(F.col("text"))
    arrivals = docs.select(
        F.col("doc_id").alias("arrival"), key.alias("dedup_key"), F.col("lang").alias("classification"),
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(False).alias("force_reprocess"), F.lit(None).cast("string").alias("idempotency_key"),
    )
    known = docs.join(labels, "doc_id", "left_semi").groupBy(key.alias("dedup_key")).agg(
        F.min("lang").alias("classification"), F.min("doc_id").cast("string").alias("doc_id")
    )
    return ig.dedup_decisions(arrivals, known).select("arrival", "ingest_status")


_OLD_CHUNKS = """
old AS (SELECT c.chunk_id, c.content FROM chunks c JOIN labels l ON c.doc_no = l.doc_id),
new AS (SELECT c.chunk_id, CASE WHEN l.toxic = 1 THEN '! ' || c.content ELSE c.content END AS content, v
        FROM chunks c LEFT JOIN labels l ON c.doc_no = l.doc_id, (VALUES (1), (2)) t(v) WHERE l.doc_id IS NULL OR l.toxic = 1)
"""


def _old_new(spark, sf):
    chunks, labels = b.chunks(spark, sf), b.table(spark, sf, "labels").select(F.col("doc_id").alias("doc_no"), "toxic")
    old = chunks.join(labels, "doc_no", "left_semi").select("chunk_id", "content")
    joined = chunks.join(labels, "doc_no", "left").where("toxic is null or toxic = 1")
    new = joined.select(
        "chunk_id",
        F.when(F.col("toxic") == 1, F.concat(F.lit("! "), "content")).otherwise(F.col("content")).alias("content"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("version"),
    )
    return old, new


@register(
    "upsert_chunks",
    _with(b.SQL_CHUNKS, _OLD_CHUNKS)
    + """ SELECT chunk_id, md5(content) AS content_md5, NULL::INT AS version FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)
         UNION ALL SELECT chunk_id, md5(content), v FROM new WHERE v = 2""",
)
def upsert_chunks(spark, sf):
    old, new = _old_new(spark, sf)
    rows = ig.upsert(old.withColumn("version", F.lit(None).cast("int")), new, ["chunk_id"], ["version"])
    return rows.select("chunk_id", F.md5("content").alias("content_md5"), "version")


@register(
    "delete_by_source_path",
    _with(b.SQL_CHUNKS)
    + " SELECT chunk_id FROM chunks WHERE doc_no NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_by_source_path(spark, sf):
    docs = b.documents(spark, sf)
    toxic = b.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_no"))
    paths = docs.join(toxic, "doc_no").select(F.replace("source_relative_path", F.lit("/"), F.lit("\\")).alias("relative_path"))
    return ig.delete_by_source(b.chunks(spark, sf), paths).select("chunk_id")


@register(
    "incremental_slice",
    _with(b.SQL_CHUNKS) + " SELECT chunk_id FROM chunks WHERE doc_no NOT IN (SELECT doc_id FROM labels)",
)
def incremental_slice(spark, sf):
    old, _ = _old_new(spark, sf)
    return ig.incremental_slice(b.chunks(spark, sf), old).select("chunk_id")


@register(
    "replace_corpus",
    _with(b.SQL_CHUNKS)
    + """ SELECT corpus_id, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM chunks
         WHERE corpus_id = 'south' OR doc_no IN (SELECT doc_id FROM labels) GROUP BY 1""",
)
def replace_corpus(spark, sf):
    """The north corpus is loaded, then replaced by its labelled documents; south stays."""
    from folioframe.session import new_folder
    from folioframe.sources import tables

    target = new_folder(spark, "corpus")
    chunks = b.chunks(spark, sf).select("chunk_id", "doc_id", "doc_no", "corpus_id")
    chunks.write.mode("overwrite").partitionBy("corpus_id").parquet(target)
    labels = b.table(spark, sf, "labels").select(F.col("doc_id").alias("doc_no"))
    tables.write_corpus(chunks.where("corpus_id = 'north'").join(labels, "doc_no", "left_semi"), target)
    rows = spark.read.parquet(target)
    return rows.groupBy("corpus_id").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@register(
    "missing_files",
    """SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT page_id, 'extra' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""",
)
def missing_files(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    pages = b.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return ig.missing_rows(docs, labels, "doc_id").withColumn("side", F.lit("missing")).unionByName(
        ig.missing_rows(pages, labels, "doc_id").withColumn("side", F.lit("extra"))
    )


@register(
    "set_difference",
    "SELECT DISTINCT o_custkey AS key FROM orders EXCEPT SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0",
)
def set_difference(spark, sf):
    ordered = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    solvent = b.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return ig.missing_rows(ordered, solvent, "key")


@register(
    "manifest_diff",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'gone' WHEN l.toxic = 0 THEN 'unchanged' ELSE 'changed' END AS status
       FROM (SELECT * FROM documents WHERE lang <> 'es') d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def manifest_diff(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    size = F.col("n_chars").alias("size")
    old = docs.join(labels, "doc_id").select("doc_id", (F.col("n_chars") + F.col("toxic")).alias("size"))
    return ig.manifest_diff(old, docs.where("lang <> 'es'").select("doc_id", size), "doc_id", ["size"])


_PROBES = """
pr AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'sha256:' || sha256(html) ELSE 'e' || length(html) || '|Mon|200' END AS fp FROM pages),
st AS (SELECT p.page_id, CASE WHEN l.toxic = 1 THEN 'sha256:old' WHEN l.quality = 1 THEN pr.fp END AS fp FROM pages p JOIN labels l ON p.page_id = l.doc_id JOIN pr ON pr.page_id = p.page_id),
ch AS (SELECT pr.page_id, pr.fp, st.fp AS old, CASE WHEN pr.fp IS NULL THEN 'no_change' WHEN st.fp IS NULL THEN 'new_edition' WHEN st.fp <> pr.fp THEN 'amendment' ELSE 'no_change' END AS kind
       FROM pr LEFT JOIN st ON pr.page_id = st.page_id)
"""


def _feed(spark, sf):
    pages, labels = b.table(spark, sf, "pages"), b.table(spark, sf, "labels")
    failed, hashed = F.col("page_id") % 6 == 0, F.col("page_id") % 2 == 0
    probes = pages.select(
        F.col("page_id").alias("doc_key"),
        F.when(~failed & hashed, ch.content_hash(F.col("html"))).alias("content_hash"),
        F.when(~failed & ~hashed, F.concat(F.lit("e"), F.length("html"))).alias("etag"),
        F.when(~failed & ~hashed, "Mon").alias("last_modified"),
        F.when(~failed & ~hashed, 200).alias("http_status"),
    )
    probes = probes.select("doc_key", ig.probe_fingerprint().alias("fingerprint"))
    state = probes.join(labels, F.col("doc_key") == F.col("doc_id")).select(
        "doc_key", F.when(F.col("toxic") == 1, "sha256:old").when(F.col("quality") == 1, F.col("fingerprint")).alias("fingerprint")
    )
    return ig.source_changes(state, probes)


@register(
    "source_change_feed",
    _with(_PROBES)
    + """ SELECT page_id AS doc_key, kind AS update_type, CASE WHEN starts_with(old, 'sha256:') THEN old END AS old_content_hash,
            CASE WHEN starts_with(fp, 'sha256:') THEN fp END AS new_content_hash, CASE WHEN kind <> 'no_change' THEN 'pending' ELSE 'skipped' END AS ingest_status,
            kind <> 'no_change' AS notify_curator, fp IS NULL AS probe_failed FROM ch""",
)
def source_change_feed(spark, sf):
    return _feed(spark, sf)


@register(
    "apply_pending",
    _with(_PROBES)
    + """ SELECT CASE WHEN d.lang IN ('en', 'de') THEN 'ingested' ELSE 'failed' END AS ingest_status, count(*) AS updates
         FROM ch LEFT JOIN documents d ON ch.page_id = d.doc_id WHERE kind <> 'no_change' GROUP BY 1""",
)
def apply_pending(spark, sf):
    outcome = F.when(F.col("lang") == "en", "accepted").when(F.col("lang") == "de", "processing").otherwise("duplicate")
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), outcome.alias("ingest_result"))
    rows = ig.apply_pending(_feed(spark, sf), docs)
    return rows.groupBy("ingest_status").agg(F.count("*").alias("updates"))


@register(
    "task_sync_plan",
    """WITH o AS (SELECT o_orderkey AS card_id, CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'manual:' || o_orderkey ELSE 'sheet:' || o_orderkey END AS ref,
            'Order ' || o_custkey AS title FROM orders WHERE o_orderstatus <> 'P'),
        n AS (SELECT 'sheet:' || o_orderkey AS ref, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Urgent ' ELSE 'Order ' END || o_custkey AS title FROM orders WHERE o_orderstatus <> 'F')
       SELECT coalesce(o.ref, n.ref) AS reference, card_id, coalesce(n.title, o.title) AS title,
         CASE WHEN card_id IS NULL THEN 'added' WHEN n.ref IS NOT NULL THEN 'updated' ELSE 'removed' END AS action
       FROM (SELECT * FROM o WHERE ref <> '') o FULL JOIN n ON o.ref = n.ref WHERE card_id IS NULL OR n.ref IS NOT NULL OR starts_with(o.ref, 'sheet:')
       UNION ALL SELECT ref, card_id, title, 'removed' FROM o WHERE ref = '' AND title IN (SELECT title FROM n)""",
)
def task_sync_plan(spark, sf):
    orders = b.table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    ref = (
        F.when(p == "5-LOW", F.lit(""))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("manual:"), "o_orderkey"))
        .otherwise(F.concat(F.lit("sheet:"), "o_orderkey"))
    )
    board = orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("card_id"), ref.alias("reference"), F.concat(F.lit("Order "), "o_custkey").alias("title")
    )
    tasks = orders.where("o_orderstatus <> 'F'").select(
        F.concat(F.lit("sheet:"), "o_orderkey").alias("reference"),
        F.concat(F.when(p == "1-URGENT", "Urgent ").otherwise("Order "), "o_custkey").alias("title"),
    )
    return ig.task_sync_plan(board, tasks, "sheet:")


@register(
    "acl_sync_plan",
    _with(b.SQL_FOLDERS, b.SQL_GRANTS)
    + """ SELECT grant_id, employee_id, g.folder_id, physical_path, CAST(i - 1 AS INT) AS step,
            CASE WHEN grant_type = 'deny' THEN 'remove_read' WHEN actions[i] = 'read' THEN 'add_read' ELSE 'add_write' END AS action
         FROM grants g JOIN folders f USING (folder_id), unnest(range(1, CASE WHEN grant_type = 'deny' THEN 1 ELSE len(actions) END + 1)) t(i)
         WHERE g.status = 'active' AND f.status <> 'inactive' AND storage_backend = 'sharepoint'""",
)
def acl_sync_plan(spark, sf):
    return ig.acl_sync_plan(b.grants(spark), b.folders(spark, sf))


@register(
    "corpus_merge",
    _with(b.SQL_CHUNKS)
    + """, f AS (SELECT chunk_id, doc_id, corpus_id, NULL AS origin FROM chunks UNION ALL
           SELECT 'copy_' || substr(sha1('south-from-north|' || chunk_id || '|' || source_relative_path), 1, 24), doc_id, 'south', chunk_id FROM chunks WHERE corpus_id = 'north')
         SELECT * FROM f""",
)
def corpus_merge(spark, sf):
    rows = b.chunks(spark, sf).select(
        "chunk_id", "doc_id", "corpus_id", F.col("source_relative_path").alias("doc_path"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    merged = ig.merge_corpus(rows, "north", "south", "copy_")
    return merged.select("chunk_id", "doc_id", "corpus_id", F.col("metadata")["source_chunk_id"].alias("origin"))


@register(
    "path_repair",
    _with(b.SQL_CHUNKS)
    + """ SELECT chunk_id, CASE WHEN l.doc_id IS NOT NULL THEN 'moved/' || regexp_extract(source_relative_path, '[^/]*$') ELSE source_relative_path END AS doc_path,
            l.doc_id IS NOT NULL AS updated, l.doc_id IS NULL AS missing FROM chunks c LEFT JOIN labels l ON c.doc_no = l.doc_id""",
)
def path_repair(spark, sf):
    labels = b.table(spark, sf, "labels").select(F.col("doc_id").alias("doc_no"))
    listed = b.documents(spark, sf).join(labels, "doc_no", "left_semi")
    listing = listed.select(F.concat(F.lit("moved/"), tx.base_name(F.col("source_relative_path"))).alias("full_path"))
    return ig.repair_paths(b.chunks(spark, sf).withColumnRenamed("source_relative_path", "doc_path"), listing)


_FP = """
fp AS (SELECT doc_no, 'sha256:' || substr(sha256(string_agg(chunk_id || ':' || substr(content, 1, 120), chr(10) ORDER BY chunk_id || ':' || substr(content, 1, 120))), 1, 16) AS content_fingerprint
       FROM chunks GROUP BY 1)
"""


@register("doc_fingerprint", _with(b.SQL_CHUNKS, _FP) + " SELECT doc_no, content_fingerprint FROM fp")
def doc_fingerprint(spark, sf):
    return ig.doc_fingerprint(b.chunks(spark, sf), "doc_no")


@register(
    "doc_fingerprint_upsert",
    _with(b.SQL_CHUNKS)
    + """, now AS (SELECT c.doc_no, chunk_id, CASE WHEN toxic = 1 THEN 'new ' || content ELSE content END AS content, page
                  FROM chunks c LEFT JOIN labels l ON c.doc_no = l.doc_id
                  WHERE NOT (coalesce(quality, 1) = 0 AND page = 1)),
        h AS (SELECT doc_no, sha256(chunk_id || ':' || substr(content, 1, 120)) AS d FROM now)
        SELECT doc_no, count(*) AS n, CAST(sum(CAST('0x' || d[1:15] AS BIGINT)) AS VARCHAR) AS sum_a,
               CAST(sum(CAST('0x' || d[16:30] AS BIGINT)) AS VARCHAR) AS sum_b FROM h GROUP BY 1""",
)
def doc_fingerprint_upsert(spark, sf):
    """Chunks of toxic documents change and first chunks of low ones go: the stored sums follow the changes."""
    chunks = b.chunks(spark, sf).select("doc_no", "chunk_id", "content", "page")
    labels = b.table(spark, sf, "labels").select(F.col("doc_id").alias("doc_no"), "quality", "toxic")
    touched = chunks.join(labels, "doc_no")
    gone = (F.col("quality") == 0) & (F.col("page") == 1)
    removed = touched.where(gone | (F.col("toxic") == 1))
    added = touched.where(~gone & (F.col("toxic") == 1)).withColumn("content", F.concat(F.lit("new "), "content"))
    now = ig.apply_chunk_sums(ig.chunk_sums(chunks, "doc_no"), removed, added, "doc_no")
    return now.select("doc_no", "n", F.col("sum_a").cast("string").alias("sum_a"), F.col("sum_b").cast("string").alias("sum_b"))


@register(
    "profile_cache_join",
    _with(b.SQL_CHUNKS, _FP)
    + """ SELECT doc_no AS doc_id, content_fingerprint, coalesce(toxic = 0 AND quality = 1, false) AS cache_hit,
            CASE WHEN toxic = 0 AND quality = 1 THEN 'gist ' || doc_no END AS gist FROM fp LEFT JOIN labels l ON fp.doc_no = l.doc_id""",
)
def profile_cache_join(spark, sf):
    now = ig.doc_fingerprint(b.chunks(spark, sf), "doc_no").withColumnRenamed("doc_no", "doc_id")
    stored = now.join(b.table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") == 0, F.col("content_fingerprint")).otherwise("sha256:old").alias("content_fingerprint"),
        F.when(F.col("quality") == 1, F.concat(F.lit("gist "), "doc_id")).otherwise("").alias("gist"),
    )
    return ig.profile_cache(now, stored)


@register(
    "reprocess_targets",
    _with(b.SQL_DOCS)
    + """ SELECT source_relative_path AS relative_path FROM docs WHERE doc_no NOT IN (SELECT doc_id FROM labels)
           OR ends_with(lower(source_relative_path), '.pdf') OR contains(lower(source_relative_path), 'src7/')""",
)
def reprocess_targets(spark, sf):
    docs = b.documents(spark, sf).select("doc_no", F.col("source_relative_path").alias("relative_path"))
    labels = b.table(spark, sf, "labels").select(F.col("doc_id").alias("doc_no"))
    return ig.reprocess_targets(docs, docs.join(labels, "doc_no", "left_semi"), ".pdf", ["SRC7/"])


@register("distinct_sorted", "SELECT DISTINCT lang, source FROM documents ORDER BY 1, 2")
def distinct_sorted(spark, sf):
    return b.table(spark, sf, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@register(
    "union_datasets",
    """SELECT 'benchmark' AS origin, item_id AS id, text FROM benchmark UNION ALL SELECT 'documents', doc_id, text FROM documents
       UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations""",
)
def union_datasets(spark, sf):
    named = lambda name, key: b.table(spark, sf, name).select(F.lit(name).alias("origin"), key.alias("id"), "text")
    return (
        named("benchmark", F.col("item_id"))
        .unionByName(named("documents", F.col("doc_id")))
        .unionByName(named("conversations", F.col("conv_id") * 1000 + F.col("turn")))
    )


@register(
    "latest_n",
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
)
def latest_n(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
