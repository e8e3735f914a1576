"""Deduplication, change detection, upserts and sync plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import scan


def dedup_key(company: Column, project: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", company, project, content_hash)


def dedup_decisions(
    arrivals: DataFrame, records: DataFrame | None = None, block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """Sequential dedup and idempotency without walking a key in one task.

    ``arrivals``: arrival (order), dedup_key, classification, doc_id, force_reprocess,
    idempotency_key.  ``records`` (dedup_key, classification, doc_id) are documents
    known before.  The first row of an idempotency key decides for the later ones,
    which never touch the records.  A row is accepted when it is the first of its key
    or forced; others refer to the latest accepted row before them.
    """
    has_key = F.coalesce("idempotency_key", F.lit("")) != ""
    firsts = arrivals.where(has_key).groupBy("idempotency_key").agg(F.min("arrival").alias("_first"))
    marked = arrivals.join(firsts, "idempotency_key", "left").withColumn("_first", F.coalesce("_first", "arrival"))

    live = marked.where(F.col("arrival") == F.col("_first")).select(
        "arrival", "dedup_key", "classification", "doc_id", "force_reprocess", F.lit(False).alias("known")
    )
    if records is not None:
        live = live.unionByName(
            records.select(
                F.lit(-1).cast("bigint").alias("arrival"),
                "dedup_key",
                "classification",
                "doc_id",
                F.lit(False).alias("force_reprocess"),
                F.lit(True).alias("known"),
            )
        )
    lead = live.groupBy("dedup_key").agg(F.min("arrival").alias("_lead"))
    live = live.join(lead, "dedup_key").withColumns(
        {
            "_is_first": F.col("arrival") == F.col("_lead"),
            "_block": scan.block_of(F.col("arrival"), block_rows),
        }
    )
    accepted = F.col("_is_first") | F.col("force_reprocess")
    store = F.when(accepted, F.struct("classification", "doc_id"))
    decided = scan.running_last(live, ["dedup_key"], ["arrival"], _record=store)
    same = F.col("_record.classification").eqNullSafe(F.col("classification"))
    decided = decided.where(~F.col("known")).select(
        F.col("arrival").alias("_first"),
        F.when(accepted, "accepted").otherwise("duplicate").alias("ingest_status"),
        F.when(F.col("_is_first"), "none")
        .when(accepted, "reprocessed")
        .when(same, "skipped_processing")
        .otherwise("linked_existing")
        .alias("_action"),
        F.when(accepted, F.col("doc_id")).alias("out_doc_id"),
        F.when(~accepted, F.col("_record.doc_id")).alias("matched_doc_id"),
    )
    repeated = F.col("arrival") != F.col("_first")
    return marked.drop("doc_id").join(decided, "_first").select(
        "arrival",
        "dedup_key",
        "ingest_status",
        F.when(repeated, "skipped_processing").otherwise(F.col("_action")).alias("dedup_action"),
        F.col("out_doc_id").alias("doc_id"),
        "matched_doc_id",
        F.when(~repeated & (F.col("_action") == "linked_existing"), "classification_differs").alias("warning"),
    )


def latest_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same key."""
    fresh = latest_per_key(new, key, order)
    return base.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_by_source(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks without those of the given files (``paths``: relative_path)."""
    gone = paths.select(F.translate("relative_path", "\\", "/").alias("_path")).distinct()
    mine = F.translate(F.coalesce("source_relative_path", F.lit("")), "\\", "/")
    return chunks.withColumn("_path", mine).join(gone, "_path", "left_anti").drop("_path")


def incremental_slice(chunks: DataFrame, loaded: DataFrame, same_source: bool = True) -> DataFrame:
    """Chunks not loaded before; all of them when the variant or the path changed."""
    return chunks.join(loaded.select("chunk_id"), "chunk_id", "left_anti") if same_source else chunks


def manifest_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """unchanged / changed / new / gone by null-safe comparison of the fingerprint columns."""
    a = old.select(key, F.struct(*columns).alias("_old"))
    b = new.select(key, F.struct(*columns).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "gone")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def missing_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` does not have."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def probe_fingerprint() -> Column:
    """Content hash, else etag|last_modified|status when any is known."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("etag", "last_modified", "http_status")]
    joined = F.concat_ws("|", *parts)
    return F.coalesce(F.nullif("content_hash", F.lit("")), F.when(joined != "||", joined))


def source_changes(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Update type per document from the stored and the probed fingerprint.

    A failed probe is stored as null, so the next success reads as a new edition.
    """
    old = state.select("doc_key", F.col("fingerprint").alias("old_fp"))
    kind = (
        F.when(F.col("fingerprint").isNull(), "no_change")
        .when(F.col("old_fp").isNull(), "new_edition")
        .when(F.col("old_fp") != F.col("fingerprint"), "amendment")
        .otherwise("no_change")
    )
    changed = F.col("update_type") != "no_change"
    as_hash = lambda c: F.when(F.col(c).startswith("sha256:"), F.col(c))
    return (
        probes.join(old, "doc_key", "left")
        .withColumn("update_type", kind)
        .select(
            "doc_key",
            "update_type",
            as_hash("old_fp").alias("old_content_hash"),
            as_hash("fingerprint").alias("new_content_hash"),
            F.when(changed, "pending").otherwise("skipped").alias("ingest_status"),
            changed.alias("notify_curator"),
            F.col("fingerprint").isNull().alias("probe_failed"),
        )
    )


def apply_pending(updates: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome of pending updates: ingested when the catalog document has text."""
    pending = updates.where(F.col("ingest_status") == "pending")
    done = F.col("ingest_result").isin("processing", "accepted")
    return pending.join(documents, "doc_key", "left").select(
        "doc_key",
        F.when(F.coalesce(done, F.lit(False)), "ingested").otherwise("failed").alias("ingest_status"),
    )


def task_sync_plan(board: DataFrame, tasks: DataFrame, prefix: str) -> DataFrame:
    """added / updated / removed per card.

    ``board``: card_id, reference, title.  ``tasks``: reference, title.  Cards of the
    synced prefix that are gone are removed, and so are cards without a reference
    that carry a synced title.
    """
    wanted = tasks.where((F.coalesce("reference", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    wanted = wanted.select("reference", F.col("title").alias("new_title"))
    with_ref = board.where(F.coalesce("reference", F.lit("")) != "")
    action = (
        F.when(F.col("card_id").isNull(), "added")
        .when(F.col("new_title").isNotNull(), "updated")
        .when(F.col("reference").startswith(prefix), "removed")
    )
    by_ref = with_ref.join(wanted, "reference", "full_outer").select(
        "reference", "card_id", F.coalesce("new_title", "title").alias("title"), action.alias("action")
    )
    titles = tasks.select(F.trim("title").alias("title")).where("title <> ''").distinct()
    repeats = board.where(F.coalesce("reference", F.lit("")) == "").join(titles, "title", "left_semi")
    return by_ref.where("action is not null").unionByName(
        repeats.select("reference", "card_id", "title", F.lit("removed").alias("action"))
    )


def acl_sync_plan(
    grants: DataFrame, folders: DataFrame, backend: str = "sharepoint", as_of: str | None = None
) -> DataFrame:
    """One change per granted action on folders of a backend; a deny removes reading.

    Validity dates are only checked when ``as_of`` is given.
    """
    live = grants.where(F.col("status") == "active")
    if as_of:
        from folioframe.operators.security import active_as_of

        live = live.where(active_as_of(F.lit(as_of).cast("date")))
    target = folders.where(
        (F.coalesce("status", F.lit("active")) != "inactive") & (F.col("storage_backend") == backend)
    ).select("folder_id", "physical_path")
    granted = F.transform("actions", lambda a: F.when(a == "read", "add_read").otherwise("add_write"))
    actions = F.when(F.col("grant_type") == "deny", F.array(F.lit("remove_read"))).otherwise(granted)
    return live.join(target, "folder_id").select(
        "grant_id", "employee_id", "folder_id", "physical_path", F.posexplode(actions).alias("step", "action")
    )


def merge_corpus(chunks: DataFrame, source: str, target: str, id_prefix: str) -> DataFrame:
    """Copy the rows of one corpus into another, with new ids and their origin in metadata."""
    raw = F.concat_ws("|", F.lit(f"{target}-from-{source}"), "chunk_id", F.coalesce("doc_path", F.lit("")))
    copied = chunks.where(F.col("corpus_id") == source).withColumns(
        {
            "metadata": F.map_concat(
                F.map_filter(
                    F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                    lambda k, v: ~k.isin("merged_from_corpus", "source_chunk_id"),
                ),
                F.create_map(F.lit("merged_from_corpus"), F.lit(source), F.lit("source_chunk_id"), F.col("chunk_id")),
            ),
            "corpus_id": F.lit(target),
            "chunk_id": F.concat(F.lit(id_prefix), F.substring(F.sha1(raw), 1, 24)),
        }
    )
    return upsert(chunks, copied, ["chunk_id"], ["doc_id"])


def repair_paths(chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored path replaced by the listed file with the same name (``listing``: full_path)."""
    by_name = listing.groupBy(tx.base_name(F.col("full_path")).alias("_name")).agg(F.max("full_path").alias("_full"))
    joined = chunks.withColumn("_name", tx.base_name(F.col("doc_path"))).join(by_name, "_name", "left")
    moved = F.col("_full").isNotNull() & (F.col("_full") != F.col("doc_path"))
    return joined.select(
        "chunk_id", F.coalesce("_full", "doc_path").alias("doc_path"), moved.alias("updated"), F.col("_full").isNull().alias("missing")
    )


def profile_cache(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reuse a stored profile when its fingerprint is equal and it has a gist."""
    p = profiles.select("doc_id", F.col("content_fingerprint").alias("_fp"), "gist")
    hit = F.col("_fp").eqNullSafe(F.col("content_fingerprint")) & (F.coalesce("gist", F.lit("")) != "")
    return targets.join(p, "doc_id", "left").select(
        "doc_id", "content_fingerprint", F.coalesce(hit, F.lit(False)).alias("cache_hit"), F.when(hit, F.col("gist")).alias("gist")
    )


def reprocess_targets(
    processed: DataFrame, indexed: DataFrame, suffix: str | None = None, needles: list[str] | None = None
) -> DataFrame:
    """Processed but not indexed, or with the suffix, or with a needle in the path; sorted."""
    parts = [processed.join(indexed, "relative_path", "left_anti").select("relative_path")]
    low = F.lower("relative_path")
    if suffix:
        parts.append(processed.where(low.endswith(suffix)).select("relative_path"))
    for needle in needles or []:
        parts.append(processed.where(low.contains(needle.lower())).select("relative_path"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("relative_path")


def enrich_paths(citations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Missing citation paths from a doc_id -> path catalog; existing ones stay."""
    c = catalog.select("doc_id", F.col("relative_path").alias("_rel"))
    rel = F.coalesce(F.nullif("relative_path", F.lit("")), "_rel")
    return citations.join(c, "doc_id", "left").select(
        *[x for x in citations.columns if x != "relative_path"],
        rel.alias("relative_path"),
        tx.base_name(rel).alias("file_name"),
    )


def doc_fingerprint(chunks: DataFrame, group: str = "doc_id") -> DataFrame:
    """sha256 over the sorted ``id:first 120 characters`` lines of a document's chunks.

    Chunks of a document come from one string value, which bounds what is gathered.
    """
    line = F.concat_ws(":", "chunk_id", F.substring(F.coalesce("content", F.lit("")), 1, 120))
    return chunks.groupBy(group).agg(
        F.concat(
            F.lit("sha256:"),
            F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 16),
        ).alias("content_fingerprint")
    )


def chunk_sums(chunks: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, n, sum_a, sum_b): a fingerprint of a document's chunks that can be added to and taken from.

    Each chunk's line, as in :func:`doc_fingerprint`, is hashed; two halves of the hash are
    summed over the document.  Sums combine before the shuffle, in any order, and nothing
    is gathered, so a document may have any number of chunks.
    """
    line = F.concat_ws(":", "chunk_id", F.substring(F.coalesce("content", F.lit("")), 1, 120))
    digest = F.sha2(line, 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    return chunks.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(half(1)).cast("decimal(38,0)").alias("sum_a"), F.sum(half(16)).cast("decimal(38,0)").alias("sum_b")
    )


def apply_chunk_sums(state: DataFrame, removed: DataFrame, added: DataFrame, group: str = "doc_id") -> DataFrame:
    """The fingerprints after chunks were removed and added; only those chunks are read again.

    ``state`` is an earlier result of :func:`chunk_sums`; a document without chunks goes.
    """
    sums = ("n", "sum_a", "sum_b")
    less = chunk_sums(removed, group).select(group, *[(-F.col(c)).alias(c) for c in sums])
    parts = state.select(group, *sums).unionByName(less).unionByName(chunk_sums(added, group))
    total = parts.groupBy(group).agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in sums[1:]])
    return total.where("n > 0")
