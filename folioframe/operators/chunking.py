"""Cutting text into windows, and row preparation for the chunk table.

Windows come from a closed form over the text length, so each document row turns
into its pieces with one ``explode`` and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as tx


def window_starts(n: Column, size: int, step: int) -> Column:
    """Start offsets of the windows that cover ``n`` characters."""
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step) * step)
    return F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))


def chunk_windows(
    docs: DataFrame, text_col: str = "text", size: int = 1024, overlap: int = 128
) -> DataFrame:
    """Overlapping windows: adds idx (from 1), start_offset, end_offset, content."""
    step = max(1, size - (overlap or 128))
    body = docs.withColumn("_body", tx.strip(F.coalesce(F.col(text_col), F.lit("")))).where("_body <> ''")
    cut = body.select("*", F.posexplode(window_starts(F.length("_body"), size, step)).alias("_pos", "_start"))
    piece = F.substring(F.col("_body"), F.col("_start").cast("int") + 1, F.lit(size))
    return cut.select(
        *[c for c in docs.columns if c != text_col],
        (F.col("_pos") + 1).alias("idx"),
        F.col("_start").cast("int").alias("start_offset"),
        F.least(F.length("_body"), F.col("_start").cast("int") + size).alias("end_offset"),
        piece.alias("content"),
    )


def chunk_id(doc_id: Column, idx: Column) -> Column:
    n = idx.cast("string")
    return F.concat(
        F.lit("chunk_"), doc_id, F.lit("_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    )


def build_chunks(docs: DataFrame, text_col: str = "text", size: int = 1024, overlap: int = 128) -> DataFrame:
    """Windows with chunk ids; ``page`` is the window number."""
    cut = chunk_windows(docs, text_col, size, overlap)
    return cut.withColumns(
        {"chunk_id": chunk_id(F.col("doc_id").cast("string"), F.col("idx")), "page": F.col("idx")}
    ).drop("idx")


def context_pieces(
    docs: DataFrame, key: str, text_col: str = "text", size: int = 2400, overlap: int = 200
) -> DataFrame:
    """Windows whose pieces are stripped; blank ones are dropped and ids stay dense."""
    step = size - overlap
    body = docs.withColumn("_body", tx.strip(F.coalesce(F.col(text_col), F.lit("")))).where("_body <> ''")
    starts = window_starts(F.length("_body"), size, step)
    pieces = F.transform(
        starts,
        lambda s: F.struct(
            s.cast("int").alias("start_offset"),
            F.least(F.length("_body"), s.cast("int") + size).alias("end_offset"),
            tx.strip(F.substring(F.col("_body"), s.cast("int") + 1, F.lit(size))).alias("content"),
        ),
    )
    return body.select(
        key, F.posexplode(F.filter(pieces, lambda p: p["content"] != "")).alias("piece_id", "_p")
    ).select(key, "piece_id", "_p.start_offset", "_p.end_offset", "_p.content")


def fixed_blocks(docs: DataFrame, key: str, text_col: str = "text", size: int = 1800) -> DataFrame:
    """Non-overlapping blocks, stripped; blank ones are dropped."""
    n = F.greatest(F.length(text_col), F.lit(1))
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    blocks = F.filter(
        F.transform(starts, lambda s: tx.strip(F.substring(F.col(text_col), s + 1, F.lit(size)))),
        lambda b: b != "",
    )
    return docs.select(key, F.posexplode(blocks).alias("block_id", "content"))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def doc_id_from_hash(hash_col: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(hash_col, 8, 12))


def chunk_content_id(doc_id: Column, page: Column, text: Column) -> Column:
    raw = F.concat_ws(":", doc_id.cast("string"), page.cast("string"), F.substring(text, 1, 100))
    return F.concat(F.lit("chunk_"), F.substring(F.md5(raw), 1, 12))


def prepare_load_rows(chunks: DataFrame, archive: str, corpus: str, min_chars: int = 40) -> DataFrame:
    """Rows for the flat chunk table: NULs removed, short text dropped, ids filled."""
    text = tx.remove_nul(tx.strip(F.coalesce("content", F.lit(""))))
    rel = tx.remove_nul(F.translate(F.coalesce("source_relative_path", F.lit("")), "\\", "/"))
    fallback = F.substring(F.md5(F.concat_ws(":", rel, F.substring(text, 1, 80))), 1, 16)
    doc = F.coalesce(F.nullif("doc_id", F.lit("")), tx.base_name(rel))
    meta = ["company_id", "project_id", "department_id", "classification"]
    return chunks.select(
        F.coalesce(F.nullif("chunk_id", F.lit("")), fallback).alias("chunk_id"),
        doc.alias("doc_id"),
        F.when(rel != "", F.concat(F.lit(archive + "/"), rel)).otherwise(doc).alias("doc_path"),
        text.alias("content"),
        F.coalesce("page", F.lit(0)).alias("page"),
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in ["corpus_id", "source_relative_path", *meta]]),
            F.array(F.lit(corpus), rel, *[F.col(m) for m in meta]),
        ).alias("metadata"),
    ).where(F.length("content") >= min_chars)


def row_to_chunk(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Flat table row -> chunk; missing metadata takes the defaults."""
    m = lambda k: F.coalesce(F.nullif(F.col("metadata")[k], F.lit("")), F.lit(defaults.get(k)))
    rel = F.translate(
        F.coalesce(
            F.nullif("doc_path", F.lit("")), F.nullif(F.col("metadata")["doc_path"], F.lit("")), "doc_id", F.lit("")
        ),
        "\\",
        "/",
    )
    name = F.when(rel != "", tx.base_name(rel)).otherwise(F.coalesce("doc_id", "chunk_id"))
    return rows.select(
        "chunk_id",
        F.coalesce(F.nullif("doc_id", F.lit("")), name).alias("doc_id"),
        *[m(k).alias(k) for k in ("company_id", "project_id", "department_id", "classification")],
        F.coalesce("content", F.lit("")).alias("content"),
        rel.alias("source_relative_path"),
        name.alias("file_name"),
        "page",
    )


def citation(snippet_chars: int = 280) -> Column:
    """Citation struct of a chunk row; path and file name only when the path is known."""
    rel = F.nullif("source_relative_path", F.lit(""))
    return F.struct(
        F.col("doc_id"),
        F.coalesce("page", F.lit(1)).alias("page"),
        F.col("start_offset"),
        F.col("end_offset"),
        F.substring(F.coalesce("content", F.lit("")), 1, snippet_chars).alias("snippet"),
        rel.alias("relative_path"),
        F.when(rel.isNotNull(), tx.base_name(rel)).alias("file_name"),
    )


def analysis_citation() -> Column:
    rel = F.coalesce("source_relative_path", F.lit(""))
    return F.struct(
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.substring(F.coalesce("content", F.lit("")), 1, 1200).alias("snippet"),
        tx.base_name(rel).alias("file_name"),
        rel.alias("relative_path"),
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Remove NUL characters from string and string-map columns."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "string":
            out[f.name] = tx.remove_nul(F.col(f.name))
        elif kind == "map<string,string>":
            out[f.name] = F.transform_values(f.name, lambda k, v: tx.remove_nul(v))
        elif kind == "array<string>":
            out[f.name] = F.transform(f.name, tx.remove_nul)
    return df.withColumns(out) if out else df


def fill_template(template: Column, fields: Column) -> Column:
    """Replace ``{{key}}`` from a string map; unknown keys stay."""
    keys = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))
    marks = F.filter(keys, lambda k: fields[k].isNotNull())
    return F.aggregate(
        marks, template, lambda text, k: F.replace(text, F.concat(F.lit("{{"), k, F.lit("}}")), fields[k])
    )


def fill_citation_scores(citations: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Missing scores from the position in the list."""
    pos = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    default = F.round(F.greatest(F.lit(0.35), F.lit(0.92) - pos * F.lit(0.08)), 3)
    return citations.withColumn("score", F.coalesce("score", default))


def report_task(path: Column, text: Column, min_chars: int = 80) -> Column:
    """Analysis task by extension; null for short text."""
    from folioframe import fixed_values as fx

    task = F.coalesce(tx.lookup(fx.REPORT_TASKS, tx.suffix(path)), F.lit(fx.DEFAULT_REPORT_TASK))
    return F.when(F.length(text) >= min_chars, task)
