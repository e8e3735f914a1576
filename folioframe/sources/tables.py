"""JSON sources with explicit schemas, and report sinks."""

from __future__ import annotations

import csv
import io
import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "chunk_id string, doc_id string, company_id string, project_id string, department_id string, "
    "folder_id string, contractor_id string, classification string, language string, page int, "
    "start_offset int, end_offset int, content_preview string, source_relative_path string, "
    "source_file_name string, embedding_model string, indexed_at string"
)
ASSIGNMENT = (
    "assignment_id string, employee_id string, assignment_type string, company_id string, project_id string, "
    "project_role string, department_id string, valid_from string, valid_to string, status string"
)
ORG = {
    "companies": "company_id string, company_group_id string, company_type string, status string",
    "projects": "project_id string, primary_company_id string, status string",
    "departments": "department_id string, company_id string, project_id string, status string",
    "positions": "position_id string, company_id string, department_id string, is_manager boolean, status string",
    "project_roles": "role_id string, project_id string, status string",
    "employees": "employee_id string, company_id string, contractor_id string, clearance string, status string",
    "assignments": ASSIGNMENT,
}
FOLDER = (
    "folder_id string, storage_backend string, physical_path string, company_id string, project_id string, "
    "department_id string, access_tier string, default_classification string, status string"
)
GRANT = (
    "grant_id string, grant_type string, employee_id string, folder_id string, actions array<string>, "
    "valid_from string, valid_to string, status string"
)


def _entries(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """Rows of ``{"field": [...]}`` or of a bare list, in the order of the file."""
    return parse_entries(spark.read.text(path, wholetext=True), path, field, element)


def parse_entries(raw: DataFrame, path: str, field: str, element: str) -> DataFrame:
    """The same for rows whose ``value`` is a whole JSON document."""
    bare = F.regexp_like("value", F.lit(r"^\s*\["))
    wrapped = F.from_json("value", f"{field} array<struct<{_ddl(element)}>>")[field]
    listed = F.from_json("value", f"array<struct<{_ddl(element)}>>")
    rows = raw.withColumn("_rows", F.when(bare, listed).otherwise(wrapped))
    bad = F.raise_error(F.lit(f"neither a list nor an object with '{field}': {path}"))
    rows = rows.withColumn("_rows", F.when(F.col("_rows").isNull(), bad.cast(rows.schema["_rows"].dataType)).otherwise(F.col("_rows")))
    return rows.select(F.posexplode("_rows").alias("ordinal", "_r")).select("ordinal", "_r.*")


def _ddl(fields: str) -> str:
    """Column list -> struct field list."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(fields[start:i])
            start = i + 1
    parts.append(fields[start:])
    return ",".join(":".join(p.strip().split(" ", 1)) for p in parts)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from a JSON document; an error if the shape is neither of the two."""
    rows = _entries(spark, path, "chunks", CHUNK)
    return rows.withColumnRenamed("content_preview", "content")


def read_chunks_variant(spark: SparkSession, v1: str, v2: str, variant: str = "auto") -> DataFrame:
    """``auto`` prefers v2 when it exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    choice = {"v1": v1, "v2": v2}.get(variant) or (v2 if exists(v2) else v1)
    if not exists(choice):
        raise FileNotFoundError(choice)
    return read_chunks(spark, choice)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    return _entries(spark, path, "folders", FOLDER)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    return _entries(spark, path, "grants", GRANT)


def read_org_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One frame per entity array of the snapshot, each with its input ``ordinal``."""
    return {name: _entries(spark, path, name, ddl) for name, ddl in ORG.items()}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a nested catalog with their category."""
    doc = "doc_key string, title string, download_url string, monitor_urls array<string>"
    schema = f"categories array<struct<id:string,title:string,documents:array<struct<{_ddl(doc)}>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return flatten_catalog(raw)


def flatten_catalog(raw: DataFrame) -> DataFrame:
    cats = raw.select(F.explode("categories").alias("c"))
    return cats.select(F.coalesce("c.id", F.lit("")).alias("category_id"), F.explode("c.documents").alias("d")).select(
        "category_id", "d.*"
    )


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with recorded_at, live_progress, percent and totals; blank lines are skipped."""
    schema = (
        "recorded_at timestamp, live_progress bigint, percent double, "
        "ingest struct<total_candidates:bigint>, report struct<total:bigint>"
    )
    rows = spark.read.schema(schema).json(path)
    total = F.coalesce(F.nullif("ingest.total_candidates", F.lit(0)), "report.total", F.lit(0))
    return rows.where("recorded_at is not null").select("recorded_at", "live_progress", "percent", total.alias("total"))


def read_jsonl_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_snapshot(df: DataFrame, path: str, **extra: str) -> None:
    """Report rows as JSON with constant extra fields and the time of writing."""
    stamped = df.withColumns({**{k: F.lit(v) for k, v in extra.items()}, "recorded_at": F.current_timestamp()})
    stamped.write.mode("overwrite").json(path)


def write_corpus(chunks: DataFrame, path: str) -> None:
    """Replace only the corpora present in ``chunks`` (dynamic partition overwrite)."""
    (
        chunks.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("corpus_id")
        .parquet(path)
    )


def read_sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """Sheets exported as CSV -> (sheet, ordinal, values): all columns, cells with line breaks included.

    A sheet is one file, parsed as a stream of records; the row number is the place of
    the record in the file.  Records without any cell are left out.
    """
    raw = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1).alias("sheet"), "content"
    )

    def records(batches):
        for pdf in batches:
            for sheet, content in zip(pdf["sheet"], pdf["content"]):
                lines = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"), newline=""))
                rows = ((sheet, n, cells) for n, cells in enumerate(lines) if cells)
                while chunk := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame(chunk, columns=["sheet", "ordinal", "values"])

    cells = raw.mapInPandas(records, "sheet string, ordinal int, values array<string>")
    # an empty cell is no value
    return cells.withColumn("values", F.transform("values", lambda v: F.nullif(v, F.lit(""))))
