"""File archives: manifest and text extraction from the binaryFile source."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe import fixed_values as fx
from folioframe.functions import text as tx
from folioframe.session import reuse, spread
from folioframe.sources import formats as fm

LISTING_TASKS = 8  # a core, of a listing; Spark's own limit is 10,000 whatever the machine


def import_action(extension: Column) -> Column:
    e = F.lower(extension)
    return (
        F.when(e.isin(fx.SKIP_EXTENSIONS), "skip")
        .when(e.isin(fx.INGEST_EXTENSIONS), "ingest_candidate")
        .otherwise("catalog_only")
    )


def manifest_columns(files: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """file_name, extension and import_action of a listing."""
    name = tx.base_name(F.col(path_col))
    ext = tx.suffix(F.col(path_col))
    return files.withColumns(
        {
            "file_name": name,
            "extension": F.when(ext == "", "(none)").otherwise(ext),
            "import_action": import_action(ext),
        }
    )


def write_archive(rows: DataFrame, root: str, keys: list[str], text: str = "value") -> None:
    """A text file a row under ``root/key=value/..``, as Spark's partitioned text writer names its folders.

    That writer pays for each file with temporary folders, checksums and renames, the last of them
    by the driver alone; on a local file system tasks write the files in place.  A task that is
    run again writes the same names, so it leaves no file twice.
    """
    spread_rows = spread(rows.select(*keys, text), *keys)
    local = _local_path(root)
    if local is None:
        spread_rows.write.partitionBy(*keys).text(root)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            names = []
            for folder, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[folder] += 1  # rows with the same keys are files of one folder
                os.makedirs(f"{local}/{folder}", exist_ok=True)
                names.append(f"{folder}/part-{part:05d}-{seen[folder]:05d}.txt")
                with open(f"{local}/{names[-1]}", "wb") as f:
                    f.write((value or "").encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    os.makedirs(local, exist_ok=True)
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), _folder_value(F.col(k).cast("string"))) for k in keys])
    reuse(spread_rows.select(folder.alias("folder"), text).mapInArrow(write, "file string"))


def _local_path(uri: str) -> str | None:
    """The path of a folder of the local file system, or of one mounted on all machines; else null."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", uri) else uri


def _folder_value(value: Column) -> Column:
    """A value in the name of a folder: null, empty and special characters as Spark writes them."""
    special = [chr(i) for i in range(1, 32)] + list("\"#'*/:=?\\\x7f{[]^")
    named = F.replace(value, F.lit("%"), F.lit("%25"))
    for c in special:
        named = F.replace(named, F.lit(c), F.lit(f"%{ord(c):02X}"))
    named = F.when(value.rlike(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]"), named).otherwise(value)
    return F.when(F.coalesce(value, F.lit("")) == "", "__HIVE_DEFAULT_PARTITION__").otherwise(named)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``; a listing of many folders is cut into as many tasks as the cores can use."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    tasks = min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)
    spark.conf.set(name, str(tasks))
    try:  # the files are listed here, not when they are read
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    finally:
        spark.conf.set(name, before)


def scan_archive(
    spark: SparkSession, root: str, compute_hash: bool = False, max_entries: int | None = None
) -> DataFrame:
    """Recursive listing -> manifest; content is read only when hashes are asked for."""
    files = _listed(spark, root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/*(?=/)", "")
    rel = F.substring(rel, F.lit(len(base) + 1), F.length(rel))
    cols = [rel.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")]
    if compute_hash:
        candidate = import_action(tx.suffix(rel)) == "ingest_candidate"
        hashed = F.when(candidate, F.concat(F.lit("sha256:"), F.sha2("content", 256)))
        cols.append(hashed.alias("content_hash"))
    out = manifest_columns(files.select(*cols))
    if max_entries is not None:
        out = out.orderBy("relative_path").limit(max_entries)
    return out


def temp_or_oversize(name: Column, size: Column, limit: int = fx.MAX_FILE_BYTES) -> Column:
    """skip_temp for editor lock files, too_large above the limit, else null."""
    return F.when(name.startswith("~$"), "skip_temp").when(size > limit, "too_large")


def confidence(method: Column, chars: Column) -> Column:
    """Confidence of an extraction from its method and length."""
    long_enough = lambda n, yes, no: F.when(chars > n, yes).otherwise(no)
    return (
        F.when(method == "plain_text", long_enough(0, 0.98, 0.0))
        .when(method == "rtf_strip", long_enough(20, 0.9, 0.3))
        .when(method == "docx_xml", F.when(chars == 0, 0.0).otherwise(long_enough(30, 0.95, 0.4)))
        .when(method.isin("xlsx_strings", "pptx_xml"), long_enough(20, 0.85, 0.3))
        .when(method == "xls_strings", long_enough(0, 0.4, 0.0))
        .when(method == "ppt_strings", long_enough(0, 0.35, 0.0))
        .when(method == "csv", long_enough(0, 0.9, 0.0))
        .when(method == "zip_inner", long_enough(40, 0.7, 0.25))
        .when(method == "sdr_text", long_enough(0, 0.65, 0.0))
        .when(method == "binary_decode", long_enough(0, 0.7, 0.0))
        .otherwise(0.0)
    )


def extract_text(files: DataFrame, key: str = "relative_path", custom=None) -> DataFrame:
    """(key, text, method, page_count, confidence, error) of (key, content) rows.

    The entries of a zip become rows that go through the same readers, and their texts
    are put together again in the order of the archive.  A damaged or encrypted file or
    entry gives no text and is named in ``error``.  ``custom`` maps a suffix to
    ``bytes -> text`` for formats the library does not read; such files otherwise come
    out with method ``unsupported``.
    """
    plug = dict(custom or {})
    inner = frozenset(fx.ZIP_INNER_EXTENSIONS)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["id"], pdf["content"]):
                rows = list(fm.members(bytes(raw or b""), inner)) or [(0, "", "", b"", None)]
                yield pd.DataFrame([(name, *r) for r in rows], columns=["id", "part", "name", "kind", "content", "error"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (plug[k](bytes(raw)), "custom", None) if k in plug else fm.read_text(bytes(raw or b""), k)
                for raw, k in zip(pdf["content"], pdf["kind"])
            ]
            out = pdf[["id", "part", "name"]].assign(text=[f[0] for f in found], method=[f[1] for f in found])
            yield out.assign(error=[f[2] if e is None else e for f, e in zip(found, pdf["error"])])

    rows = files.select(
        F.col(key).alias("id"), "content", tx.guess_suffix(F.col(key), F.col("content")).alias("kind")
    )
    zipped = (F.col("kind") == ".zip") if ".zip" not in plug else F.lit(False)
    row = "id string, part int, name string, kind string, content binary, error string"
    result = "id string, part int, name string, text string, method string, error string"
    no = F.lit(None).cast("string")
    single = rows.where(~zipped).select("id", F.lit(0).alias("part"), no.alias("name"), "kind", "content", no.alias("error"))
    single = single.mapInPandas(read, result).select("id", "text", "method", "error")
    entries = rows.where(zipped).select("id", "content").mapInPandas(unpack, row).mapInPandas(read, result)
    shown = F.when(F.col("text") != "", F.concat(F.lit("["), "name", F.lit("]\n"), "text"))
    # the entries of one file, as many as its directory lists
    joined = entries.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("part", shown.alias("text")))).alias("parts"), F.first("error", True).alias("error")
    )
    texts = F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t.isNotNull())
    archives = joined.select("id", F.array_join(texts, "\n\n").alias("text"), F.lit("zip_inner").alias("method"), "error")
    out = single.unionByName(archives).withColumnRenamed("id", key)
    readable = (F.col("method") != "unsupported") & ~((F.col("method") == "docx_xml") & (F.col("text") == ""))
    return out.withColumns(
        {
            "page_count": F.when(readable, 1).otherwise(0),
            "confidence": F.when(F.col("method") == "custom", 0.9).otherwise(
                confidence(F.col("method"), F.length("text"))
            ),
        }
    )
