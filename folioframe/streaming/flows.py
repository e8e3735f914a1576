"""Streams: folder ingest, dedup, session state, circuit breaker, audit counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioframe import fixed_values as fx
from folioframe.operators import chunking as ch
from folioframe.operators import ingest as ig


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def stream_ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """New documents of a folder -> chunk table.

    Every batch writes its own folder under ``target``: a retried batch overwrites
    itself and a lost executor leaves no half-written table.  ``read_current`` gives
    the newest version of each document's chunks.
    """
    docs = spark.readStream.schema("doc_id string, text string, updated_at timestamp").json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = ig.latest_per_key(batch, ["doc_id"], ["updated_at"])
        chunks = ch.build_chunks(newest).withColumn("batch_id", F.lit(batch_id))
        chunks.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of the newest version of every document."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, ["doc_id", "batch_id"], "left_semi")


def resumable_import(
    spark: SparkSession, manifest_source: str, state: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Manifest files -> state table of changed entries; continues where it stopped.

    Each batch compares with the state so far and writes only what changed.
    """
    schema = "relative_path string, size_bytes bigint, mtime_ns bigint"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(manifest_source)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = ig.latest_per_key(batch, ["relative_path"], ["mtime_ns"])
        hpath = spark._jvm.org.apache.hadoop.fs.Path(state)
        exists = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)
        if exists:
            older = spark.read.parquet(state).where(F.col("batch_id") < batch_id)
            known = ig.latest_per_key(older, ["relative_path"], ["batch_id"])
            status = ig.manifest_diff(known, new, "relative_path", ["size_bytes", "mtime_ns"])
        else:
            status = new.select("relative_path", F.lit("new").alias("status"))
        changed = new.join(status.where(F.col("status").isin("new", "changed")), "relative_path")
        changed.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_dedup(rows: DataFrame, time_col: str = "ts", key: str = "content_hash", delay: str = "1 day") -> DataFrame:
    """First row of each content hash within the watermark (bounded state)."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


class SessionProcessor(StatefulProcessor):
    """Last turns and active documents of each session, whatever the order of arrival."""

    def __init__(self, keep: int = 24, docs: int = 8) -> None:
        self.keep, self.docs = keep, docs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn bigint, role string, content string")
        self.active = handle.getValueState("active", "turn bigint, doc_ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        at, active = self.active.get() if self.active.exists() else (-1, [])
        for pdf in rows:  # no more than the kept turns and one Arrow batch at a time
            new = pdf.sort_values("turn", kind="stable")
            held += zip(new["turn"].astype(int), new["role"], new["content"])
            held = sorted(held, key=lambda t: t[0])[-self.keep:]
            for turn, role, ids in zip(new["turn"], new["role"], new["doc_ids"]):
                cited = [d for d in (ids if ids is not None else []) if d]
                if role == "assistant" and cited and turn >= at:
                    at, active = int(turn), list(dict.fromkeys(cited))[: self.docs]
        self.turns.put(held)
        self.active.update((at, list(active)))
        yield pd.DataFrame(
            {
                "session_id": [key[0]],
                "turns_kept": [len(held)],
                "last_turn": [held[-1][0] if held else -1],
                "active_doc_ids": ["|".join(active)],
            }
        )

    def close(self) -> None:
        pass


def session_state(turns: DataFrame, keep: int = 24) -> DataFrame:
    """``turns``: session_id, turn, role, content, doc_ids -> state after each batch."""
    return turns.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(keep),
        outputStructType="session_id string, turns_kept bigint, last_turn bigint, active_doc_ids string",
        outputMode="Update",
        timeMode="None",
    )


class BreakerProcessor(StatefulProcessor):
    """Failure streaks of a run; emits a row when the breaker trips."""

    def __init__(self, limits: dict[str, int] | None = None) -> None:
        self.limits = {**fx.BREAKER, **(limits or {})}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "streaks", "failures bigint, same_error bigint, same_tool bigint, last_error string, last_tool string"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, errors, tools, error, tool = self.state.get() if self.state.exists() else (0, 0, 0, None, None)
        steps = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.step)
        tripped = []
        for r in steps:
            if r.success:
                failures = errors = tools = 0
                continue
            failures += 1
            errors, error = (errors + 1 if r.error_code == error else 1), r.error_code
            if r.tool_name:
                tools, tool = (tools + 1 if r.tool_name == tool else 1), r.tool_name
            if (
                failures >= self.limits["failure_threshold"]
                or errors >= self.limits["same_error_threshold"]
                or (r.tool_name and tools >= self.limits["same_tool_threshold"])
            ):
                tripped.append((key[0], int(r.step), failures, errors, tools))
        self.state.update((failures, errors, tools, error, tool))
        yield pd.DataFrame(tripped, columns=["run_id", "step", "failures", "same_error", "same_tool"])

    def close(self) -> None:
        pass


def breaker_state(steps: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``steps``: run_id, step, success, error_code, tool_name -> steps that trip.

    Within a batch steps may come in any order; a later batch holds later steps of a run.
    """
    return steps.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=BreakerProcessor(limits),
        outputStructType="run_id string, step bigint, failures bigint, same_error bigint, same_tool bigint",
        outputMode="Append",
        timeMode="None",
    )


def audit_counts(events: DataFrame) -> DataFrame:
    """Running count by event type (update mode)."""
    return events.groupBy("event_type").agg(F.count("*").alias("events"))
