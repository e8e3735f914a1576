"""Best-fit packing of documents into bins of a fixed capacity, without conflicts.

A bin takes no two pieces of one source and no two of one cluster of duplicates.  Open
bins are kept in the order of what is left in them and carry two bitmaps, of the sources
and of the clusters they hold.  The search for a piece starts at the successor of its
length, the tightest bin that can take it, and goes on to the next until the bitmaps
show no conflict; only if no bin is left does a new one open.

Best fit is sequential, so rows are dealt by a hash of the id to shards of about
``SHARD_ROWS`` rows, packed independently, longest piece first.  A shard leaves the
bins of its end partly filled, which is a small share of its bins, at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored
from folioframe.llm.exact_dedup import exact_dedup

SHARD_ROWS = 8_000
STRIDE = 64  # bins that one step of the search looks at


class Bins:
    """Open bins of a shard, ordered by (what is left, bin number)."""

    def __init__(self, sources: int, clusters: int):
        self.left = np.zeros(0, np.int64)  # ascending
        self.bin = np.zeros(0, np.int64)
        self.source = [np.zeros(64, np.uint64) for _ in range(sources // 64 + 1)]  # a word of the bitmaps, by bin
        self.cluster = [np.zeros(64, np.uint64) for _ in range(clusters // 64 + 1)]
        self.count = 0

    def _held(self, maps: list[np.ndarray], bit: int, bins: np.ndarray) -> np.ndarray:
        return (maps[bit >> 6][bins] >> np.uint64(bit & 63)) & np.uint64(1) != 0

    def tightest(self, length: int, source: int, cluster: int) -> int:
        """Position of the first compatible bin from the successor on, or -1."""
        at, stride = int(np.searchsorted(self.left, length)), STRIDE
        while at < len(self.left):
            bins = self.bin[at : at + stride]
            clash = self._held(self.source, source, bins) if source >= 0 else np.zeros(len(bins), bool)
            if cluster >= 0:
                clash |= self._held(self.cluster, cluster, bins)
            free = np.flatnonzero(~clash)
            if len(free):
                return at + int(free[0])
            at += stride
            stride *= 4
        return -1

    def put(self, length: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """(bin number, offset in the bin) of a piece."""
        at = self.tightest(length, source, cluster)
        if at < 0:
            number, left = self.count, capacity
            self.count += 1
            if number >= len(self.source[0]):
                for maps in (self.source, self.cluster):
                    maps[:] = [np.concatenate([m, np.zeros_like(m)]) for m in maps]
        else:
            number, left = int(self.bin[at]), int(self.left[at])
            self.left = np.delete(self.left, at)
            self.bin = np.delete(self.bin, at)
        for maps, bit in ((self.source, source), (self.cluster, cluster)):
            if bit >= 0:
                maps[bit >> 6][number] |= np.uint64(1 << (bit & 63))
        rest = left - length
        if rest > 0:
            low, high = np.searchsorted(self.left, rest, "left"), np.searchsorted(self.left, rest, "right")
            at = low + int(np.searchsorted(self.bin[low:high], number))
            self.left = np.insert(self.left, at, rest)
            self.bin = np.insert(self.bin, at, number)
        return number, capacity - left


def _bits(values: pd.Series) -> np.ndarray:
    """Bit of each value in the bitmaps; -1 for null and for values that occur once."""
    codes, names = pd.factorize(values)
    often = np.bincount(codes[codes >= 0], minlength=len(names)) > 1
    place = np.where(often, np.cumsum(often) - 1, -1)
    return np.where(codes >= 0, place[codes] if len(names) else -1, -1)


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of a shard with their bins; ``pdf``: id, length, source, cluster.

    What a document has over a multiple of the capacity is one piece; each full
    capacity before it is a bin of its own.
    """
    pdf = pdf.sort_values(["id", "length", "source", "cluster"], kind="stable", na_position="first").reset_index(drop=True)
    length = pdf["length"].to_numpy(np.int64)
    full, rest = length // capacity, length % capacity
    source, cluster = _bits(pdf["source"]), _bits(pdf["cluster"])
    bins = Bins(int(source.max(initial=-1)) + 1, int(cluster.max(initial=-1)) + 1)
    order = np.argsort(-rest, kind="stable")
    order = order[(rest[order] > 0) | (full[order] == 0)]
    found = [(i, full[i], full[i] * capacity, rest[i], *bins.put(int(rest[i]), int(source[i]), int(cluster[i]), capacity)) for i in order]
    number = bins.count
    for i in np.flatnonzero(full):
        for k in range(int(full[i])):
            found.append((i, k, k * capacity, capacity, number, 0))
            number += 1
    out = pd.DataFrame(found, columns=["row", "piece", "start", "length", "bin", "offset"])
    out.insert(0, "id", pdf["id"].to_numpy()[out["row"].to_numpy(np.int64)] if len(out) else [])
    return out.drop(columns="row")


def pack(
    docs: DataFrame,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str = "cluster",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, shard, bin, offset.

    A document is laid out in characters; the piece ``[start, start + length)`` lies at
    ``offset`` of bin (shard, bin).  A document longer than ``capacity`` fills bins of
    its own and packs the rest.  An empty or null text is a piece of length 0.  A null
    source or cluster is in conflict with none.  Repeated rows are rows of their own.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("length"),
        F.col(source_col).cast("string").alias("source"),
        F.col(cluster_col).cast("string").alias("cluster"),
    )
    rows = stored(rows, "lengths")  # narrow, and counted before it is dealt
    shards = max(1, -(-rows.count() // shard_rows))
    # null ids are spread by what else the row holds
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("length", "source"))), F.lit(shards)).cast("int"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf, capacity)
        out.insert(4, "shard", np.int32(key[0]))
        return out.astype({"id": "Int64"})

    out = rows.groupBy("shard").applyInPandas(
        run, "id long, piece long, start long, length long, shard int, bin long, offset long"
    )
    return out.withColumnRenamed("id", id_col)


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``cluster``: the id that stays of the documents with the same text, null without another."""
    groups = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    groups = groups.select(F.col(id_col).alias("_id"), F.col("keep_id").alias("cluster")).distinct()
    return docs.drop("cluster").join(groups, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
