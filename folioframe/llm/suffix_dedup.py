"""Removal of long byte strings that start more than once in a collection.

The construction is column-wise: one symbol per document and round is put in front of
the suffixes that are already in order.  The new order follows from the old one by a
stable sort on the new symbols (the mapping of the Burrows-Wheeler transform), and the
new common prefixes are one more than range minima of the old ones.

Over whole documents that takes as many rounds as the longest one has bytes, and every
round passes over all suffixes inserted so far.  Two things bound it here.  A window of
``WIDTH`` bytes has an anchor, the ``GRAM`` bytes in it with the smallest hash, so equal
windows have equal anchors at equal places: only contexts around one anchor can hold
equal windows, and they are aligned on it.  Aligned contexts need only the order of
their current suffixes, one each, so a round costs one step per context, there are about
two ``WIDTH`` rounds, and many anchors are built side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored
from folioframe.llm.shingles import mix

WIDTH = 400
GRAM = 64
SEGMENT = 1 << 20  # window starts that one pass handles
BATCH_CONTEXTS = 16_384  # contexts built side by side
HOT_CONTEXTS = 16_384  # anchors with more contexts are joined window by window

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int):
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + WIDTH + 1)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BACK))
    return _powers


class _Hashes:
    """Hashes of any range of a byte string."""

    def __init__(self, data: np.ndarray):
        forth, self.back = _power(len(data) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.back[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Per anchor: hash, hash of the context, first and last window start, place of the anchor.

    The context of an anchor runs from its first window start to the end of its last
    window; every window belongs to one anchor, the leftmost of equals.
    """
    out = []
    for low in range(0, max(0, len(data) - width + 1), SEGMENT):
        part = data[low : low + SEGMENT + width - 1]
        hashes = _Hashes(part)
        at = np.arange(len(part) - gram + 1)
        grams = hashes.of(at, at + gram)
        ranked = (grams & ~_PLACE) | at.astype(np.uint64)
        anchor = (_least(ranked, width - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        text = mix(hashes.of(first, last + width) + (anchor - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64))
        out.append((grams[anchor], text, first + low, last + low, anchor + low))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3


def repeated_starts(group: np.ndarray, texts: list[np.ndarray], anchor: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its windows also stands in another context of its group.

    ``anchor``: place of the anchor in each context, on which a group is aligned.
    Columns are inserted from the right.  ``order`` holds the contexts by (group, current
    suffix) and ``common`` the length of the prefix that each shares with the one before.
    """
    size = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    found = np.zeros(offset[-1], bool)
    stop, start = size - anchor, -anchor  # columns of a context, relative to its anchor
    enter = np.argsort(-stop, kind="stable")
    entering = -stop[enter]
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for column in range(int(stop.max(initial=0)) - 1, int(start.min(initial=0)) - 1, -1):
        new = enter[np.searchsorted(entering, -column - 1, "left") : np.searchsorted(entering, -column - 1, "right")]
        if len(new):
            # empty suffixes come first in their group and share nothing
            both = np.concatenate([new, order])
            shared = np.concatenate([np.zeros(len(new), np.int64), common])
            by = np.argsort(group[both], kind="stable")
            order, common = both[by], shared[by]
            behind = by < len(new)
            common[1:][behind[:-1]] = 0
        if not len(order):
            continue
        symbol = flat[offset[order] + anchor[order] + column]
        key = group[order] * 256 + symbol
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = key[1:] == key[:-1]
        # range minima of the old common prefixes between neighbours of the new order
        bounds = np.empty(2 * len(by), np.int64)
        bounds[0::2][1:], bounds[1::2][1:] = by[:-1] + 1, by[1:] + 1
        bounds[:2] = 0, 1
        low = np.minimum.reduceat(np.append(common, 0), bounds)[0::2]
        order = order[by]
        common = np.concatenate([[0], np.where(same, low[1:] + 1, 0)])
        after = np.append(common[1:], 0)
        hit = (np.maximum(common, after) >= width) & (column <= stop[order] - width)
        found[(offset[order] + anchor[order] + column)[hit]] = True
        stay = start[order] < column
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept):
                before = np.concatenate([[0], kept[:-1] + 1])
                common = np.minimum.reduceat(common[: kept[-1] + 1], before)
            else:
                common = common[:0]
            order = order[kept]
    return [found[a : b - width + 1] for a, b in zip(offset, offset[1:])]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# --- Arrow passes -------------------------------------------------------------------------------


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v or b"", np.uint8) for v in column.cast(pa.binary()).to_pylist()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", "_t", "anchor", "context", "first", "last", "place"]
    for batch in batches:
        found, row = [], []
        for i, data in enumerate(_bytes(batch.column(2))):
            c = contexts(data)
            if len(c[0]):
                found.append(c)
                row.append(np.full(len(c[0]), i))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        at = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(_signed, columns)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, place, hot, data): the bytes of the wanted contexts of each text."""
    for batch in batches:
        rows = []
        for data, want in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            for w in want:
                rows.append((w["anchor"], w["context"], w["place"] - w["first"], w["hot"], (data or b"")[w["first"] : w["last"] + WIDTH]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "context", "place", "hot", "data"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, a, b): runs of repeated window starts, from rows sorted by anchor."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        flags = repeated_starts(group, [np.frombuffer(r[3], np.uint8) for r in rows], np.array([r[2] for r in rows], np.int64))
        out = [(r[0], r[1], a, b) for r, f in zip(rows, flags) for a, b in zip(*_runs(f))]
        columns = zip(*out) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "context", "a", "b"])

    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if not held or r[:2] != held[-1][:2]:  # repeated rows of a document give a context again
                held.append(r)
        if len(held) > BATCH_CONTEXTS:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield flush(held[:cut])
                held = held[cut:]
    if held:
        yield flush(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, start, side, w1, w2): every window of the contexts, by two hashes."""
    for batch in batches:
        out = []
        for anchor, context, place, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = np.frombuffer(data, np.uint8)
            at = np.arange(len(raw) - WIDTH + 1)
            other = _Hashes(raw ^ np.uint8(0x5A))
            full = lambda v: np.full(len(at), v, np.int64)
            out.append((full(anchor), full(context), at, at - place, _Hashes(raw).of(at, at + WIDTH), other.of(at, at + WIDTH)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
        yield pa.RecordBatch.from_arrays(list(map(_signed, columns)), names=["anchor", "context", "start", "side", "w1", "w2"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, spans, kept = [], [], []
        for data, cuts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            data = data or b""
            change = np.zeros(len(data) + 1, np.int64)
            for c in cuts or ():
                change[c["a"]] += 1
                change[c["b"]] -= 1
            covered = np.cumsum(change[:-1]) > 0
            a, b = _runs(covered)
            sizes.append(len(data))
            spans.append([{"start": x, "end": y + 1} for x, y in zip(a.tolist(), b.tolist())])
            kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
            names=["_id", "n_bytes", "spans", "kept"],
        )


# --- Spark ----------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, spans (maximal removed runs of bytes), kept (the bytes left).

    A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere else
    in the collection, in the same document or another; all strings are those of the
    input.  A null text is an empty one.  Repeated rows are documents of their own, so
    they repeat each other; ids may be null.  Other columns are ignored.

    Contexts that are equal as a whole need no construction: their count tells.  A text
    that thousands of documents share is one context, counted where it is read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn(
        "_t", F.xxhash64(F.coalesce("_text", F.lit("")))
    )
    kind = base.schema["_id"].dataType.simpleString()
    long_ = "anchor long, context long, first long, last long, place long"
    rows = stored(base.where(F.octet_length("_text") >= WIDTH).select("_id", "_t", "_text").mapInArrow(_scan, f"_id {kind}, _t long, {long_}"), "contexts")

    at = F.struct("_id", "_t", "first", "last", "place")
    single = rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(at).alias("at"))
    many = single.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    mixed = single.join(many, "anchor").select("at.*", "anchor", "context", (F.col("c") > HOT_CONTEXTS).alias("hot"))
    want = mixed.groupBy(F.col("_id").alias("_i"), F.col("_t").alias("_s")).agg(
        F.collect_list(F.struct("anchor", "context", "first", "last", "place", "hot")).alias("want")
    )
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_s"))
    cut = base.join(want, same).select("_text", "want").mapInArrow(_cut, "anchor long, context long, place long, hot boolean, data binary")
    some = cut.where("not hot").select("anchor", "context", "place", "data").repartition("anchor").sortWithinPartitions("anchor", "context")
    runs = some.mapInArrow(_build, "anchor long, context long, a long, b long")
    seen = cut.where("hot").select("anchor", "context", "place", "data").mapInArrow(
        _windows, "anchor long, context long, start long, side long, w1 long, w2 long"
    )
    key = ["anchor", "side", "w1", "w2"]
    twice = seen.groupBy(*key).agg(F.min("context").alias("x"), F.max("context").alias("y")).where("x != y").drop("x", "y")
    runs = runs.unionByName(seen.join(twice, key, "left_semi").select("anchor", "context", F.col("start").alias("a"), F.col("start").alias("b")))
    runs = runs.groupBy("anchor", "context").agg(F.collect_list(F.struct("a", "b")).alias("runs"))

    whole = single.where("n > 1").select("anchor", "context", F.lit(True).alias("all"))
    verdict = whole.join(runs, ["anchor", "context"], "full")
    marked = rows.join(verdict, ["anchor", "context"])
    spans = F.when(
        F.coalesce("all", F.lit(False)), F.array(F.struct(F.col("first").alias("a"), (F.col("last") + WIDTH).alias("b")))
    ).otherwise(
        F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + WIDTH).alias("b")))
    )
    marked = marked.select(F.col("_id").alias("_i"), F.col("_t").alias("_s"), F.explode(spans).alias("c"))
    cuts = marked.groupBy("_i", "_s").agg(F.collect_list("c").alias("cuts"))
    out = base.join(cuts, same, "left").select("_id", "_text", "cuts")
    out = out.mapInArrow(_apply, f"_id {kind}, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("_id", id_col)
