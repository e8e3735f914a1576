"""Exact Jaccard join of shingle sets in metric space.

Jaccard distance is a metric, so a pivot bounds distances it was never asked for:
``|d(x, p) - d(y, p)| <= d(x, y)``.  Pivots cut a region into Voronoi cells; a set goes
to the cell of its nearest pivot and, as a boundary replica, to every cell whose pivot
is at most twice the bound farther away; cells are joined recursively and exactly
(:func:`join_region`).

Unrelated documents share no shingle and lie at distance 1 from every pivot, on all
borders at once.  So the first level of regions comes from a coarser metric with the
same property: the size of the symmetric difference.  The hash space of shingles is
cut into more classes than two linked sets can differ in shingles; each class of a set
is a point of its own, and linked sets coincide in at least one non-empty class.  Sets
that coincide with no other there have no link.  The connected rest are the top regions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import components, stored
from folioframe.llm.shingles import mix, shingle_sets

LEAF = 48  # sets that a cell compares without further pivots
PIVOTS = 8  # pivots of one cut
TASK_SETS = 1024  # sets of a block; a task joins two blocks at most


# --- size intervals and classes ------------------------------------------------------------


@lru_cache(maxsize=64)
def _starts(t: Fraction, upto: int) -> tuple[int, ...]:
    """Starts of size intervals: a linked partner lies in the same or a neighbouring one."""
    out = [1]
    while out[-1] <= upto:
        out.append(int(out[-1] / t) + 1)
    out.append(int(out[-1] / t) + 1)
    return tuple(out)


def _difference(t: Fraction, small_end: int) -> int:
    """Most shingles in which a set smaller than ``small_end`` and a larger linked one differ."""
    small = small_end - 1
    return int((1 - t) / (1 + t) * (small + int(small / t)))


@lru_cache(maxsize=4096)
def _classes(small: int, differ: int) -> int:
    """Classes of a level: so many that a set of ``small`` shingles fills more than ``differ``.

    The number of filled classes stays three standard deviations above ``differ``, so few
    sets have to show their empty classes, which say nothing about a text.
    """
    m = differ + 2
    while m < 4 * small:
        empty = exp(-small / m)
        spread = sqrt(max(0.0, m * empty * (1 - (1 + small / m) * empty)))
        if m * (1 - empty) - 3 * spread >= differ + 0.5:
            break
        m += 1
    return m


def class_keys(shingles: np.ndarray, t: Fraction) -> np.ndarray:
    """Keys of a set; two linked sets that are not equal share at least one.

    Two linked sets disagree in at most ``differ`` classes.  A set that fills more than
    those agrees with its partner in a filled class, so its empty classes are no keys.
    Only a set that fills fewer emits them; two such sets agree in some class, as there
    are more than ``differ`` of them.
    """
    n = len(shingles)
    starts = _starts(t, 1 << max(n, 1).bit_length())
    own = int(np.searchsorted(starts, n, side="right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles + np.uint64(1)))])
    out = []
    for level in (own - 1, own):
        if level < 0:
            continue
        differ = _difference(t, starts[level + 1])
        if differ == 0:
            continue  # only equal sets can be linked
        m = _classes(starts[level], differ)
        cut = np.searchsorted(shingles, (np.arange(m, dtype=np.uint64) * np.uint64((1 << 64) // m)))
        ends = np.append(cut[1:], n)
        keys = mix(mix(total[ends] - total[cut] + np.uint64(level)) + np.arange(m, dtype=np.uint64))
        full = ends > cut
        out.append(keys[full] if full.sum() > differ else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set_id(shingles: np.ndarray) -> tuple[int, int]:
    a = mix(shingles + np.uint64(11)).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return a, b


# --- Arrow passes over the texts --------------------------------------------------------------


def _raw(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = [], [], []
            for s in shingle_sets(_raw(batch.column(1)), width):
                n.append(len(s))
                x, y = _set_id(s)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _longs(a), _longs(b)], names=["id", "n", "h1", "h2"]
            )

    return run


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _keys(width: int, t: Fraction):
    """(key, set, peer): one row per key of an Arrow batch, with its smallest set.

    Further sets of the batch with the same key become candidate links to that one
    (``peer``, under a key of their own), so a key that a third of all rows hold
    reaches the shuffle once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for s in shingle_sets(_raw(batch.column(0)), width):
                k = class_keys(s, t)
                keys.append(k)
                owners.append(np.full(len(k), _set_id(s)[0], np.uint64))
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            owner = np.concatenate(owners) if owners else np.zeros(0, np.uint64)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            lead = owner[head][np.cumsum(head) - 1] if len(key) else owner
            link = lead != owner
            links = np.unique(np.stack([owner[link], lead[link]], 1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    _longs(np.concatenate([key[head], mix(links[:, 0] + np.uint64(7))])),
                    _longs(np.concatenate([owner[head], links[:, 0]])),
                    pa.concat_arrays([pa.nulls(int(head.sum()), pa.int64()), _longs(links[:, 1])]),
                ],
                names=["key", "set", "peer"],
            )

    return run


# --- the exact join of one region ---------------------------------------------------------------


class _Region:
    """Sets of a region as one array of codes, and the classes found so far."""

    def __init__(self, sets: list[np.ndarray], bound: tuple[int, int]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        vocabulary, codes = np.unique(flat, return_inverse=True)
        self.codes = codes
        self.mark = np.zeros(len(vocabulary), bool)
        self.above, self.below = bound  # a link: below * intersection >= above * union
        self.eps = 1 - bound[0] / bound[1]
        self.root = np.arange(len(sets))
        self._rare: tuple[np.ndarray, ...] | None = None

    def sharing_rare(self, i: int) -> np.ndarray:
        """The sets that share one of the rarest shingles of set ``i``: all that can be linked with it are among them.

        A linked set holds ``t`` of all shingles of ``i`` and the other way round.  So in one order of all
        shingles their first common one is among the first ``n - ceil(t * n) + 1`` of both.
        """
        if self._rare is None:
            n = len(self.mark)
            order = np.argsort(np.bincount(self.codes, minlength=n), kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            owner = np.repeat(np.arange(len(self.size)), self.size)
            keys = np.sort(owner * n + rank[self.codes])
            first = self.size + self.size * -self.above // self.below + 1
            kept = np.arange(len(keys)) - self.start[owner] < first[owner]
            owner, mine = owner[kept], keys[kept] % max(n, 1)
            count = np.bincount(mine, minlength=n)
            self._rare = mine, np.cumsum(first) - first, first, owner[np.argsort(mine, kind="stable")], np.cumsum(count) - count, count
        mine, at, first, held, start, count = self._rare
        own = mine[at[i] : at[i] + first[i]]
        own = own[count[own] > 1]
        times = count[own]
        return held[np.arange(times.sum()) + np.repeat(start[own] - (np.cumsum(times) - times), times)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def shared(self, i: int, others: np.ndarray, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Intersection sizes of set ``i`` with ``others``, whose codes are given."""
        own = self.codes[self.start[i] : self.start[i + 1]]
        self.mark[own] = True
        counts = np.add.reduceat(self.mark[codes].astype(np.int32), start) if len(others) else np.zeros(0, np.int32)
        self.mark[own] = False
        return counts

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[which]
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        at = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(self.start[which], size)
        return self.codes[at], start

    def link(self, i: int, others: np.ndarray, shared: np.ndarray) -> None:
        union = self.size[i] + self.size[others] - shared
        for j in others[self.below * shared >= self.above * union]:
            a, b = self.find(i), self.find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def join_region(sets: list[np.ndarray], bound: tuple[int, int]) -> np.ndarray:
    """Class of each non-empty set under links of similarity ``bound[0] / bound[1]`` or more.

    Exact: every pair within the bound is either compared or known to be in one class.
    """
    region = _Region(sets, bound)
    slack = 1e-9  # distances are doubles; the test of a link is in integers

    def leaf(which: np.ndarray, distance: np.ndarray) -> None:
        codes, start = region.gather(which)
        ends = np.append(start[1:], len(codes))
        place = np.full(len(region.size), -1)
        place[which] = np.arange(len(which))
        for k in range(len(which) - 1):
            i, rest = which[k], np.arange(k + 1, len(which))
            if len(which) > LEAF:  # a leaf that pivots could not cut: few of its pairs share a rare shingle
                rest = np.unique(place[region.sharing_rare(i)])
                rest = rest[rest > k]
            near = np.abs(distance[rest] - distance[k]).max(axis=1, initial=0.0) <= region.eps + slack
            other = which[rest]
            low, high = np.minimum(region.size[i], region.size[other]), np.maximum(region.size[i], region.size[other])
            near &= region.below * low >= region.above * high
            near &= region.root[other] != region.root[i]
            rest = rest[near]
            if len(rest):
                if len(rest) * 4 < len(which):
                    c, s = region.gather(which[rest])
                else:
                    c, s = codes[start[rest[0]] : ends[rest[-1]]], None
                if s is None:
                    inner = np.arange(rest[0], rest[-1] + 1)
                    n = region.shared(i, inner, c, start[inner] - start[rest[0]])[rest - rest[0]]
                else:
                    n = region.shared(i, rest, c, s)
                region.link(i, which[rest], n)

    def cut(which: np.ndarray, held: np.ndarray) -> None:
        if len(which) <= LEAF:
            leaf(which, held)
            return
        codes, start = region.gather(which)
        picked = np.unique(np.linspace(0, len(which) - 1, PIVOTS).astype(int))
        columns = []
        for k in picked:
            n = region.shared(which[k], which, codes, start)
            union = region.size[which[k]] + region.size[which] - n
            columns.append(1 - n / union)
            others = np.flatnonzero(which != which[k])
            region.link(which[k], which[others], n[others])
        d = np.stack(columns, 1)
        home = d.argmin(axis=1)
        nearest = d[np.arange(len(which)), home]
        inside = d <= (nearest + 2 * region.eps + slack)[:, None]
        used = np.unique(home)
        if inside[:, used].sum() > 1.5 * len(which):  # the pivots no longer tell these apart
            leaf(which, d)
            return
        for p in used:
            cell = inside[:, p]
            (cut if cell.sum() < len(which) else leaf)(which[cell], d[cell])

    filled = np.flatnonzero(region.size > 0)
    if len(filled) > 1:
        cut(filled, np.zeros((len(filled), 1)))
    return np.array([region.find(i) for i in range(len(sets))], np.int64)


def _join_task(width: int, bound: tuple[int, int]):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        sets = list(shingle_sets([t.encode() for t in pdf["text"]], width))
        root = join_region(sets, bound)
        ids = pdf["id"].to_numpy()
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})

    return run


def _task_keys(sizes: DataFrame) -> DataFrame:
    """(cell, blocks): how many blocks each region is cut into, from its size."""
    return sizes.groupBy("cell").agg(F.ceil(F.count("*") / TASK_SETS).cast("int").alias("blocks"))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 90,
) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id that links reach).

    Two documents are linked when ``100 * intersection >= percent * union`` of their
    sets of ``width``-word shingles.  Equal sets are joined as one.  A null or blank
    text has no set and no link.  Ids are integers and name a document: repeated rows
    (one id, one text) have one component, a null id is a document of its own.  Other
    columns are ignored.

    A region of more than ``TASK_SETS`` sets is dealt in blocks, a task per pair of
    blocks, so a task's memory does not grow with the region.
    """
    t = Fraction(percent, 100)
    bound = (percent, 100)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = stored(base.mapInArrow(_sizes(width), "id long, n long, h1 long, h2 long"), "sizes")
    same = ["h1", "h2", "n"]
    reps = sizes.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"))

    keyed = base.where("text is not null").select("text").mapInArrow(_keys(width, t), "key long, set long, peer long")
    lead = F.min(F.when(F.col("peer").isNull(), F.col("set"))).over(Window.partitionBy("key"))
    links = keyed.select(F.col("set").alias("a"), F.coalesce("peer", lead).alias("b")).where("a != b")
    cells = components(links).select(F.col("id").alias("h1"), F.col("root").alias("cell"))

    members = stored(reps.join(cells, "h1").select("rep", "cell"), "members")
    blocks = members.join(_task_keys(members), "cell")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # texts are dealt by id at every size; the members are not a side to broadcast
    text = base.join(blocks.hint("merge"), F.col("id") == F.col("rep"), "inner").dropDuplicates(["id"])
    # block i meets every block once: pairs (i, j) with i <= j
    text = text.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    text = text.select("id", "text", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    edges = text.groupBy("cell", "i", "j").applyInPandas(_join_task(width, bound), "a long, b long")
    found = components(edges).select(F.col("id").alias("rep"), F.col("root").alias("component"))

    reps = reps.join(found, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sizes.join(reps, same, "left")
    own = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id."""
    found = jaccard_components(docs, id_col, text_col, width, percent)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
