"""Nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample so that their lists come out alike in size.
They stay in memory with a graph of their nearest neighbours, which a beam search walks.
A vector is put on the list of its nearest centroid and, near a border, on the lists of
others that lie about as close, unless a chosen centroid already covers that direction.
A query reads the lists whose centroid is within a ratio of the distance at which the
lists so far hold enough rows: mostly that of the nearest, but a centroid that is the query
itself, or an outlier alone on its list, is passed over.
Scores on the lists are exact cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored

SAMPLE_ROWS = 20_000  # vectors that centroids are fitted on
SAMPLE_PER_LIST = 100
ROUNDS = 12
DEGREE = 24  # neighbours of a centroid in the graph
BEAM = 384  # centroids that a search keeps
COPIES = 6  # lists of a vector at most
NEAR = 0.12  # a vector is copied to centroids up to 1 + NEAR times the nearest distance
READ = 0.20  # a query reads lists up to 1 + READ times the distance at which they hold enough rows
SHARD_ROWS = 4096  # rows of a list, and queries of a list, that meet in one task
SLACK = 1e-9  # of the product that preselects rows before their exact score


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, each summed alike wherever it stands."""
    rows = np.ascontiguousarray(rows)
    norms = np.sqrt((rows * rows).sum(axis=1))
    return (rows * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors of ``dims`` finite components, not all zero."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    rows = flat.astype(np.float64).reshape(len(at), dims)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return at[good], rows[good]


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Index:
    """Unit centroids, their graph, and the centroids a search starts from."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, rows: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, that a beam search of the graph reaches."""
        n, k = len(rows), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        score = np.full((n, k), -np.inf)
        open_ = np.zeros((n, k), bool)

        def visit(q: np.ndarray, c: np.ndarray) -> None:
            new = ~seen[q, c]
            q, c = q[new], c[new]
            seen[q, c] = True
            score[q, c] = np.einsum("ij,ij->i", rows[q], self.centroids[c])
            open_[q, c] = True

        who = np.repeat(np.arange(n), len(self.entries))
        visit(who, np.tile(self.entries, n))
        while open_.any():
            # expand the open centroids that are still within the beam
            kth = np.partition(score, k - beam, axis=1)[:, k - beam]
            q, c = np.nonzero(open_ & (score >= kth[:, None]))
            open_[:] = False
            if not len(q):
                break
            visit(*_unique(np.repeat(q, self.graph.shape[1]), self.graph[c].ravel(), k))
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        best = np.take_along_axis(score, order, 1)
        return order, np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(best, -1, 1)))


def _unique(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.unique(q * k + c)
    return flat // k, flat % k


def fit(sample: np.ndarray, lists: int | None = None) -> Index:
    """Balanced centroids of unit vectors: an assignment is dearer the fuller a list is."""
    n = len(sample)
    k = max(1, min(n, lists or -(-n // SAMPLE_PER_LIST)))
    centroids = sample[np.linspace(0, n - 1, k).astype(int)].copy()
    weight = np.zeros(k)
    for _ in range(ROUNDS):
        own = (sample @ centroids.T - weight).argmax(axis=1)
        count = np.bincount(own, minlength=k)
        weight += 0.02 * (count * k / n - 1).clip(-1, 2)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    near = centroids @ centroids.T
    np.fill_diagonal(near, -2)
    graph = np.argsort(-near, axis=1, kind="stable")[:, : max(1, min(DEGREE, k - 1))]
    # a ring through all centroids keeps the graph in one piece
    graph = np.concatenate([graph, ((np.arange(k) + 1) % k)[:, None]], axis=1)
    return Index(centroids, graph, np.linspace(0, k - 1, min(k, 16)).astype(int))


def places(index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the lists that each unit vector is put on."""
    order, distance = index.search(rows, beam=4 * COPIES)
    out_row, out_list = [np.arange(len(rows))], [order[:, 0]]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * index.centroids @ index.centroids.T))
    chosen = [order[:, 0]]
    taken = [np.ones(len(rows), bool)]
    for j in range(1, order.shape[1]):
        c, d = order[:, j], distance[:, j]
        ok = d <= (1 + NEAR) * distance[:, 0]
        ok &= np.sum(taken, axis=0) < COPIES
        for other, used in zip(chosen, taken):
            ok &= ~used | (apart[c, other] >= 0.9 * d)  # else that list covers the direction
        chosen.append(c)
        taken.append(ok)
        out_row.append(np.flatnonzero(ok))
        out_list.append(c[ok])
    return np.concatenate(out_row), np.concatenate(out_list)


def reads(index: Index, rows: np.ndarray, held: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the lists that each unit query reads.

    ``held``: rows of each list, each row counted once over all lists.  A query reads on
    until its lists hold ``least`` rows, or all lists if there are fewer.
    """
    order, distance = index.search(rows)
    if held is None:
        held, least = np.ones(len(index.centroids), np.int64), 0
    row, where = _within(order, distance, held, least)
    short = np.flatnonzero(held[order].sum(axis=1) < least) if order.shape[1] < len(index.centroids) else []
    if len(short):  # all that the beam reached is not enough
        row, where = row[~np.isin(row, short)], where[~np.isin(row, short)]
        more, lists = _within(*index.search(rows[short], len(index.centroids)), held, least)
        row, where = np.concatenate([row, short[more]]), np.concatenate([where, lists])
    return row, where


def _within(order: np.ndarray, distance: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    upto = np.minimum((held[order].cumsum(axis=1) < least).sum(axis=1), order.shape[1] - 1)
    row, j = np.nonzero(distance <= (1 + READ) * distance[np.arange(len(order)), upto, None] + 1e-12)
    return row, order[row, j]


# --- Spark ----------------------------------------------------------------------------------------


def _dimensions(vectors: DataFrame, vec_col: str) -> int:
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = SAMPLE_ROWS) -> tuple[Index | None, int]:
    """(index, dimensions): centroids of the ``rows`` vectors whose ids have the smallest hash.

    Only the sample comes to the driver: ``rows`` vectors.
    """
    dims = _dimensions(vectors, vec_col)
    sample = vectors.where((F.size(vec_col) == dims) & F.col(id_col).isNotNull()).select(id_col, vec_col)
    sample = sample.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(vec_col).toArrow()
    parts = [usable(c, dims)[1] for c in sample.column(0).chunks] if dims else []
    found = np.concatenate(parts) if parts else np.zeros((0, dims))
    return (fit(unit(found)) if len(found) else None), dims


def _listed(index, dims: int, route):
    """(list, id, vector, own) rows: the usable vectors on the lists that ``route`` names.

    ``own`` marks the first pair of a vector: its nearest list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = usable(batch.column(1), dims)
            for low in range(0, len(at), 2048):
                row, where = route(index.value, unit(rows[low : low + 2048]))
                flat = rows[low : low + 2048][row]
                blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dims), len(flat), [None, pa.py_buffer(flat.tobytes())])
                ids = batch.column(0).take(pa.array(at[low : low + 2048][row]))
                own = np.zeros(len(row), bool)
                own[np.unique(row, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), ids.cast(pa.int64()), blobs.cast(pa.binary()), pa.array(own)],
                    names=["list", "id", "vector", "own"],
                )

    return run


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The ``k`` best rows of each query: exact scores of all that the product may rank so high."""
    out = []
    approx = unit(queries) @ unit(rows).T
    approx[query_ids[:, None] == ids[None, :]] = -np.inf
    for q, line in zip(range(len(queries)), approx):
        n = min(k, int(np.isfinite(line).sum()))
        if not n:
            continue
        near = np.flatnonzero(line >= np.partition(line, len(line) - n)[len(line) - n] - SLACK)
        score = exact_cosine(queries[q], rows[near])
        order = np.lexsort((ids[near], -score))[:n]
        out.append((np.full(n, query_ids[q]), ids[near][order], score[order]))
    return out


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found nearest to each query by cosine.

    Every usable row is indexed.  Vectors that are null, zero, of another length than
    most, or hold a null or non-finite component take no part, nor do null ids; rows
    with one id count once, with their best score.  A query is no neighbour of itself.
    Ties go to the smaller id.  Other columns are ignored.

    A list of many rows (one vector may make up a third of them) is dealt in shards, and
    so are the queries that read it; a task joins one shard with one part of the queries.
    """
    spark = vectors.sparkSession
    index, dims = build(vectors, id_col, vec_col)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)  # at most SAMPLE_ROWS / SAMPLE_PER_LIST centroids
    schema = "list int, id long, vector binary, own boolean"
    usable_ids = lambda df: df.where(F.col(id_col).isNotNull()).select(id_col, vec_col)
    posted = stored(usable_ids(vectors).mapInArrow(_listed(shared, dims, places), schema), "lists")
    # an id counts on one list only, so that lists read together hold as many other rows as they say
    homes = posted.where("own").groupBy("id").agg(F.min("list").alias("list")).groupBy("list").count()
    held = np.zeros(len(index.centroids), np.int64)
    for r in homes.collect():  # a row per list
        held[r["list"]] = r["count"]
    enough = lambda index, rows: reads(index, rows, held, k + 1)  # the query itself may be among them
    asked = stored(usable_ids(queries).mapInArrow(_listed(shared, dims, enough), schema), "asked")

    def sizes(df: DataFrame) -> dict[int, int]:
        """Parts of each list: a row per list, so as many as there are centroids."""
        return {r["list"]: -(-r["count"] // SHARD_ROWS) for r in df.groupBy("list").count().collect()}

    shards, turns = sizes(posted), sizes(asked)
    both = sorted(shards.keys() & turns.keys())
    counts = lambda: F.broadcast(spark.createDataFrame([(c, shards[c], turns[c]) for c in both], "list int, shards int, turns int"))
    own = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    posted, asked = posted.drop("own"), asked.drop("own")
    posted = posted.join(counts(), "list").withColumn("shard", own("shards")).withColumn("turn", each("turns"))
    asked = asked.join(counts(), "list").withColumn("turn", own("turns")).withColumn("shard", each("shards"))

    def join(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        matrix = lambda pdf: np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(pdf), dims)
        found = _best(mine["id"].to_numpy(), matrix(mine), theirs["id"].to_numpy(), matrix(theirs), k)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    keys = ["list", "shard", "turn"]
    found = asked.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(join, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
