"""Exact search for the largest inner products: cover trees of data and of queries, walked together.

All rows are dealt down one tree of centres fitted on a bounded sample, queries and data
alike; what ends in one leaf, or a part of bounded size of a crowded leaf, is a block.  In
a block the rows get a cover tree, and so do the queries among them: a node has a centre
and the radius that covers its rows, halved from level to level.  A query first meets its
own block, which gives each group of queries a worst k-th score.  A pair of nodes is
pruned if even at the edges of both radii no product can reach that score:

    q . x <= a . b + r |b| + s |a| + r s     for |q - a| <= r and |x - b| <= s

First leaves of the top tree are held against each other, then the nodes of blocks that
remain.  Bounds leave room for rounding, and scores are whole numbers, so results are exact.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored

SAMPLE_ROWS = 16_384  # rows that the centres are chosen from
CENTRES = 2048  # leaves of the top tree at most
BLOCK_ROWS = 8192
FANOUT = 32  # children of a node at most; with more the node's rows are too spread to halve
LEAF_ROWS = 64
SAMPLE_NUMBERS = 1 << 21  # components of the sample at most
TURN_GROUPS = 256  # groups of queries that meet a block in one task
EXACT = 2.0**53  # below this sums of whole doubles are exact
LONG = 2**63 - 1


# --- whole numbers --------------------------------------------------------------------------------


def packed(row: np.ndarray) -> bytes:
    """Whole numbers in four bytes each if all fit, else as doubles."""
    return row.astype("<i4" if len(row) == 0 or np.abs(row).max() < 2.0**31 else "<f8").tobytes()


def unpacked(cells: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(cells), dims))
    for k, c in enumerate(cells):
        out[k] = np.frombuffer(c, "<i4" if len(c) == 4 * dims else "<f8", dims)
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, kept within a long."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if top < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(rows).T, -LONG, LONG).astype(np.int64)


# --- trees ----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Rows in the order of the leaves, and nodes as spans of that order.

    ``first[n]`` to ``last[n]`` are the children of node n (none for a leaf), ``lo[n]`` to
    ``hi[n]`` its rows; node 0 is the root.
    """

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def packed(self) -> bytes:
        return pickle.dumps(list(vars(self).values()))

    @classmethod
    def unpacked(cls, cell: bytes) -> Tree:
        return cls(*pickle.loads(cell))


def _away(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((rows - centre) ** 2).sum(axis=1))


def spread(rows: np.ndarray, most: int, until: float) -> np.ndarray:
    """Nearest centre of each row, where centres are rows taken farthest first until all are within ``until``."""
    near = np.zeros(len(rows), np.int64)
    far = _away(rows, rows[0])
    for k in range(1, most):
        at = int(far.argmax())
        if far[at] <= until:
            break
        new = _away(rows, rows[at])
        nearer = new < far
        near[nearer], far[nearer] = k, new[nearer]
    return near


def cover_tree(rows: np.ndarray) -> Tree:
    """Top down: the children of a node lie within half its radius, if ``FANOUT`` of them are enough."""
    rows = np.asarray(rows, np.float64)
    order = np.arange(len(rows))
    spans, kids, centres, radii = [(0, len(rows))], [(0, 0)], [], []
    at = 0
    while at < len(spans):
        lo, hi = spans[at]
        own = rows[order[lo:hi]]
        centre = own.mean(axis=0) if hi > lo else np.zeros(rows.shape[1])
        radius = float(_away(own, centre).max(initial=0))
        centres.append(centre)
        radii.append(radius)
        if hi - lo > LEAF_ROWS and radius > 0:
            near = spread(own, FANOUT, radius / 2)
            by = np.argsort(near, kind="stable")
            order[lo:hi] = order[lo:hi][by]
            sizes = np.bincount(near)
            if len(sizes) > 1:
                ends = lo + np.cumsum(sizes)
                kids[at] = (len(spans), len(spans) + len(sizes))
                spans += list(zip(ends - sizes, ends))
                kids += [(0, 0)] * len(sizes)
        at += 1
    spans, kids, centres = np.array(spans), np.array(kids), np.array(centres).reshape(len(spans), rows.shape[1])
    norm = _away(centres, np.zeros(rows.shape[1]))
    return Tree(order, centres, np.array(radii), norm, spans[:, 0], spans[:, 1], kids[:, 0], kids[:, 1])


def bound(a: np.ndarray, r: np.ndarray, na: np.ndarray, b: np.ndarray, s: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most that a product over pairs of nodes can be, with room for the rounding of the sums."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = (na[:, None] + r[:, None]) * (nb[None, :] + s[None, :])
        top = a @ b.T + r[:, None] * nb[None, :] + s[None, :] * na[:, None] + r[:, None] * s[None, :] + 1e-9 * size + 1e-6
    return np.nan_to_num(top, nan=np.inf, posinf=np.inf, neginf=-np.inf)


class Best:
    """The ``k`` best (score, id) of each query: higher scores first, then smaller ids.

    ``worst`` and ``last`` are score and id that a row has to beat; ``floor`` is the score
    as a bound for pruning, which is open while a query has fewer than ``k`` rows.
    """

    def __init__(self, ids: np.ndarray, k: int, worst: np.ndarray | None = None, last: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.worst = np.full(len(ids), -LONG - 1, np.int64) if worst is None else worst.copy()
        self.last = np.full(len(ids), LONG, np.int64) if last is None else last.copy()

    def floor(self, at: slice) -> float:
        worst = self.worst[at]
        return float(worst.min()) if len(worst) and worst.min() > -LONG else -np.inf

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``at`` with the rows ``ids``."""
        worst, last = self.worst[at][:, None], self.last[at][:, None]
        good = ((scores > worst) | ((scores == worst) & (ids[None, :] < last))) & (ids[None, :] != self.ids[at][:, None])
        for k in np.flatnonzero(good.any(axis=1)):
            hit = np.flatnonzero(good[k])
            hit = hit[np.lexsort((ids[hit], -scores[k, hit]))]
            q = at.start + int(k)
            mine = [(-int(scores[k, h]), int(ids[h])) for h in _firsts(hit, ids, self.k)]
            best: dict[int, int] = {}
            for score, i in sorted(self.found[q] + mine):
                best.setdefault(i, score)
            self.found[q] = sorted((score, i) for i, score in best.items())[: self.k]
            if len(self.found[q]) == self.k:
                score, i = self.found[q][-1]
                if (-score, -i) > (int(self.worst[q]), -int(self.last[q])):
                    self.worst[q], self.last[q] = -score, i


def _firsts(hit: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """The first ``k`` positions with different ids."""
    out, seen = [], set()
    for h in hit:
        if ids[h] not in seen:
            seen.add(ids[h])
            out.append(h)
            if len(out) == k:
                break
    return out


def dual_search(queries: np.ndarray, qtree: Tree, rows: np.ndarray, ids: np.ndarray, tree: Tree, best: Best) -> int:
    """Improve ``best`` by the rows: pairs of nodes are opened unless their bound is too low.

    ``queries`` and ``rows`` stand in the order of their trees.  Returns the number of products.
    """
    done = 0
    todo = [(0, np.zeros(1, np.int64))]  # a node of the queries and the nodes of the rows that it still meets
    opened = lambda nodes, which: np.concatenate([nodes[~which], *(np.arange(tree.first[n], tree.last[n]) for n in nodes[which])])
    while todo:
        q, nodes = todo.pop()
        at = slice(int(qtree.lo[q]), int(qtree.hi[q]))
        top = bound(qtree.centre[[q]], qtree.radius[[q]], qtree.norm[[q]], tree.centre[nodes], tree.radius[nodes], tree.norm[nodes])[0]
        able = top >= best.floor(at)
        nodes, top = nodes[able], top[able]
        if not len(nodes):
            continue
        inner = tree.last[nodes] > tree.first[nodes]
        if qtree.last[q] > qtree.first[q]:
            # rows that are spread wider than the queries are opened with them
            nodes = opened(nodes, inner & (tree.radius[nodes] >= qtree.radius[q]))
            todo += [(c, nodes) for c in range(qtree.first[q], qtree.last[q])]
        elif inner.any():
            todo.append((q, opened(nodes, inner)))
        else:
            by = np.argsort(-top, kind="stable")
            nodes, top = nodes[by], top[by]
            k, step = 0, 4
            while k < len(nodes) and top[k] >= best.floor(at):
                part = np.concatenate([np.arange(tree.lo[n], tree.hi[n]) for n in nodes[k : k + step]])
                best.offer(at, products(queries[at], rows[part]), ids[part])
                done += (at.stop - at.start) * len(part)
                k, step = k + step, 32
    return done


# --- Spark ----------------------------------------------------------------------------------------


def usable(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, floor(scale * x)) of the vectors of ``dims`` finite components."""
    at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        rows = np.floor(flat.astype(np.float64).reshape(len(at), dims) * scale)
    good = np.isfinite(rows).all(axis=1)
    return at[good], rows[good]


def _dealt(centres: np.ndarray | None, dims: int, scale: float):
    """(leaf, id, asks, salt, vector): each row under its nearest centre of the top tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at, rows = usable(batch.column(2), dims, scale)
            if centres is None:
                leaf = np.zeros(len(at), np.int32)
            else:
                with np.errstate(over="ignore", invalid="ignore"):
                    leaf = np.nan_to_num(rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)
            salt = np.arange(seen, seen + len(at), dtype=np.int64)
            seen += len(at)
            take = pa.array(at)
            columns = [pa.array(leaf), batch.column(0).take(take), batch.column(1).take(take), pa.array(salt), pa.array([packed(r) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "id", "asks", "salt", "vector"])

    return run


BLOCK = (
    "leaf int, part int, ids binary, rows binary, tree binary, q_ids binary, q_rows binary, q_tree binary, worst binary, last binary, "
    "floor double, reach double, found array<struct<query_id: bigint, vec_id: bigint, score: bigint>>"
)


def _built(centres: np.ndarray, dims: int, k: int):
    """The trees of a block, and what its own queries find in it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)

        def side(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Tree]:
            rows, ids = unpacked(part["vector"].tolist(), dims), part["id"].to_numpy(np.int64)
            tree = cover_tree(rows)
            return ids[tree.order], rows[tree.order], tree

        ids, rows, tree = side(pdf[~asks])
        q_ids, q_rows, q_tree = side(pdf[asks])
        best = Best(q_ids, k)
        if len(ids) and len(q_ids):
            dual_search(q_rows, q_tree, rows, ids, tree, best)
        reach = _away(rows, centres[key[0]]).max(initial=0) if len(rows) else -1.0
        found = [{"query_id": int(q), "vec_id": i, "score": -s} for q, f in zip(q_ids, best.found) for s, i in f]
        out = {"leaf": key[0], "part": key[1], "ids": ids.tobytes(), "rows": pickle.dumps([packed(r) for r in rows]), "tree": tree.packed()}
        out |= {"q_ids": q_ids.tobytes(), "q_rows": pickle.dumps([packed(r) for r in q_rows]), "q_tree": q_tree.packed()}
        out |= {"worst": best.worst.tobytes(), "last": best.last.tobytes(), "floor": best.floor(slice(0, len(q_ids))), "reach": float(reach), "found": found}
        return pd.DataFrame([out])

    return run


GROUP = "leaf int, part int, turn int, q_leaf int, q_part int, q_ids binary, q_rows binary, q_tree binary, worst binary, last binary"


def _sent(centres: np.ndarray, reach: dict[int, float], parts: dict[int, int], turns: int):
    """The queries of a block, once for each block in a leaf that could hold better rows for one of them."""
    leaves = np.array(sorted(reach), np.int64)
    far = np.array([reach[i] for i in leaves])
    norm = _away(centres[leaves], np.zeros(centres.shape[1]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                tree = Tree.unpacked(r.q_tree)
                top = bound(tree.centre[:1], tree.radius[:1], tree.norm[:1], centres[leaves], far, norm)[0]
                turn = zlib.crc32(f"{r.leaf}:{r.part}".encode()) % turns
                for leaf in leaves[top >= r.floor]:
                    for part in range(parts[int(leaf)]):
                        if (leaf, part) != (r.leaf, r.part):
                            out.append((int(leaf), part, turn, r.leaf, r.part, r.q_ids, r.q_rows, r.q_tree, r.worst, r.last))
                    if len(out) >= 64:
                        yield pd.DataFrame(out, columns=GROUP_COLUMNS)
                        out = []
            yield pd.DataFrame(out, columns=GROUP_COLUMNS)

    return run


GROUP_COLUMNS = [c.split()[0] for c in GROUP.split(", ")]
FOUND = "query_id long, vec_id long, score long"


def _met(dims: int, k: int):
    """Better rows that groups of queries find in a block."""

    def run(key: tuple, groups: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(groups) and len(block):
            ids = np.frombuffer(block["ids"].iloc[0], np.int64)
            rows, tree = unpacked(pickle.loads(block["rows"].iloc[0]), dims), Tree.unpacked(block["tree"].iloc[0])
            for g in groups.itertuples(index=False) if len(ids) else ():
                own = [np.frombuffer(b, np.int64) for b in (g.q_ids, g.worst, g.last)]
                best = Best(own[0], k, own[1], own[2])
                dual_search(unpacked(pickle.loads(g.q_rows), dims), Tree.unpacked(g.q_tree), rows, ids, tree, best)
                out += [(int(q), i, -s) for q, f in zip(own[0], best.found) for s, i in f]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_products(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product with each query.

    Components become ``floor(scale * x)``, with ``scale`` a power of two.  All rows are
    searched and the result is exact; ties go to the smaller id.  Vectors that are null,
    of another length than most, or hold a null component or one that is not finite
    (before or after scaling) take no part, nor do null ids.  Rows with one id count once,
    with their best score, and a query does not find its own id.  A score beyond a long
    counts as the nearest long.  Other columns are ignored; without vectors there is no row.

    A leaf that many rows fall in (one vector may make up a third of them) is dealt in
    parts.  What goes through the driver is the sample, and a few numbers for each of the
    at most ``CENTRES`` leaves.
    """
    spark = vectors.sparkSession
    named = lambda df, asks: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(asks).alias("asks"), F.col(vec_col).alias("vec"))
    rows = named(vectors, False).unionByName(named(queries, True))
    sizes = rows.where("vec is not null and not asks").groupBy(F.size("vec").alias("dims")).count()
    most = sizes.orderBy(F.desc("count"), "dims").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, n = most["dims"], most["count"]
    leaves = max(1, min(CENTRES, -(-n // BLOCK_ROWS)))
    schema = "leaf int, id long, asks boolean, salt long, vector binary"
    some = rows.where(~F.col("asks") & (F.size("vec") == dims)).orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, dims))))
    sample = unpacked([r["vector"] for r in some.mapInArrow(_dealt(None, dims, scale), schema).select("vector").collect()], dims)
    centres = _centres(sample, leaves) if len(sample) else np.zeros((1, dims))
    placed = stored(rows.mapInArrow(_dealt(centres, dims, scale), schema), "placed")

    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row per leaf
    parts = {leaf: -(-c // BLOCK_ROWS) for leaf, c in held.items()}
    in_parts = F.element_at(F.create_map(*[F.lit(v) for leaf in sorted(parts) for v in (leaf, parts[leaf])]), F.col("leaf")) if parts else F.lit(1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "salt"), in_parts).cast("int"))
    blocks = placed.groupBy("leaf", "part").applyInPandas(_built(centres, dims, k), BLOCK)
    blocks = stored(blocks, "blocks")

    reach = {r["leaf"]: r["reach"] for r in blocks.where("reach >= 0").groupBy("leaf").agg(F.max("reach").alias("reach")).collect()}
    groups = blocks.where(F.length("q_ids") > 0)
    turns = max(1, -(-groups.count() // TURN_GROUPS))
    parts = dict(parts)
    asked = groups.select("leaf", "part", "q_ids", "q_rows", "q_tree", "worst", "last", "floor")
    asked = asked.mapInPandas(_sent(centres, reach, parts, turns), GROUP)
    there = blocks.select("leaf", "part", "ids", "rows", "tree", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    keys = ["leaf", "part", "turn"]
    more = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_met(dims, k), FOUND)
    found = blocks.select(F.explode("found").alias("f")).select("f.*").unionByName(more)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Means of the rows next to centres that were taken farthest first."""
    near = spread(sample, most, 0.0)
    return np.array([sample[near == c].mean(axis=0) for c in range(near.max() + 1)])
