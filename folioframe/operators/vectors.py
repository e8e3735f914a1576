"""Vector search and embedding upkeep."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import vectors as vx

BLOCK_ROWS = 2048  # query or chunk vectors of one block: 2048 x 768 doubles are 12 MB


def _matrix(column: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit rows) of the vectors of the right length."""
    usable = np.array([i for i, v in enumerate(column) if v is not None and len(v) == dims], dtype=int)
    rows = np.array([column.iloc[i] for i in usable], dtype=np.float64).reshape(len(usable), dims)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return usable, np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _block(df: DataFrame, key: str, name: str) -> DataFrame:
    """Deal rows to blocks of about ``BLOCK_ROWS`` within their scope, by a hash of the key."""
    sizes = df.groupBy("scope_id").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias(f"n_{name}"))
    dealt = df.join(sizes, "scope_id")
    return dealt.withColumn(name, F.pmod(F.xxhash64(key), F.col(f"n_{name}")).cast("int"))


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scopes: DataFrame | None = None,
    label_col: str = "label_id",
) -> DataFrame:
    """Exact cosine top-k: query_id, ``id_col`` (of any type), score, rank.

    ``queries``: query_id, vector, and scope_id where ``scopes`` (scope_id, label) is
    given; then a query meets only chunks whose label its scope holds, before ranking.

    Queries and chunks are dealt in blocks of a fixed size within a scope, and every
    pair of blocks is one task that returns its best ``k`` per query.  Nothing passes
    through the driver, and no row of a query with a chunk is made beyond those.
    """
    kind = chunks.schema[id_col].dataType.simpleString()
    rows = chunks.where(F.col(vec_col).isNotNull())
    if scopes is None:
        queries, rows = queries.withColumn("scope_id", F.lit(0)), rows.withColumn("scope_id", F.lit(0))
    else:
        held = scopes.select("scope_id", F.col(scopes.columns[1]).alias(label_col))
        rows = rows.join(held, label_col)
    scope = queries.schema["scope_id"].dataType.simpleString()
    rows = rows.select("scope_id", F.col(id_col).alias("_id"), F.col(vec_col).alias("_vector"))
    asked = queries.where(F.col("vector").isNotNull()).select("scope_id", F.col("query_id").cast("string").alias("query_id"), "vector")
    rows = rows.join(asked.select("scope_id").distinct(), "scope_id", "left_semi")
    rows, asked = _block(rows, "_id", "chunk_block"), _block(asked, "query_id", "query_block")
    n_rows = rows.select("scope_id", "n_chunk_block").distinct()
    n_asked = asked.select("scope_id", "n_query_block").distinct()
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias(name)
    rows = rows.join(n_asked, "scope_id").select("scope_id", "chunk_block", "_id", "_vector", spread("n_query_block", "query_block"))
    asked = asked.join(n_rows, "scope_id").select("scope_id", "query_block", "query_id", "vector", spread("n_chunk_block", "chunk_block"))

    def best(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for dims in sorted({len(v) for v in mine["vector"]}):
            at, queries_ = _matrix(mine["vector"], dims)
            theirs = theirs.sort_values("_id", kind="stable")
            found, rows_ = _matrix(theirs["_vector"], dims)
            if not len(found):
                continue
            scores = np.round(queries_ @ rows_.T, 6)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            parts.append(pd.DataFrame({
                "query_id": np.repeat(mine["query_id"].to_numpy()[at], top.shape[1]),
                "_id": theirs["_id"].to_numpy()[found[top.ravel()]],
                "score": np.take_along_axis(scores, top, 1).ravel(),
            }))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "_id": [], "score": []})

    keys = ["scope_id", "query_block", "chunk_block"]
    pairs = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, f"query_id string, _id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_id"))
    out = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("_id").alias(id_col), "score", "rank")


def stale_embeddings(chunks: DataFrame, dims: int) -> DataFrame:
    """Rows without an embedding, or with one of another length."""
    size = F.size("embedding")
    return chunks.where(F.col("embedding").isNull() | (size != dims))


def embed(chunks: DataFrame, text_col: str = "content", dims: int = 64, embedder=None) -> DataFrame:
    """Adds ``embedding``: an injected column function, or the hash embedding."""
    vector = embedder(F.col(text_col)) if embedder else vx.hash_embedding(F.col(text_col), dims)
    return chunks.withColumn("embedding", vector)
