"""Vector columns (arrays of float or double), computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty, unequal or zero-length vectors."""
    n = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.coalesce(F.when(ok, dot(a, b) / n), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length 1 (unchanged when its length is 0)."""

    def scale(x: Column) -> Column:
        v, n = x["v"], x["n"]
        return F.when(n > 0, F.transform(v, lambda e: e / n)).otherwise(v)

    doubles = a.cast("array<double>")
    return let(F.struct(doubles.alias("v"), norm(doubles).alias("n")), scale)


def hash_bucket(token: Column, dims: int = 64) -> Column:
    """Reproducible bucket of a token."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dims))


def hash_embedding(c: Column, dims: int = 64) -> Column:
    """Bag-of-words vector of unit length over ``dims`` token buckets."""
    low = F.lower(F.coalesce(c, F.lit("")))
    toks = F.regexp_extract_all(low, F.lit("[a-zа-яё0-9]{3,}"), F.lit(0))
    # sorted buckets are counted in one pass: a pair is appended where the bucket changes
    buckets = F.sort_array(F.transform(toks, lambda t: hash_bucket(t, dims)))
    pair = lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"))
    kind = "struct<at:bigint,n:bigint,done:array<struct<at:bigint,n:bigint>>>"
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), none.alias("done")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        more = F.struct(s["at"].alias("at"), (s["n"] + 1).alias("n"), s["done"].alias("done"))
        done = F.when(s["at"] < 0, s["done"]).otherwise(F.array_append(s["done"], pair(s)))
        return F.when(s["at"] == x, more).otherwise(F.struct(x.alias("at"), F.lit(1).cast("bigint").alias("n"), done.alias("done")))

    pairs = F.aggregate(buckets, start, step, lambda s: F.array_append(s["done"], pair(s)))
    bins = F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint"))
    counts = let(
        F.map_from_entries(pairs), lambda m: F.transform(bins, lambda d: F.coalesce(m[d], F.lit(0)).cast("double"))
    )
    return let(counts, unit)
