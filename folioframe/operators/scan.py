"""Running values over long ordered groups.

A plain window sends a whole group to one task.  Here a group is cut into blocks
along its order: windows run per (group, block), one aggregated row per block gives
what earlier blocks carry in.  A group that holds a third of all rows is then the
work of many tasks, and the carry step only sees one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000


def block_of(order: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer order column."""
    return F.floor(order / rows)


def _join_carry(df: DataFrame, carry: DataFrame, key: list[str]) -> DataFrame:
    return df.join(carry, [*key, "_block"], "left")


def running_sums(df: DataFrame, key: list[str], order: list[str], **values: Column) -> DataFrame:
    """Inclusive running sums.  ``df`` has a ``_block`` column that follows the order."""
    w = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*key, "_block").agg(*[F.sum(v).alias(f"_c_{n}") for n, v in values.items()])
    carry = carry.withColumns({f"_c_{n}": F.sum(f"_c_{n}").over(before) for n in values})
    inner = df.withColumns({n: F.sum(v).over(w) for n, v in values.items()})
    out = _join_carry(inner, carry, key)
    return out.withColumns(
        {n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in values}
    ).drop(*[f"_c_{n}" for n in values])


def running_last(df: DataFrame, key: list[str], order: list[str], inclusive: bool = False, **values: Column) -> DataFrame:
    """Last non-null value up to (or before) each row.  ``df`` has a ``_block`` column."""
    end = 0 if inclusive else -1
    w = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    carry = df.groupBy(*key, "_block").agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_c_{n}") for n, v in values.items()]
    )
    carry = carry.withColumns({f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before) for n in values})
    inner = df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()})
    out = _join_carry(inner, carry, key)
    return out.withColumns({n: F.coalesce(n, f"_c_{n}") for n in values}).drop(*[f"_c_{n}" for n in values])
