"""A join that no hot key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this, and than a MOST_HOT-th of all, are hot; so there are fewer than MOST_HOT of them.
LEAST_HOT, MOST_HOT = 1_000, 10_000


def split_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with table (one row a key) on key; `count` says how many of the `total` rows have the key, and is dropped.

    The table's hot keys, a bounded number, are broadcast, so their rows stay where they are; the other keys are joined by
    shuffle. Rows without a partner and null keys are dropped.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot = F.broadcast(table.filter(F.col(count) > limit).drop(count))
    cold = table.filter(F.col(count) <= limit).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
