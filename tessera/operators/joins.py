"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heaviest keys that are broadcast; a bound on the broadcast side whatever the input's size.
HOT_KEYS = 1024


def free_prefix(*columns: str) -> str:
    """The shortest run of two or more underscores that none of the columns begins with: names after it are free."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def left_join_unique(left: DataFrame, right: DataFrame, key: str, weight: str | Column, payload: list[str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """left ⟕ right on `key`, where right has each key once and `weight` says how many left rows it meets.

    The `hot_keys` heaviest right rows (a fixed number) are broadcast; all others are shuffled, so no shuffled key
    meets more than 1/hot_keys of the weight. Left rows settled by the broadcast get a key of their own for the
    shuffle and spread out. Null keys match nothing. right is read twice; pass a written table.
    Columns of the result: those of left, then `payload` (null where nothing matches).
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    p = free_prefix(*left.columns)
    right = right.where(F.col(key).isNotNull()).select(F.col(key).alias(f"{p}k"), weight.alias(f"{p}w"), F.struct(*payload).alias(f"{p}p"))
    hot = right.orderBy(F.desc(f"{p}w"), F.asc(f"{p}k")).limit(hot_keys).select(F.col(f"{p}k").alias(f"{p}hk"), F.col(f"{p}p").alias(f"{p}hp"))
    step = left.join(F.broadcast(hot), F.col(key) == F.col(f"{p}hk"), "left")
    own = F.concat(F.lit("\x00own"), F.monotonically_increasing_id().cast("string"))
    step = step.withColumn(f"{p}key", F.when(F.col(f"{p}hk").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(own))
    cold = right.join(F.broadcast(hot), F.col(f"{p}k") == F.col(f"{p}hk"), "left_anti").select(F.col(f"{p}k").cast("string").alias(f"{p}key"), f"{p}p")
    out = step.join(cold, f"{p}key", "left")
    return out.select(*(F.col(f"`{c}`") for c in left.columns), *(F.coalesce(F.col(f"{p}hp"), F.col(f"{p}p"))[c].alias(c) for c in payload))
