"""Equi-joins whose probe side may hold one very frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.runtime import BROADCAST_ROWS, broadcast_if_small, small_enough

SALTS = 32
#: rows from which a key counts as frequent
FREQUENT_ROWS = 1_000_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    salts: int = SALTS,
    limit: int = BROADCAST_ROWS,
    frequent: int = FREQUENT_ROWS,
) -> DataFrame:
    """Join many rows to a lookup table that has one row per key.

    A lookup of proven size is broadcast and nothing is shuffled.  Beyond that
    the rows of frequent keys get a salt from their own content (stable under
    task retries) and only the lookup rows of these keys are repeated once per
    salt, so a hot key is spread over ``salts`` tasks.
    """
    if small_enough(lookup, limit):
        return rows.join(F.broadcast(lookup), keys, how)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= frequent)
    hot = broadcast_if_small(hot.select(*keys, F.lit(True).alias("__hot")))
    is_hot = F.coalesce("__hot", F.lit(False))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    matchless = F.lit(False)  # rows with a null key meet nothing and may lie anywhere
    for k in keys:
        matchless = matchless | F.col(k).isNull()
    salted = rows.join(hot, keys, "left").withColumn("__salt", F.when(is_hot | matchless, salt).otherwise(0)).drop("__hot")
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, keys, "left").withColumn("__salt", F.explode(places)).drop("__hot")
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
