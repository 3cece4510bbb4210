"""Join strategies for sides whose size is not known when the plan is written.

`lookup_join` broadcasts the small side only after counting it (the count stops at the limit).
Beyond the limit it shuffles; keys that hold a large share of the big side are salted, so that
no single task receives a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
HOT_SHARE = 0.01
SALTS = 32


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most `limit` rows; reads no more than limit + 1."""
    return df.limit(limit + 1).count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; unhinted (shuffle, AQE decides) beyond it."""
    return F.broadcast(df) if fits(df, limit) else df


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[k] for k in keys])


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than `share` of the rows: at most 1/share rows by construction."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(F.broadcast(total), F.col("_n") > F.lit(share) * F.col("_all"))
        .select(*keys, F.lit(True).alias("_hot"))
    )


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join in which hot keys of the big side are spread over `salts` partitions.

    `how` may be inner or left (rows of the big side are kept); the small side is repeated only for
    the hot keys.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = F.broadcast(hot_keys(big, keys))
    row_salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if not _complex(big, c)]), F.lit(salts))
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), row_salt.cast("int")).otherwise(F.lit(0))
    )
    right = (
        small.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [*keys, "_salt"], how).drop("_salt")


def _complex(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Big ⋈ small: broadcast when the counted small side fits, salted shuffle otherwise."""
    if fits(small, limit):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how)
