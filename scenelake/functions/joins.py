"""Joins of many rows with a few that are known of each scene, none of which brings a scene to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.naming import fresh

#: Tasks that share the rows of one key.
SALTS = 32


def spread_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left join right, which has one row for each ``by``, and so is repeated SALTS times: the rows of a key are dealt
    out in turn. Where Spark knows the right side to be small it is broadcast as ever."""
    salt = fresh([*left.columns, *right.columns], "_salt")
    left = left.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*by, salt], how).drop(salt)
