"""List filters and lookups: one shape for all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE, DEFAULT_PAGE = 500, 50


def filtered(rows: DataFrame, equal: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Rows that equal each given value and contain each given text, letter case ignored; None asks for nothing."""
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.contains(F.lower(F.col(c)), F.lower(F.lit(v))) for c, v in (contains or {}).items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def paged(rows: DataFrame, order: list, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """A page in a unique order; limits are held between 1 and 500."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MAX_PAGE)))


def nested(rows: DataFrame, key: str, children: DataFrame, child_key: str, fields: list[str], order: list[str], name: str, most: int | None = None) -> DataFrame:
    """rows with their children as an array of structs in order, the first `most` of each; children are numbered before
    they are gathered, so no array outgrows its bound."""
    from pyspark.sql import Window

    if most is not None:
        w = Window.partitionBy(child_key).orderBy(*order)
        children = children.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    packed = children.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return rows.join(packed, key, "left")
