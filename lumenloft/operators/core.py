"""Helpers of the relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloft.functions.core import col


def top1(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark drops all but the first rows of a group before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows that meet one of the predicates; none where there's no predicate."""
    return df.filter(reduce(lambda a, b: a | b, predicates)) if predicates else df.limit(0)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def range_of(df: DataFrame, column: str, value, *order: Column) -> DataFrame:
    """Rows of one parent in a stated order."""
    return df.filter(F.col(column) == value).orderBy(*order)


def last_n(df: DataFrame, order: list[Column], n: int, restore: list[Column]) -> DataFrame:
    """The last rows of an order, in that order: taken from the far end, so that only n rows are sorted in one place."""
    return df.orderBy(*order).limit(n).orderBy(*restore)


def same(a, b) -> Column:
    """Equal, or both null."""
    return col(a).eqNullSafe(col(b))


def locale_order(c, collation: str = "en_USA") -> Column:
    return F.collate(col(c), collation)
