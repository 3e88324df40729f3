"""Dedup by order: consecutive repeats and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_repeats(rows: DataFrame, within: list[str], order: list[str], value: str) -> DataFrame:
    """rows without those whose value equals the one just before, within a group, in order; null equals null."""
    w = Window.partitionBy(*within).orderBy(*order)
    marked = rows.withColumn("__ls_first", F.row_number().over(w) == 1).withColumn("__ls_before", F.lag(value).over(w))
    return marked.filter(F.col("__ls_first") | ~F.col("__ls_before").eqNullSafe(F.col(value))).drop("__ls_first", "__ls_before")


def first_of_each(rows: DataFrame, within: list[str], key: Column, order: str) -> DataFrame:
    """The first row, in order, of each key within a group; an aggregate, so that hot keys combine before the shuffle."""
    picked = rows.groupBy(*within, key.alias("__ls_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__ls_row"))
    return picked.select("__ls_row.*")


def question_key(question: Column, length: int = 50) -> Column:
    """What tells two questions of a page apart: the first characters in lower case."""
    return F.left(F.lower(question), F.lit(length))
