"""What rankings share: constants of BM25, the default segmentation, the first rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25
CANDIDATES = 20


def tokens(text: Column) -> Column:
    """Default segmentation: lower case, blanks."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), "")


def top_rows(rows: DataFrame, k: int, *order: Column, rank: str = "rank", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
