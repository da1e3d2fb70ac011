"""Top-k per group, spelled so that Spark keeps k rows per group before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.session import cut, shuffles

#: Scores are compared at this many decimals, so that the order of summing can't reorder ties.
DECIMALS = 9


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best_first(score: str = "score", decimals: int = DECIMALS) -> Column:
    return F.round(score, decimals).desc()


def placed(rows: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """The rows sorted by the keys over the whole cluster and written, with a long that rises along that order (with gaps where a partition ends)."""
    spread = rows.repartitionByRange(shuffles(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(spread.withColumn(place, F.monotonically_increasing_id()))
