"""An equi-join in which a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one row in so many are joined by broadcast; there are fewer of them than this.
SHARE = 1000


def heavy_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row per key and in ``weight`` how many of ``rows`` have the key.

    ``total`` is the number of ``rows``. The keys with more than total / SHARE of them are
    fewer than SHARE, so they are broadcast and their rows stay where they are; the rows of
    all other keys are shuffled, none of which is hot.
    """
    least = max(1, total // SHARE)
    heavy, light = keyed.filter(F.col(weight) > least).drop(weight), keyed.filter(F.col(weight) <= least).drop(weight)
    return rows.join(F.broadcast(heavy), on).unionByName(rows.join(light.hint("merge"), on))
