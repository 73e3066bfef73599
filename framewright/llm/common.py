"""What several corpus operators share: the shared scratch folder and lineage cuts (from ``scratch``), hot-key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.scratch import shared_dir, stored  # noqa: F401

#: Groups larger than 1/HOT_SHARE of the rows are joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 5_000


def renamed(docs: DataFrame, carried: list[str], **named: Column) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns ``carried`` as c0, c1, ... and the columns ``named``; and the carried names by these.

    Operators work on such tables, so that no column of the caller meets one of theirs.
    """
    back = {f"c{k}": c for k, c in enumerate(carried)}
    return docs.select(*[docs[c].alias(k) for k, c in back.items()], *[v.alias(k) for k, v in named.items()]), back


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row per key, hot keys by broadcast.

    ``size`` in ``groups`` is the number of ``rows`` of that key. Keys with more than ``total / HOT_SHARE`` rows number
    at most HOT_SHARE, a bound that doesn't grow with the data, so they are broadcast; for the rest no key is hot.
    ``groups`` should be stored: it is read twice.
    """
    limit = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    hot_rows = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return hot_rows.unionByName(cold_rows)
