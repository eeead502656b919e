"""Rows dealt out over the tasks before costly work on each."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Rows of one partition, about, where the caller knows the rows.
ROWS = 500_000


def spread(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """``df`` dealt out by a hash of ``columns``, by default all of them.

    A Parquet row group is read by one task, so a table of few row groups keeps few cores busy whatever is done to a row.  Pays where
    the work on a text costs more than to shuffle it once.  The number of partitions is that of all shuffles and is said: adaptive
    execution would join them to about as many as there are cores, by bytes, and one more than that takes twice the time.

    With the number of ``rows``, a partition has at most `ROWS` of them on average: narrow rows compress so well that adaptive execution
    joins millions into a task, and all sorts and hash tables of a stage hold them at the same time.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    return df.repartition(n, *(columns or df.columns))
