"""Small helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch of whole documents.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession) -> None:
    """Whole documents are long rows: the usual ten thousand of them in a batch are tens of megabytes in every
    task, on either side of the pipe. A setting that is lower already stays. The setting is the session's and is read
    when a plan runs, after the query that asked for it has returned, so it is not put back."""
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_1, name_2, ... that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)
