"""Arrow-batched functions that are built when first used, so that modules load without a session.

Use of one lowers the session's limits for Arrow batches to BATCH, so that a worker's
memory depends on a batch of bounded size and not on the rows of a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits for batches to BATCH where they are higher, for results are computed later."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def vectorised(result: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorates a function of pandas Series, with type hints, to one of columns with a result type."""

    def decorate(function: Callable) -> Callable[..., Column]:
        build = cache(lambda: F.pandas_udf(function, result))

        @wraps(function)
        def call(*columns: Column | str) -> Column:
            if spark := SparkSession.getActiveSession():
                small_batches(spark)
            return build()(*columns)

        return call

    return decorate
