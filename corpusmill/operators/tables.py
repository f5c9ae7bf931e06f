"""Tables written once and read many times, below the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new folder: it is computed once, each later use reads only its columns, and a lost executor costs a reread."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df, joined by sorting. A written table's few compressed megabytes may be millions of rows, which a broadcast would unpack on the driver."""
    return df.hint("merge")


#: Rows of keys that may be sent to all tasks.
SENT_ROWS = 200_000


def sent(keys: DataFrame, n: int | None = None) -> DataFrame:
    """Keys for a join, sent to all tasks where they are few (n, or counted), so that the other side's rows stay where they are."""
    return F.broadcast(keys) if (keys.count() if n is None else n) <= SENT_ROWS else keys


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go when its result is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Rows of a table that one task sorts, about.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys' hash in as many parts as its rows ask for. Numbers and flags pack so well in a shuffle that by its bytes Spark would join
    millions of such rows to one task, which sorts them unpacked. df is counted, so it should be a table as it was read."""
    n = -(-df.count() // TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def numbered(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Adds `out`: the rows' numbers, from 1, within `by` in the order of a column without ties. No task sees a whole group: rows are parted by
    ranges of (by, order), counted by part, and numbered within their part behind those before. The counts have a row for each (by, part)."""
    df = written(df, "rows")
    n = max(-(-df.count() // TASK_ROWS), 1)
    parts = written(df.repartitionByRange(n, *by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"), "_before")
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    number = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)) + F.coalesce("_before", F.lit(0))
    return parts.join(counts, same).withColumn(out, number.cast("int")).select(*df.columns, out)


#: Rows that are Python objects at once, and characters of made rows that wait to be handed on.
ROWS_READ, CHARS_HELD = 64, 1 << 20


def flat_map(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that `make` gives for each row's values. They are handed on as they come, so that a task's Python holds one Arrow batch and about
    CHARS_HELD characters of made rows, however many rows a batch or a row gives."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS_READ):
                for values in zip(*(c.to_pylist() for c in whole.slice(a, ROWS_READ).columns), strict=True):
                    for row in make(*values):
                        out.append(row)
                        held += ROWS_READ + sum(len(x) for x in row if isinstance(x, str))
                        if held >= CHARS_HELD:
                            yield batch(out)
                            out, held = [], 0
        if out:
            yield batch(out)

    return df.mapInArrow(job, schema)
