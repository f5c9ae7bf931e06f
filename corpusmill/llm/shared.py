"""Helpers that several training-data operators use: shared folder, distributed running totals, UTF-8 word spans."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return folder.rstrip("/")


#: Folders that this process has made below the shared one.
MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove_made(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes the folders made since MADE had that length, or the other; for when nothing will read them any more."""
    for path in MADE[since:until]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del MADE[since:until]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, so a lost executor costs a reread, not a rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (counted now); else a join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pieces(rows: int) -> int:
    """How many hash pieces to cut a table into: with the square root, neither a piece nor the table of totals grows fast."""
    return max(1, math.ceil(math.sqrt(rows)))


def running_start(df: DataFrame, size: str, out: str, order: list[str], by: list[str], piece: str) -> DataFrame:
    """Adds `out`: the sum of `size` over all rows of the same `by` that come before in the order (piece, *order).

    Two levels, so no key meets in one task: totals of each piece, their running sum, then a window inside each piece.
    The table of totals has one row for each (by, piece).
    """
    totals = df.groupBy(*by, piece).agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, piece]], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = None
    for c in [*by, piece]:
        e = df[c].eqNullSafe(totals[f"_k_{c}"])
        same = e if same is None else same & e
    joined = df.join(totals, same).drop(*[f"_k_{c}" for c in [*by, piece]])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_before")


def bounded_sample(df: DataFrame, key: str, rows: int, *ties: str) -> DataFrame:
    """At most `rows` rows, those with the least hashes of `key`. Rows beyond a hash that half as many again pass are dropped
    at the scan, so what reaches the driver does not grow with the number of partitions."""
    n = df.count()
    h = F.xxhash64(key, F.lit("sample"))
    df = df.withColumn("_h", h)
    if n > 2 * rows:
        df = df.filter(F.col("_h") < int(-(2**63) + 2**64 * min(1.0, 1.5 * rows / n)))
    return df.orderBy("_h", *ties).limit(rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = 1_000_000):
    """Ranges of rows with about `most` bytes each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


#: ASCII white space: what parts words here.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = ~BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that `word` marks; runs end with their row."""
    inside = word[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


LONG_SPAN = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        back = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in enumerate((_ODD, back)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, by one running sum over the bytes.

    Polynomials modulo 2^64 have known collisions from about a thousand bytes on, so long spans are hashed by BLAKE2b.
    """
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out
