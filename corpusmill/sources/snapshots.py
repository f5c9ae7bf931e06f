"""Versioned tables: documents replaced one by one, several tables in one commit.

Below a folder lie the tables' files, which are never changed, and one small JSON file for each version. A version says for each
table which folder holds each bucket of its key's hash. A commit writes the buckets of the documents it replaces
once more: their other documents' rows from the version before, as they lie in its files, and the new rows, dealt by bucket. Then it publishes its version file under the
next number, by a rename that fails where that number exists. So a reader has the version it began with, a failed
commit leaves nothing but files that no version names, and of two commits at a time one has to be made again.

The driver handles a row for each bucket; rows move only within the buckets that change, and old ones only once their files have become many and small.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.tables import sent

VERSIONS, DATA, BUCKET = "_versions", "data", "_bucket"


class Conflict(RuntimeError):
    """Another commit has published the version that this one was to be."""


@dataclass
class Change:
    """What a commit does to a table: the rows of `keys` go, `rows` come; where no keys are given, those of the rows are replaced.

    within: the rows are known to be of these keys. laid: they come from `by_bucket`, with its column."""

    rows: DataFrame
    key: str = "doc_id"
    keys: DataFrame | None = None
    buckets: int = 64
    within: bool = False
    laid: bool = False


@dataclass
class Version:
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _hadoop(spark, path)
    fs.delete(place, True)


def versions(spark: SparkSession, top: str) -> list[int]:
    """The published versions' numbers, rising."""
    fs, place = _hadoop(spark, f"{top}/{VERSIONS}")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))


def version(spark: SparkSession, top: str, number: int | None = None) -> Version:
    """A version, by default the last one; version 0 is empty."""
    if number is None:
        number = max(versions(spark, top), default=0)
    if not number:
        return Version()
    told = json.loads("\n".join(r[0] for r in spark.read.text(f"{top}/{VERSIONS}/{number}.json").collect()))
    return Version(number, told["tables"], told["notes"])


def publish(spark: SparkSession, top: str, new: Version) -> None:
    """Writes the version's file beside its place and renames it there; Conflict where that is taken."""
    fs, final = _hadoop(spark, f"{top}/{VERSIONS}/{new.number}.json")
    _, draft = _hadoop(spark, f"{top}/{VERSIONS}/.{new.number}-{uuid.uuid4().hex}")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"tables": new.tables, "notes": new.notes}).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {new.number} of {top} has been published by another commit") from e
        raise


def read(spark: SparkSession, top: str, table: str, number: int | None = None, of: Version | None = None, buckets: set[int] | None = None) -> DataFrame:
    """A table as a version has it; with `buckets`, only those of its key's hash."""
    told = (of or version(spark, top, number)).tables.get(table)
    if told is None:
        raise KeyError(f"no table {table} in {top}")
    schema = T.StructType.fromJson(told["schema"])
    paths = [f"{top}/{path}" for b, path in told["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


#: Parts of a bucket's keys that `by_bucket` can tell apart.
SHARES = 1_024


def by_bucket(rows: DataFrame, key: str, buckets: int, parts: int) -> DataFrame:
    """Rows dealt to so many parts by their key's hash, with the columns _bucket and _part. A part holds neighbouring buckets, or a share of one."""
    share = F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(key)), 32), F.lit(SHARES))
    rows = rows.withColumn(BUCKET, bucket(key, buckets))
    rows = rows.withColumn("_part", F.floor((F.col(BUCKET) * SHARES + share) * parts / (buckets * SHARES)).cast("int"))
    return rows.repartitionById(parts, F.col("_part"))


#: Bytes of a file that are worth one.
FILE_BYTES = 16 << 20


def _crowded(spark: SparkSession, top: str, paths: list[str]) -> bool:
    """Whether these folders' files are many for what they hold."""
    found = [s.getLen() for p in paths for fs, place in [_hadoop(spark, f"{top}/{p}")] for s in fs.listStatus(place)]
    return len(found) > 4 * (len(paths) + sum(found) // FILE_BYTES)


def _write(spark: SparkSession, top: str, name: str, change: Change, before: dict | None) -> tuple[dict, int]:
    """The table after the change, and how many buckets were written."""
    key, n = (before["key"], before["count"]) if before else (change.key, change.buckets)
    if key != change.key:
        raise ValueError(f"table {name} is kept by {key}, not by {change.key}")
    keys = (change.keys if change.keys is not None else change.rows).select(F.col(key).alias("_key")).distinct()
    touched = {r[0] for r in keys.select(bucket("_key", n)).distinct().collect()}  # a row a bucket
    rows = change.rows
    if change.keys is not None and not change.within:  # rows whose documents are not among the keys would stand beside the ones there
        rows = rows.join(sent(keys), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    schema = rows.drop(BUCKET).schema
    if not change.laid:  # files by bucket, of about even size whatever a bucket holds
        rows = rows.withColumn(BUCKET, bucket(key, n)).hint("rebalance", BUCKET)
    there = [p for b, p in before["buckets"].items() if int(b) in touched] if before else []
    if there:
        old = read(spark, top, name, of=Version(0, {name: before}), buckets=touched)
        old = old.join(sent(keys), F.col(key).eqNullSafe(F.col("_key")), "left_anti").withColumn(BUCKET, bucket(key, n))
        rows = old.unionByName(rows, allowMissingColumns=True)
        rows = rows.hint("rebalance", BUCKET) if _crowded(spark, top, there) else rows
    if before:
        schema = read(spark, top, name, of=Version(0, {name: before}), buckets=set()).unionByName(spark.createDataFrame([], schema), allowMissingColumns=True).schema
    path = f"{DATA}/{name}/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{top}/{path}")
    fs, place = _hadoop(spark, f"{top}/{path}")
    there = {int(m[1]) for s in fs.listStatus(place) if (m := re.fullmatch(rf"{BUCKET}=(\d+)", s.getPath().getName()))}
    kept = {b: p for b, p in (before["buckets"] if before else {}).items() if int(b) not in touched}
    for f in schema.fields:
        f.nullable = True
    return {"key": key, "count": n, "schema": schema.jsonValue(), "buckets": kept | {str(b): f"{path}/{BUCKET}={b}" for b in sorted(there)}}, len(touched)


def commit(spark: SparkSession, top: str, changes: Mapping[str, Change], notes: dict | None = None, base: Version | None = None) -> Version:
    """Makes all changes in one new version. base: the version that the changes were computed from, by default the last one."""
    old = base or version(spark, top)
    new = Version(old.number + 1, dict(old.tables), dict(notes or {}))
    new.notes["buckets_written"] = {}
    for name, change in changes.items():
        new.tables[name], new.notes["buckets_written"][name] = _write(spark, top, name, change, old.tables.get(name))
    publish(spark, top, new)
    return new


def vacuum(spark: SparkSession, top: str, keep: int = 1) -> int:
    """Deletes all but the last `keep` versions, and files that those don't name; not while a commit runs. Returns how many folders went."""
    numbers = versions(spark, top)
    used = {p for n in numbers[-keep:] for t in version(spark, top, n).tables.values() for p in t["buckets"].values()}
    gone = 0
    for n in numbers[:-keep]:
        remove(spark, f"{top}/{VERSIONS}/{n}.json")
    fs, place = _hadoop(spark, f"{top}/{DATA}")
    for table in fs.listStatus(place) if fs.exists(place) else []:
        for write in fs.listStatus(table.getPath()):
            for part in fs.listStatus(write.getPath()):
                if part.isDirectory() and f"{DATA}/{table.getPath().getName()}/{write.getPath().getName()}/{part.getPath().getName()}" not in used:
                    gone += fs.delete(part.getPath(), True)
            if not any(part.isDirectory() for part in fs.listStatus(write.getPath())):
                fs.delete(write.getPath(), True)
    return gone
