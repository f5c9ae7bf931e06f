"""Mixture-controlled packing: deficit round-robin over source queues, cut into sequences without gaps.

Each source is a queue of its documents' ids. A window is one sequence of 2,048 ids by default. In the round that fills
a window each source gets a quantum in proportion to its target, and sends units of its queue while its deficit covers
them; what is left is carried to the next round. A unit is one quantum (fractions of an id are carried), `least` ids at
least, so a source with a share of a thirty-second or more is in every window, and a smaller one in as many as its share
pays for. As a queue is never idle before it ends, its k-th unit goes out in round ceil(k units / quantum): the rounds of
all units follow from running totals, on any number of partitions. The order (round, source, place in the queue) is cut every 2,048 ids, so
only the last sequence has padding. By default a source's target is its share of all ids, so all queues end together;
with given targets, the windows after a queue's end are shared by the others in proportion to theirs. Sources without a
target come after all others, in proportion to their ids. In each window a source has its share but for less than two
units.

Defined cases: a null text is empty and gives the end id alone; a null source is a queue of its own; rows repeated with
one key are packed one by one; a null key takes part like any other; very long texts are cut where units end; an empty
table gives an empty result; only the key, source, text and place are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import broadcast_small, pieces, running_start, written
from corpusmill.llm.tokens import encoded

ENCODED = "uid long, doc_id long, source string, place long, n long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, round long"


def encode_documents(docs: DataFrame, tokenizer: str, key: str, source: str, text: str, end: int, place: str | None) -> DataFrame:
    """uid, doc_id, source, place, n, ids (little-endian 16-bit) of each whole document with its end id, as a written table.

    uid tells rows apart, also those repeated with one key: the task's number and the row's in it.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), (F.col(place) if place else F.col(key)).cast("long").alias("place"), F.col(text).cast("string").alias("text"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, ids, n in encoded(batch.column(3), tokenizer, end):
                part = batch.slice(a, b - a)
                at = np.concatenate([[0], np.cumsum(n)]) * 2
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
                uid, first = uid + b - a, uid
                yield pa.RecordBatch.from_arrays([pa.array(range(first, uid), pa.int64()), *part.columns[:3], pa.array(n, pa.int64()), raw], [x.split()[0] for x in ENCODED.split(", ")])

    return written(rows.mapInArrow(job, ENCODED), "packing-ids")


def quanta(sizes: DataFrame, targets: dict | None, ids: int) -> DataFrame:
    """(_source, _no, _late, _quantum): a row a source, with its ids a round of `ids`; _late where it has no target."""
    shares = sizes.groupBy("source").agg(F.sum("n").cast("double").alias("size"))
    if targets is None:
        shares = shares.withColumn("target", F.col("size"))
    else:
        given = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "_given string, _target double")
        shares = shares.join(broadcast_small(given), F.col("source").eqNullSafe(F.col("_given")), "left").select("source", "size", F.greatest(F.coalesce("_target", F.lit(0.0)), F.lit(0.0)).alias("target"))
    shares = shares.withColumn("_late", F.col("target") <= 0).withColumn("target", F.when(F.col("_late"), F.col("size")).otherwise(F.col("target")))
    total = F.sum("target").over(Window.partitionBy("_late"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())).cast("long")  # a row a source
    return written(shares.select(F.col("source").alias("_source"), number.alias("_no"), "_late", (F.col("target") / total * ids).alias("_quantum")), "packing-shares")


def cut_units(queued: DataFrame, shares: DataFrame, least: int) -> DataFrame:
    """(uid, p_start, p_n, round, _no, _at): each document's ids by the units of its queue in which they lie."""
    rows = queued.join(broadcast_small(shares), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_unit", F.greatest(F.lit(float(least)), "_quantum"))
    near = "sequence(greatest(0L, cast(floor(before / _unit) as long) - 1), cast(floor((before + n) / _unit) as long) + 1)"
    rows = rows.select("uid", "before", "n", "_no", "_late", "_quantum", "_unit", F.explode(F.expr(near)).alias("_k"))
    edge = lambda k: F.ceil(k * F.col("_unit")).cast("long")
    start, stop = F.greatest(F.col("before"), edge(F.col("_k"))), F.least(F.col("before") + F.col("n"), edge(F.col("_k") + 1))
    rows = rows.filter(start < stop)
    turn = F.when(F.col("_unit") == F.col("_quantum"), F.col("_k") + 1).otherwise(F.ceil((F.col("_k") + 1) * F.col("_unit") / F.col("_quantum"))).cast("long")
    return rows.select("uid", (start - F.col("before")).alias("p_start"), (stop - start).alias("p_n"), turn.alias("round"), "_no", "_late", start.alias("_at"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", source: str = "source", text: str = "text", end: int = 1, length: int = 2048, window: int = 1, targets: dict | None = None, place: str | None = None, least: int = 64) -> DataFrame:
    """One row per piece: its document, its place in a sequence, and the checksum of its ids.

    window: sequences that a round fills. targets: share by source, else each source's share of all ids. least: ids of
    the smallest unit. place: a column with the documents' order in their queues as row numbers, else a hash.
    """
    ids = encode_documents(docs, tokenizer, key, source, text, end, place)
    sizes = ids.select("uid", "doc_id", "source", "place", "n")
    rows, low, high = sizes.agg(F.count("*"), F.min("place"), F.max("place")).first()
    n, low = pieces(rows), low or 0
    width = max(1, -(-((high or 0) - low + 1) // n))
    # Keys may lie anywhere and repeat, so without a given place queues follow a hash of key and row; given places are row numbers.
    sizes = sizes.withColumn("_piece", F.floor((F.coalesce("place", F.lit(low)) - low) / width) if place else F.pmod(F.xxhash64("doc_id", "uid"), F.lit(n)))
    queued = running_start(sizes, "n", "before", ["place", "doc_id", "uid"], ["source"], "_piece")
    cut = cut_units(queued, quanta(sizes, targets, length * window), least)
    # Ranges of the order, about equal in rows whatever the rounds hold; their numbers are the pieces of the running total.
    order = ["_late", "round", "_no", "_at"]
    cut = written(cut.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()), "packing-pieces")
    placed = running_start(cut, "p_n", "at", order, [], "_piece")
    wanted = placed.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("p_start", "p_n", "at", "round"))).alias("cuts"))
    wanted = written(wanted.withColumnRenamed("uid", "_uid"), "packing-places")
    both = ids.join(wanted, F.col("uid") == F.col("_uid")).select("doc_id", "source", "n", "ids", "cuts")  # the ids move once

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for doc, src, n_ids, raw, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                wide = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                for start, stop, at, turn in joined_cuts(cuts):
                    while start < stop:  # cut where a sequence is full
                        take = min(stop - start, length - at % length)
                        out.append((doc, start, take, zlib.crc32(wide[start : start + take]), n_ids, at // length, at % length, src, turn))
                        start, at = start + take, at + take
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "source" else pa.int64()) for c, k in zip(cols, names, strict=True)], names)

    return both.mapInArrow(job, PACKED)


def joined_cuts(cuts: list[dict]) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, at, round) of a document's cuts; those that follow each other in the sequences as well are one."""
    start = stop = at = turn = None
    for c in cuts:
        if stop == c["p_start"] and at is not None and at + stop - start == c["at"]:
            stop += c["p_n"]
            continue
        if start is not None:
            yield start, stop, at, turn
        start, stop, at, turn = c["p_start"], c["p_start"] + c["p_n"], c["at"], c["round"]
    if start is not None:
        yield start, stop, at, turn
