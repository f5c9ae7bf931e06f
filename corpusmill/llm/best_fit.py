"""Best-fit packing with several capacities: residual tokens, documents and attention cost choose each piece's sequence.

A document longer than a sequence is cut into whole sequences, its first piece the shorter one. A piece needs its tokens,
one document and its tokens' square (what attention over it costs). Pieces go in falling length, each into the open
sequence that has room under every capacity and the best rule: the least weighted norm of what is left of the capacities
(`norm`), or the largest weighted product of need and residual (`dot`); else a new one is opened.

Pieces of one length are alike, so the packing of all of them is known from how many there are of each length: the plan is
made on the driver from that table (a row a length, whatever the number of documents) over classes of equal sequences, and
says for each range of ranks within a length where its pieces go. Ranks are counted in the tasks that encode, with the counts of
the tasks before added; nothing is sorted and no length meets in one task.

Defined cases: a null text is empty and gives the end id alone; rows repeated with one key, or without one, are packed one
by one; very long texts are cut; an empty table gives an empty result; only the key and the text are read, so other
columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import broadcast_small, written
from corpusmill.llm.tokens import ByteEncoder, WordEncoder, encoded

#: What tokens, documents and attention cost weigh where sequences are compared: tokens first, the others where those are near.
WEIGHTS = (1.0, 0.05, 0.05)


def cut_documents(docs: DataFrame, tokenizer: str, length: int, key: str, text: str, end: int, kind: type[WordEncoder], ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _part, _nth (and ids): a row a piece, as a written table.

    _nth counts the pieces of one length in the task, whose number is _part.
    """
    of = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth", *(["ids"] if ids else [])]
    schema = f"doc_id {of}, piece int, start long, length long, ids_crc32 long, _part int, _nth long" + (", ids array<int>" if ids else "")
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            for a, b, flat, n in encoded(batch.column(1), tokenizer, end, kind):
                wide, at = flat.astype("<u4"), 0
                rows, out, kept = [], [], []
                for row, size in enumerate(n.tolist(), a):
                    start = 0
                    for piece in range(-(-size // length)):
                        take = size - start if size <= length else (size % length or length) if not piece else length
                        own = wide[at + start : at + start + take]
                        rows.append(row)
                        out.append((piece, start, take, zlib.crc32(own), part, seen[take]))
                        if ids:
                            kept.append(own.astype(np.int32))
                        seen[take] += 1
                        start += take
                    at += size
                cols = list(zip(*out, strict=True)) or [[]] * 6
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
                if ids:
                    cut = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)]))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return written(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(job, schema), "best-fit-pieces")


class Plan:
    """Vector best fit over pieces that are alike by length.

    Classes are sequences with equal content: what they have left, how many they are, and the contents in order. `ranges` has for
    pieces of a length, from a rank on: the class's ancestor sequences from a number on, how many pieces each takes, and at what offset.
    """

    def __init__(self, counts: dict[int, int], length: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> None:
        self.full = np.array([length, documents, attention], np.int64)
        self.rule, self.weights = rule, np.array(weights)
        self.left = np.zeros((0, 3), np.int64)
        self.many = np.zeros(0, np.int64)  # sequences of each class
        self.first = np.zeros(0, np.int64)  # the number of its first sequence
        self.sequences = 0
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, rank, pieces a sequence, first sequence, offset
        for size in sorted(counts, reverse=True):
            self.place(size, counts[size])

    def scores(self, left: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The lower the better."""
        if self.rule == "norm":
            return (self.weights * ((left - need) / self.full) ** 2).sum(-1)
        return -(self.weights * (need / self.full) * (left / self.full)).sum(-1)

    def place(self, size: int, count: int) -> None:
        need, rank = np.array([size, 1, size * size], np.int64), 0
        if (need > self.full).any():
            raise ValueError("a piece that no sequence can hold")
        while rank < count:
            fits = np.flatnonzero((self.left >= need).all(1) & (self.many > 0))
            if not len(fits):  # new sequences, each filled before the next one is opened
                per = int((self.full // need).min())
                many = -(-(count - rank) // per)
                self.add(self.full, many, self.sequences)
                self.sequences += many
                rank += self.take(len(self.many) - 1, size, need, per, rank, count - rank)
                continue
            scores = self.scores(self.left[fits], need)
            best = int(np.argmin(scores))
            here, score = int(fits[best]), scores[best]
            per, left = 1, self.left[here] - need  # goes on in one sequence while that is better still than its like
            while (left >= need).all() and self.scores(left, need) < score:
                per, left = per + 1, left - need
            rank += self.take(here, size, need, per, rank, count - rank)

    def add(self, left: np.ndarray, many: int, first: int) -> None:
        self.left, self.many, self.first = np.vstack([self.left, left]), np.append(self.many, many), np.append(self.first, first)

    def take(self, here: int, size: int, need: np.ndarray, per: int, rank: int, pieces: int) -> int:
        """Puts pieces into the sequences of a class, `per` in each, the rest into one more; those not reached stay a class."""
        full, rest = min(int(self.many[here]), pieces // per), 0
        left, many, first = self.left[here].copy(), int(self.many[here]), int(self.first[here])
        offset = int(self.full[0] - left[0])
        if full:
            self.ranges.append((size, rank, per, first, offset))
            self.add(left - per * need, full, first)
        if full < many and full * per < pieces and (rest := pieces - full * per) < per:
            self.ranges.append((size, rank + full * per, rest, first + full, offset))
            self.add(left - rest * need, 1, first + full)
            full += 1
        else:
            rest = 0
        self.many[here] -= full
        self.first[here] += full
        used = full * per if not rest else (full - 1) * per + rest
        if not self.many[here]:
            self.left, self.many, self.first = np.delete(self.left, here, 0), np.delete(self.many, here), np.delete(self.first, here)
        return used

    def lookup(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        table = np.array(sorted(self.ranges), np.int64).reshape(-1, 5)
        known = np.unique(table[:, 0])
        cell = lambda s, r: (np.searchsorted(known, s) << 43) + r
        at = np.searchsorted(cell(table[:, 0], table[:, 1]), cell(sizes, ranks), "right") - 1
        _, rank, per, first, offset = table[at].T
        nth = ranks - rank
        return first + nth // per, offset + nth % per * sizes


def best_fit(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, length: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, kind: type[WordEncoder] = ByteEncoder, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row a piece.

    documents, attention: capacities of a sequence besides its `length` tokens: how many pieces it holds and the sum of
    their squared lengths; by default as many as its tokens allow (length, length squared).
    """
    pieces = cut_documents(docs, tokenizer, length, key, text, end, kind, ids)
    by_task = pieces.groupBy("_part", "length").agg(F.count("*").alias("_count"))
    by_task = written(by_task, "best-fit-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_count").alias("n")).collect()}  # a row a length
    plan = Plan(counts, length, documents or length, attention or length * length, rule, weights)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that encoded
    starts = by_task.select(F.col("_part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(broadcast_small(written(starts, "best-fit-starts")), (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_p", "_l", "_before", "_part", "_nth")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.lookup(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    of = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {of}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(job, schema)
