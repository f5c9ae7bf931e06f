"""Token ids in binary shards: one wavelet matrix a shard, in ascending key order, with access, counting and look-up.

Documents are range-partitioned and sorted by their key; each task encodes its documents and writes one shard file. A
shard holds 16 bit planes (most significant bit first). Each plane is the stable partition of the one before it, with
its number of zeros and, for each 512 bits, the ones before them: rank takes one look-up and the counts of 64 bytes at
most, select a binary search over the look-ups and then over the bytes of one block. Planes are compressed one by one in
the same file. Files of lost attempts are never named by the index.

Defined cases: a null text is empty and gives the end id alone; rows repeated with one key are kept, in an order fixed
by their texts' hashes, and spread over shards; a null key sorts first; an empty table writes nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import broadcast_small, new_path, written
from corpusmill.llm.tokens import encoded
from corpusmill.llm.warc import open_folder

MAGIC, BITS, BLOCK = b"WVLT0001", 16, 512
INDEX = "doc_id long, shard string, shard_no long, row_start long, n_tokens long"


def build(ids: np.ndarray) -> bytes:
    """The file of a wavelet matrix over 16-bit ids."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    now, parts, planes = ids.astype(np.uint16), [], []
    for k in range(BITS - 1, -1, -1):
        bit = (now >> k).astype(bool) if k == BITS - 1 else ((now >> k) & 1).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        full = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        full[: len(packed)] = packed
        ones = np.bitwise_count(full.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32 if len(ids) < 2**32 else np.uint64)
        a, b = pack.compress(packed.tobytes()), pack.compress(ranks.tobytes())
        planes.append([len(ids) - int(ones.sum()), len(a), len(b)])
        parts += [a, b]
        now = np.concatenate([now[~bit], now[bit]])
    head = json.dumps({"n": len(ids), "bits": BITS, "block": BLOCK, "rank": "u4" if len(ids) < 2**32 else "u8", "planes": planes}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class WaveletMatrix:
    """Reads a shard: ids at places, how often an id stands in a range, where its occurrences are."""

    def __init__(self, raw: bytes) -> None:
        import zstandard

        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack_from("<I", raw, 8)[0]
        head = json.loads(raw[12 : 12 + size])
        self.n, self.zeros, self.bits, self.ranks, at = head["n"], [p[0] for p in head["planes"]], [], [], 12 + size
        unpack = zstandard.ZstdDecompressor()
        for _, a, b in head["planes"]:
            self.bits.append(np.frombuffer(unpack.decompress(raw[at : at + a], max_output_size=max(1, -(-self.n // 8))), np.uint8) if self.n else np.zeros(0, np.uint8))
            self.ranks.append(np.frombuffer(unpack.decompress(raw[at + a : at + a + b], max_output_size=(self.n // BLOCK + 2) * 8), head["rank"]).astype(np.int64))
            at += a + b

    def rank1(self, plane: int, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        places = np.asarray(places, np.int64)
        bits, block = self.bits[plane], places // BLOCK
        out = self.ranks[plane][np.minimum(block, len(self.ranks[plane]) - 1)].copy()
        for j in range(BLOCK // 8):
            byte = block * (BLOCK // 8) + j
            left = np.clip(places - byte * 8, 0, 8)
            some = (left > 0) & (byte < len(bits))
            out[some] += np.bitwise_count(bits[byte[some]] & ((1 << left[some]) - 1).astype(np.uint8))
        return out

    def bit(self, plane: int, places: np.ndarray) -> np.ndarray:
        return (self.bits[plane][places >> 3] >> (places & 7).astype(np.uint8)) & 1

    def access(self, places) -> np.ndarray:
        """The ids at the places."""
        at = np.atleast_1d(np.asarray(places, np.int64))
        out = np.zeros(len(at), np.uint16)
        for k in range(BITS):
            one = self.bit(k, at).astype(bool)
            ones = self.rank1(k, at)
            out = (out << 1) | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out

    def all(self) -> np.ndarray:
        """Every id, by undoing the stable partitions from the last plane to the first."""
        now = np.zeros(self.n, np.uint16)
        for k in range(BITS - 1, -1, -1):
            one = np.unpackbits(self.bits[k], count=self.n, bitorder="little").astype(bool) if self.n else np.zeros(0, bool)
            back = np.empty(self.n, np.uint16)
            back[~one] = now[: self.zeros[k]]
            back[one] = now[self.zeros[k] :] | np.uint16(1 << (BITS - 1 - k))
            now = back
        return now

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for k in range(BITS):
            a, b = self.rank1(k, np.array([start, end])).tolist()
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (BITS - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, plane: int, bit: int, numbers: np.ndarray) -> np.ndarray:
        """Places of the bits with these numbers (from 0) among the plane's ones or zeros."""
        numbers = np.asarray(numbers, np.int64)
        ranks = self.ranks[plane]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks  # the padding of the last block comes after all bits
        block = np.searchsorted(before, numbers, "right") - 1
        left = numbers - before[block]
        size = BLOCK // 8
        padded = np.zeros(len(ranks) * size, np.uint8)
        padded[: len(self.bits[plane])] = self.bits[plane]
        held = padded.reshape(-1, size)[block]
        held = held if bit else ~held
        count = np.cumsum(np.bitwise_count(held), 1, dtype=np.int64)
        byte = (count <= left[:, None]).sum(1)
        rows = np.arange(len(numbers))
        left -= np.where(byte > 0, count[rows, byte - 1], 0)
        inside = np.cumsum(np.unpackbits(held[rows, byte][:, None], axis=1, bitorder="little"), 1)
        return block * BLOCK + byte * 8 + (inside <= left[:, None]).sum(1)

    def find(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Places of all occurrences in the range: select on each plane from the last to the first."""
        a, b = self._range(token, start, self.n if end is None else end)
        at = np.arange(a, b, dtype=np.int64)
        for k in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - k) & 1
            at = self.select(k, one, at - self.zeros[k] if one else at)
        return np.sort(at)

    def nth(self, token: int, number: int) -> int | None:
        """The place of an id's occurrence with this number (from 0), or None."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= number < b - a:
            return None
        at = np.array([a + number])
        for k in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - k) & 1
            at = self.select(k, one, at - self.zeros[k] if one else at)
        return int(at[0])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, shard_bytes: int = 12 << 20) -> DataFrame:
    """Writes the shards below `folder`, an address that all executors reach; returns their index as a written table.

    tokenizer: path of the vocabulary file, the same on every executor. shard_bytes: about so much text goes to a shard.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_mark", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, counts, keys = [], [], []
        for batch in batches:
            for _, _, x, n in encoded(batch.column(1), tokenizer, end):
                ids.append(x)
                counts.append(n)
            keys.append(batch.column(0))
        if not keys:
            return
        store, top = open_folder(folder)
        store.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.wvlt"
        every = np.concatenate(ids)
        ids.clear()
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            out.write(build(every))
        counts = np.concatenate(counts)
        n = len(counts)
        start = np.cumsum(counts) - counts
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(keys), pa.array([name] * n), pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(start, pa.int64()), pa.array(counts, pa.int64())],
            [x.split()[0] for x in INDEX.split(", ")],
        )

    shards = max(1, -(-size // shard_bytes))
    order = ["doc_id", "_mark", "_row"]  # the row's number parts a hot key's copies
    return written(rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(job, INDEX), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; start counts the ids of all documents before it."""
    shards = index.groupBy("shard", "shard_no").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    shards = written(shards.select("shard", before.alias("before")), "token-shards").withColumnRenamed("shard", "_shard")
    files = max(1, shards.count())

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        name, ids = "", np.zeros(0, np.uint16)
        for b in batches:
            sums = []
            for shard, start, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if shard != name:
                    with store.open_input_file(f"{top}/{shard}") as f:
                        name, ids = shard, WaveletMatrix(f.read()).all()
                sums.append(zlib.crc32(ids[start : start + n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(3), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = index.join(broadcast_small(shards), F.col("shard") == F.col("_shard")).select("doc_id", "shard", "row_start", "n_tokens", (F.col("before") + F.col("row_start")).alias("start"))
    return rows.repartition(files, "shard").sortWithinPartitions("shard", "row_start").mapInArrow(job, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, key, text, end), folder)
