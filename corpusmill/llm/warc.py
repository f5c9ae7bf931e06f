"""WARC archives, index first: write records, keep offset, length, URL and digest of each, read selected ones by byte ranges.

Each writing task puts gzipped records into files of its own below one folder and returns their index; files of lost
attempts are never named by an index. The index is a Parquet table. A reader sorts the wanted records by file and
offset, joins near ranges into one read, and takes the records out.

Of records with equal payloads (by SHA-1) the one with the largest page id is the response, the others are revisits.

Defined cases: a null html is an empty payload and takes part like others; a null URL writes no target, line ends in one
are percent-encoded; a null page id never wins against a number and is written without id; rows repeated with the same
id and payload are all responses; very long pages are one record each; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import new_path, written

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long"
#: A file is closed beyond this; ranges with smaller gaps are read at once, up to so many bytes.
FILE_BYTES, GAP, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: Line ends can't stand in a header.
BREAKS = {10: "%0A", 13: "%0D"}


def open_folder(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def record(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member with a WARC record; a revisit has no payload but says the length of what it refers to."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.translate(BREAKS))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if kind == "revisit" else payload)
    head = "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzipped record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def typed_pages(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, payload, record_type, refers_to: the largest page id of each digest is the response."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    best = rows.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("same")).filter("same > 1")
    best = written(best.select(F.col("sha1").alias("_sha1"), "best"), "warc-equal")
    joined = rows.join(best, F.col("sha1") == F.col("_sha1"), "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")) & (F.length("payload") >= least)
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes the archives below `folder`, an address that all executors reach, and returns their index as a written table."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        store.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for page, link, payload, kind, refers in zip(*[batch.column(i) for i in range(5)], strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    body = payload.as_buffer().to_pybytes()
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    raw = record(page.as_py(), link.as_py(), body, digest, kind.as_py(), refers.as_py())
                    out.write(raw)
                    index.append((page.as_py(), link.as_py(), name, at, len(raw), digest, kind.as_py(), refers.as_py()))
                    at += len(raw)
                yield table(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return written(typed_pages(pages, key, url, html, least).mapInArrow(job, INDEX), "warc-index")


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Sorted index rows in groups that one read covers."""
    group: list[dict] = []
    for r in rows:
        if group and (r["file"] != group[0]["file"] or r["offset"] > group[-1]["offset"] + group[-1]["length"] + GAP or r["offset"] + r["length"] - group[0]["offset"] > READ_BYTES):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The index rows' records, read back: sizes and digests come from the bytes read (a revisit's from its headers)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        for batch in batches:
            out: list[tuple] = []
            for group in ranges(batch.to_pylist()):
                with store.open_input_file(f"{top}/{group[0]['file']}") as f:
                    start = group[0]["offset"]
                    data = f.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                for r in group:
                    headers, payload = parse(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    kind = headers["WARC-Type"]
                    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (own, len(payload)) != (digest, size):
                            raise ValueError(f"{r['file']} at {r['offset']}: the payload does not match its digest")
                    page, refers = headers["WARC-Record-ID"][10:-1], headers.get("WARC-Refers-To", "")[10:-1]
                    out.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, headers.get("WARC-Target-URI"), r["file"], r["offset"], r["length"]))
            yield table(out, READ)

    wanted = index.select("file", "offset", "length")
    # The index is small beside the archives, so the number of tasks follows the records' bytes, not its own.
    tasks = -(-(wanted.agg(F.sum("length")).first()[0] or 0) // (4 * READ_BYTES))
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    wanted = wanted.withColumn("_range", F.floor(F.col("offset") / (16 * READ_BYTES))).repartition(tasks, "file", "_range").sortWithinPartitions("file", "offset").drop("_range")
    return wanted.mapInArrow(job, READ)


def warc_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, key, url, html, least), folder)
