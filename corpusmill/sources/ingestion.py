"""Incremental ingestion: what changed against a snapshot, chunked and embedded, in one commit of documents, chunks and vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import docprep, whole_documents
from corpusmill.operators.tables import sent, shuffles_dropped
from corpusmill.sources import snapshots
from corpusmill.sources.snapshots import Change, Version

#: The version's tables: the texts' hashes, the chunks with their vectors, and the vectors by what they were made of.
DOCUMENTS, CHUNKS, VECTORS = "documents", "chunks", "vectors"


def changes_against(docs: DataFrame, known: DataFrame, complete: bool = True) -> DataFrame:
    """(doc_id, text_sha256, kind): added, changed, kept, and removed where `docs` is all there is. docs: doc_id, text; ids are unique."""
    now = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    before = known.select(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_was"))
    both = now.join(before, F.col("doc_id").eqNullSafe(F.col("_d")), "full" if complete else "left")
    kind = F.when(F.col("text_sha256").isNull(), "removed").when(F.col("_was").isNull(), "added").when(F.col("_was") == F.col("text_sha256"), "kept").otherwise("changed")
    return both.select(F.coalesce("doc_id", "_d").alias("doc_id"), "text_sha256", kind.alias("kind"))


#: Documents that one task cuts, about, and chunks that one task writes.
TASK_DOCUMENTS, TASK_CHUNKS = 8_192, 50_000


def embedded(chunks: DataFrame, placed: DataFrame, buckets: int) -> DataFrame:
    """Chunks with the vectors that `placed` has for them (doc_id, chunk_index, embedding), dealt by bucket: the one time that chunks leave their tasks."""
    parts = max(-(-chunks.count() // TASK_CHUNKS), chunks.sparkSession.sparkContext.defaultParallelism)
    both = chunks.withColumn("embedding", F.lit(None).cast("array<float>")).unionByName(placed, allowMissingColumns=True)
    one = Window.partitionBy(snapshots.BUCKET, "_part", "doc_id", "chunk_index")
    both = snapshots.by_bucket(both, "doc_id", buckets, parts).withColumn("embedding", F.first("embedding", ignorenulls=True).over(one))
    return both.filter("content is not null").drop("_part")


def ingest_changes(docs: DataFrame, top: str, embed_fn: Callable, model: str, size: int, complete: bool = True, buckets: int = 64) -> Version:
    """Brings the tables below `top` to `docs` (doc_id, text): only added and changed texts are cleaned, chunked and embedded.

    embed_fn maps a list of texts to vectors. A child's vector is looked up by model, size and text in the vectors' table first; one of a
    wrong size is not kept, and its chunk has none. complete: documents that are not in `docs` go. All three tables change in one commit; its
    notes count documents by kind, texts embedded and reused, children without a vector, and buckets written.
    """
    with shuffles_dropped(docs.sparkSession):
        return _ingest(docs, top, embed_fn, model, size, complete, buckets)


def _ingest(docs: DataFrame, top: str, embed_fn: Callable, model: str, size: int, complete: bool, buckets: int) -> Version:
    spark, old, work = docs.sparkSession, snapshots.version(docs.sparkSession, top), f"{top}/_work/{uuid.uuid4().hex}"

    def table(name: str, schema: str) -> DataFrame:
        return snapshots.read(spark, top, name, of=old) if name in old.tables else spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    diff = kept(changes_against(docs, table(DOCUMENTS, "doc_id long, text_sha256 string"), complete), "changes")
    counts = {r["kind"]: r["n"] for r in diff.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # four kinds
    fresh, n_fresh = diff.filter("kind in ('added', 'changed')"), counts.get("added", 0) + counts.get("changed", 0)
    todo = docs.select("doc_id", "text")
    if "kept" in counts:  # else all of them are
        todo = todo.join(sent(fresh.select(F.col("doc_id").alias("_d")), n_fresh), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    todo = todo.repartition(max(-(-n_fresh // TASK_DOCUMENTS), 2 * spark.sparkContext.defaultParallelism), "doc_id")
    key = F.when(F.col("chunk_type") == "child", docprep.embedding_key(model, size, "content"))
    chunks = kept(whole_documents.chunks_of(todo).withColumn("cache_key", key), "chunks")
    children = chunks.filter("chunk_type = 'child'")
    wanted = children.select("cache_key").distinct()
    texts = wanted.count()
    cache = table(VECTORS, "cache_key string, embedding array<float>").select("cache_key", "embedding")
    cache = cache.join(sent(wanted, texts), "cache_key", "left_semi")
    made = kept(docprep.embed_missing(children.select(F.col("content").alias("text")), cache, embed_fn, model, size), "vectors")
    good, bad = made.filter("embedding is not null").select("cache_key", "embedding"), made.filter("embedding is null").select("cache_key")
    without = children.join(bad, "cache_key", "left_semi").count() if bad.count() else 0
    notes = {k: counts.get(k, 0) for k in ("added", "changed", "kept", "removed")} | {"embedded": (n := made.count()), "reused": texts - n, "without_vector": without}
    placed = children.select("doc_id", "chunk_index", "cache_key").join(good.unionByName(cache), "cache_key").drop("cache_key")
    laid = embedded(chunks.drop("cache_key"), placed, old.tables.get(CHUNKS, {}).get("count", buckets))
    laid = whole_documents.with_ids(laid.withColumn("cache_key", key))
    gone = diff.filter("kind <> 'kept'").select("doc_id")
    rows = fresh.select("doc_id", "text_sha256", F.lit(old.number + 1).alias("version"))
    changes = {DOCUMENTS: Change(rows, "doc_id", gone, buckets, within=True), CHUNKS: Change(laid, "doc_id", gone, buckets, within=True, laid=True), VECTORS: Change(good, "cache_key", None, buckets)}
    new = snapshots.commit(spark, top, changes, notes, old)
    snapshots.remove(spark, work)
    return new
