"""Readers and writers: evaluation files, strict JSON lines, validation as violation tables, chunks and layers replaced per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources import snapshots


def read_cases(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, a JSON list, or an object with the rows under cases, retrieval or data."""
    s = schema
    holder = spark.read.schema(f"cases array<struct<{_fields(schema)}>>, retrieval array<struct<{_fields(schema)}>>, data array<struct<{_fields(schema)}>>").json(path, multiLine=True)
    held = holder.select(F.explode(F.coalesce("cases", "retrieval", "data")).alias("x")).select("x.*")
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c"), F.trim("value").rlike(r"^\{[^\n]*\}\s*\n\s*\{").alias("lines")).first()
    if first is None or first["c"] == "[":
        return spark.read.schema(s).json(path, multiLine=True)
    if first["lines"]:
        return spark.read.schema(s).json(path)
    return held if held.limit(1).count() else spark.read.schema(s).json(path)


def _fields(schema: T.StructType | str) -> str:
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return st.simpleString()[7:-1]


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON lines file (blank and # lines passed over), and its bad lines."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike(r"^(#.*)?$"))
    parsed = lines.withColumn("x", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("x._corrupt_record").isNotNull() | ~F.trim("value").startswith("{")
    return parsed.filter(~bad).select("x.*").drop("_corrupt_record"), parsed.filter(bad).select(F.col("value").alias("line"))


def validate_cases(cases: DataFrame) -> DataFrame:
    """(id, violation): empty or repeated ids, empty queries, more than one version, missing labels."""
    repeated = cases.groupBy("id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("id").isNotNull()).select("id", F.lit("repeated id").alias("violation"))
    versions = cases.agg(F.count_distinct("version").alias("n")).filter("n > 1").select(F.lit(None).cast(cases.schema["id"].dataType).alias("id"), F.lit("mixed versions").alias("violation"))
    rules = F.array_compact(F.array(
        F.when(F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) == "", F.lit("empty id")), F.when(F.trim(F.coalesce("query", F.lit(""))) == "", F.lit("empty query")),
        F.when(F.coalesce("requires_retrieval", F.lit(True)) & (F.coalesce(F.size("relevant"), F.lit(0)) <= 0), F.lit("no labels")),
    ))
    return cases.select("id", F.explode(rules).alias("violation")).unionByName(repeated).unionByName(versions)


def validate_run(rows: DataFrame) -> DataFrame:
    """(case_id, violation) of captured executions: case_id, status, answer, final_answer, retrieved_evidence, tool_calls.

    retrieved_evidence: structs with evidence_id and content; tool_calls: structs with name, arguments and status.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = F.array_compact(F.array(
        F.when(blank(F.col("case_id")), F.lit("no case_id")), F.when(F.col("status").isNull(), F.lit("no status")), F.when(F.coalesce("answer", "final_answer").isNull(), F.lit("no answer")),
        F.when(F.col("retrieved_evidence").isNull(), F.lit("no evidence list")), F.when(F.col("tool_calls").isNull(), F.lit("no tool list")),
        F.when(F.exists("retrieved_evidence", lambda e: e.isNull() | blank(e["evidence_id"]) | e["content"].isNull()), F.lit("bad evidence")),
        F.when(F.exists("tool_calls", lambda c: c.isNull() | c["name"].isNull() | c["arguments"].isNull() | c["status"].isNull()), F.lit("bad tool call")),
    ))
    repeated = rows.filter(~blank(F.col("case_id"))).groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("repeated case_id").alias("violation"))
    return rows.select("case_id", F.explode(rules).alias("violation")).unionByName(repeated)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files' bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def unlike_counts(there: DataFrame, chunks: DataFrame, by: str = "doc_id", vector: str | None = None) -> DataFrame:
    """(by, written, wanted): documents of `chunks` whose chunks that are there, those with a vector where one is named, are not as many."""
    there = there.filter(F.col(vector).isNotNull()) if vector else there
    got = there.groupBy(F.col(by).alias("_k")).agg(F.count("*").alias("written"))
    want = chunks.groupBy(by).agg(F.count("*").alias("wanted"))
    return want.join(got, F.col(by) == F.col("_k"), "left").select(by, F.coalesce("written", F.lit(0)).alias("written"), "wanted").filter("written <> wanted")


def replace_chunks(spark: SparkSession, top: str, chunks: DataFrame, documents: DataFrame | None = None, key: str = "doc_id") -> snapshots.Version:
    """Puts `chunks` in the place of their documents' ones, or of all of `documents`, in one new version; no other document is touched."""
    return snapshots.commit(spark, top, {"chunks": snapshots.Change(chunks, key, documents)})


def keep_reviews(new: DataFrame, before: DataFrame, by: str = "doc_id") -> DataFrame:
    """new with review_status: an approved one survives a re-run, all others stand as computed."""
    old = before.filter("review_status = 'approved'").select(F.col(by).alias("_k")).distinct()
    return new.join(old, F.col(by) == F.col("_k"), "left").withColumn("review_status", F.when(F.col("_k").isNotNull(), "approved").otherwise(F.col("review_status"))).drop("_k")


def replace_layers(spark: SparkSession, top: str, layers: dict[str, DataFrame], documents: DataFrame, key: str = "doc_id") -> snapshots.Version:
    """Puts the layers' rows of `documents` in the place of those there, all layers in one commit."""
    return snapshots.commit(spark, top, {name: snapshots.Change(df, key, documents) for name, df in layers.items()})


def load_layers(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose pages, in order, still give the recorded text hash: (doc_id, text)."""
    texts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return texts.join(documents.select("doc_id", "text_sha256"), "doc_id").filter(F.sha2("text", 256) == F.col("text_sha256")).select("doc_id", "text")


def backfill_chunks(chunks: DataFrame, docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """Tenant from the collection; missing versions and titles from the document."""
    d = docs.select(F.col("doc_id").alias("_d"), F.col("kb_id").alias("_kb"), F.col("title").alias("_title"), "content_sha256")
    b = kbs.select(F.col("kb_id").alias("_b"), F.col("tenant_id").alias("_tenant"))
    j = chunks.join(d, F.col("doc_id") == F.col("_d"), "left").join(b, F.col("_kb") == F.col("_b"), "left")
    return j.withColumn("tenant_id", F.col("_tenant")).withColumn("title", F.coalesce("title", "_title")).withColumn("document_version", F.coalesce("document_version", "content_sha256", F.lit("legacy"))).drop("_d", "_kb", "_title", "content_sha256", "_b", "_tenant")


def seed_cases(current: DataFrame, *seeds: DataFrame, key: str = "case_key") -> DataFrame:
    """Cases by key; later seeds win over earlier ones and over what is there."""
    tagged = [d.withColumn("_n", F.lit(k)) for k, d in enumerate([current, *seeds])]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    columns = [c for c in out.columns if c not in (key, "_n")]
    return out.groupBy(key).agg(*[F.max_by(c, "_n").alias(c) for c in columns])
