"""The corpus pipeline: quality rules, near duplicates, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The mixing stage's decision is the order of the rows:
its files hold them in the mixture's order. Packing takes each source's queue in the order of the files, and its
rounds share the ids among the sources by the weights of the mixture.

Defined cases, in all stages: an empty table gives an empty one; extra columns stay as they are, whatever their names;
rows are told apart by their id and text, never by the id alone, so ids may be null or repeated.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.jaccard_join import jaccard_join
from corpusmill.llm.mixing import mix_sources, source_sizes, target_weights
from corpusmill.llm.packing import pack
from corpusmill.llm.pii import mask_pii
from corpusmill.llm.quality_rules import quality_rules
from corpusmill.llm.queries import tokenizer_path
from corpusmill.llm.shared import MADE, broadcast_small, new_path, remove_made

ORACLE_SQL = None  # neither the tagger, nor the schedule, nor the tokenizer can be said in SQL


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs lacks, letter case aside."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def with_marks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """docs with two columns that together tell (doc_id, text) from any other, nulls included."""
    text = F.col("text").cast("string")
    none = F.struct(F.col("doc_id").isNull().alias("no_id"), text.isNull().alias("no_text"))
    return docs.withColumn(a, F.xxhash64("doc_id", text, none)).withColumn(b, F.xxhash64(F.lit(1), none, text, "doc_id"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep.

    Defined cases: null, empty and blank texts have too few words and go; of rows that share an id each goes or stays by
    its own text and source; copies of one row share a verdict; a null source is a host like others.
    """
    row = fresh(docs, "row_mark")
    # Rows with equal id, text and source have equal verdicts, so that triple is the key which the rules pass through.
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    none = F.struct(F.col("doc_id").isNull(), text.isNull(), source.isNull())
    one, two = F.xxhash64("doc_id", text, source, none), F.xxhash64(F.lit(1), source, none, text, "doc_id")
    marked = docs.withColumn(row, F.struct(one.alias("one"), two.alias("two")))
    kept = quality_rules(marked, key=row).filter("kept").select(F.col(row).alias(fresh(marked, "kept_row"))).distinct()
    return marked.join(kept, marked[row] == kept[kept.columns[0]], "left_semi").select(columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, null last.

    Defined cases: rows that share an id are different documents where their texts differ; of rows with equal id and text
    one stays, chosen by a hash of its columns; null, empty and blank texts have no near duplicates, so all such
    documents stay but for rows with equal id and text.
    """
    a, b = fresh(docs, "mark_a"), fresh(docs, "mark_b")
    kept_id, kept_text = fresh(docs, "kept_id"), fresh(docs, "kept_text")
    kept = jaccard_join(docs).filter("keeps").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_text)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(kept_text))
    rows = with_marks(docs.join(kept, same, "left_semi"), a, b)
    # One row of each (id, text); partial aggregation leaves one a task before the shuffle, however many copies there are.
    order = F.xxhash64(*[c.cast("string") for c in columns(docs)])
    one = rows.groupBy(a, b).agg(F.min_by(F.struct(*columns(docs)), order).alias(fresh(docs, "row")))
    return one.select(f"{one.columns[-1]}.*").select(columns(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets in the texts replaced by their kinds; n_chars follows the text.

    Defined cases: a null text stays null, with n_chars 0 if that was a number; an empty one stays empty; rows repeated
    with one id are masked one by one; texts of any length are masked whole.
    """
    masked = mask_pii(docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_chars").isNotNull() | F.col("text").isNotNull(), F.length(F.coalesce("text", F.lit(""))))
        masked = masked.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return masked.select(columns(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture, also across files.

    Defined cases: a null source is a source of its own; null and empty texts weigh one character; rows with equal id,
    text and source stand together, others that share an id each have a place of their own.
    """
    mark, place = fresh(docs, "mixed_mark"), fresh(docs, "mixed_place")
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.xxhash64("doc_id", text, source, F.struct(F.col("doc_id").isNull(), text.isNull(), source.isNull()))
    marked = docs.withColumn(mark, key)
    order = mix_sources(marked, key=mark).groupBy(F.col(mark).alias(fresh(marked, "key"))).agg(F.min("position").alias(place))
    return marked.join(order, marked[mark] == order[order.columns[0]]).orderBy(place).select(columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 ids; documents stand in their queues as in the files, sources share windows by the mixture's weights.

    Defined cases: null and empty texts give their end id alone; a null source is a queue of its own; every row is packed,
    whatever its id; a text longer than a sequence is cut.
    """
    placed = docs.select("doc_id", "source", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))  # a row a file
    # Files are numbered by the task that wrote them; as text, part-100000 would come before part-99999.
    number = F.regexp_extract("_file", r"^part-(\d+)", 1)
    order = Window.orderBy(F.expr("try_cast(_number as bigint)"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_number", number).select(F.col("_file").alias("_name"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    placed = placed.join(broadcast_small(files), F.col("_file") == F.col("_name")).withColumn("_place", F.col("_before") + F.col("_row"))
    weights = {s: float(w) for s, w in target_weights(source_sizes(docs)).items()}  # the texts are stage 4's, so these are its weights
    return pack(placed, tokenizer_path(), place="_place", targets=weights)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_to_weights),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again. What the stage wrote
    for itself goes, and the table that it read as well: only the last stage's is left."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        before = len(MADE)
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_made(spark, before)
        if k:
            remove_made(spark, before - 2, before - 1)
        docs = spark.read.parquet(path)
    return docs
