"""Documents cut in one task: the same chunks as by the block operators, no shuffle, and the tables' rows dealt once."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import chunking, docprep, whole_documents
from corpusmill.operators.tables import CLEANUP, shuffles_dropped
from corpusmill.plans import catalog
from corpusmill.sources import ingestion, snapshots
from corpusmill.sources.snapshots import Change

PIECES = [
    "# One", "## 1.2 Deep", "#", "#### ", " # no heading", "alpha beta gamma.", "Alpha, beta gamma!", "12", "- 3 -", "第 3 页", "Page 2 of 9", "page 2 ", "DRAFT", "机密", "1. Aims", "2、目的", "- item one", "（一）项", "摘要",
    "高血压患者使用阿莫西林胶囊治疗。", "糖尿病；慢性胃炎", "Take 5 mg/mL rituximab, Imatinib and imatinib", "ICD-10: J45.901 and E11, x99y é12.5", "PMID: 1234567 NCT01234567 NCT012345678", "éA12 A12é A12́ ́A12 _A12 Ａ12",
    "a\tb  c", "ﬁne ² ﬀ ５ mg", "\x00nul​", "a\x0bb\x85c d。\x0c1. e", "一\x0b二", "Straße STRASSE İ ı", "ΟΔΟΣ οδος", "  ", "　", "x\x1c", "\x1f", "!!!", "...", "this with THAT Which", "word-" * 5, "word " * 40 + "end. ",
    "😀 emoji 😀", "①② items", "References", "[1] x", "a|b", "CONFIDENTIAL\x85", "{} () [x]", "K12 K12",
]


def by_blocks(docs):
    kept, _ = docprep.clean_documents(docprep.text_blocks(docs))
    return tx.extract_metadata(chunking.chunk_ids(chunking.chunk_sections(docprep.structural_sections(kept))), "content")


def test_chunks_are_those_of_the_block_operators(spark):
    """Odd lines in all orders, and the smallest table."""
    r = random.Random(5)
    odd = ["".join(r.choice(PIECES) + r.choice(["\n", "\n", "\r\n", "\r", " ", ""]) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    odd += [None, "", "\n", *PIECES, "Ten words are in this line of text here now. " * 900, "long" * 4000]
    given = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for docs in (given, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")):
        got, want = whole_documents.ingest(docs), by_blocks(docs)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        got, want = ({(x.doc_id, x.chunk_index): x for x in d.collect()} for d in (got, want))
        assert got.keys() == want.keys() and len(got) > 200
        assert [(got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_no_row_leaves_its_task(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Exchange" not in whole_documents.ingest(docs)._jdf.queryExecution().executedPlan().toString()


WORDS = ["alpha", "beta", "gamma", "delta.", "beta!", "x-y", "。", "血压", "高", "\n\n", "\n", "5.6", "Alpha.", "-", "?", " \n", "\x1c", "...", ". .", "　", "；", "\t", "a.b", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["", " "]), st.lists(st.sampled_from(WORDS), max_size=60), st.integers(1, 30), st.integers(1, 30), st.integers(0, 6))
def test_pieces_of_pieces(between, words, parent, child, overlap):
    """Sentences of a piece are not looked for again; what comes out is the same."""
    text, child = between.join(words), min(parent, child)
    overlap = min(overlap, child // 2)
    want = [(c, a, b, chunking.pack_text(c, child, overlap)) for c, a, b in chunking.pack_text(text, parent, 0)]
    assert list(chunking.pack_twice(text, parent, child, overlap)) == want


def test_word_characters():
    assert all((whole_documents.WORD_CHARACTERS[c] is not None) == bool(re.match(r"\w", chr(c))) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def test_shuffle_files_go_with_their_job(spark):
    assert spark.conf.get(CLEANUP) == "false"
    with shuffles_dropped(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == "false"


def executed(spark, run):
    """The plans that ran, as text."""
    seen = []
    writes = snapshots._write

    def told(s, top, name, change, before):
        seen.append((name, change.rows._jdf.queryExecution().executedPlan().toString()))
        return writes(s, top, name, change, before)

    snapshots._write = told
    try:
        run()
    finally:
        snapshots._write = writes
    return seen


def test_chunks_are_dealt_once(spark, tmp_path):
    """By bucket, with their vectors; the write and a second run don't deal them again."""
    top = f"file://{tmp_path}/t"
    docs = spark.createDataFrame([(k, f"text {k} is here.") for k in range(300)], "doc_id long, text string")
    plans = dict(executed(spark, lambda: ingestion.ingest_changes(docs, top, lambda ts: [[1.0] for _ in ts], "m", 1, buckets=8)))
    chunks = plans[ingestion.CHUNKS]
    assert chunks.count("shufflepartitionidpassthrough") == 1 and "rebalance" not in chunks.lower()
    places = {b: len(list((tmp_path / "t" / p).glob("*.parquet"))) for b, p in snapshots.version(spark, top).tables[ingestion.CHUNKS]["buckets"].items()}
    assert len(places) == 8 and max(places.values()) <= 2
    rows = snapshots.read(spark, top, ingestion.CHUNKS).filter("chunk_type = 'child'").collect()
    assert len(rows) == 300 and all(r.embedding == [1.0] and r.cache_key for r in rows)


def test_small_files_of_many_commits_are_put_together(spark, tmp_path):
    top = f"file://{tmp_path}/t"
    for k in range(12):
        snapshots.commit(spark, top, {"rows": Change(spark.createDataFrame([(k, n) for n in range(3)], "doc_id long, n int"), buckets=1)})
    last = snapshots.version(spark, top).tables["rows"]["buckets"]["0"]
    assert len(list((tmp_path / "t" / last).glob("*.parquet"))) <= 8
    assert sorted((r.doc_id, r.n) for r in snapshots.read(spark, top, "rows").collect()) == [(k, n) for k in range(12) for n in range(3)]


def test_deal_by_bucket_is_even(spark):
    rows = snapshots.by_bucket(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", 8, 20)
    parts = rows.withColumn("_at", F.spark_partition_id()).groupBy("_part").agg(F.count("*").alias("n"), F.count_distinct(snapshots.BUCKET).alias("b"), F.count_distinct("_at").alias("p")).collect()
    assert len(parts) == 20 and all(800 < r.n < 1200 and r.b <= 2 and r.p == 1 for r in parts)


def test_changes_are_taken_in_over_the_whole_table(spark, tmp_path):
    """dc32: both runs have every document, none is left out by its id, and each one's chunks are checked; with a missing id and text."""
    rows = [(k, None if k == 5 else f"text {k} number {k} is here.", "en", "s", 1) for k in range(230)] + [(None, "of no id", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    runs, ingest = [], ingestion.ingest_changes
    ingestion.ingest_changes = lambda docs, *a: runs.append({r.doc_id: r.text for r in docs.collect()}) or ingest(docs, *a)
    try:
        got = {r.doc_id: r for r in catalog.QUERIES["dc32_ingest_changes"](spark, str(tmp_path)).collect()}
    finally:
        ingestion.ingest_changes = ingest
    assert [len(r) for r in runs] == [231, 231] and set(got) == {r[0] for r in rows} == set(runs[1])
    assert all((r.version, r.stale, r.unlike, r.n_changed, r.n_added, r.n_removed, r.embedded_only_new) == (2 if k is not None and k % 100 in (7, 13) else 1, 0, 0, 3, 3, 3, True) for k, r in got.items())
    assert "% 100 <> " not in catalog.ORACLE_SQL["dc32_ingest_changes"] and got[29].text_sha256 == hashlib.sha256(rows[29][1].encode()).hexdigest()


def test_wrong_chunks_of_a_kept_document_are_found(spark, monkeypatch):
    """dc32: the second run's tables with a kept document's chunk gone, and one without its vector."""
    ingest, seen = ingestion.ingest_changes, []

    def spoilt(docs, top, *a):
        v = ingest(docs, top, *a)
        seen.append(v.number)
        if len(seen) < 2:
            return v
        bad = snapshots.read(spark, top, ingestion.CHUNKS, of=v).filter("doc_id in (1, 2)")
        rows = bad.filter("doc_id = 2 or chunk_index > 0").withColumn("embedding", F.when(F.col("doc_id") == 1, F.col("embedding")))
        return snapshots.commit(spark, top, {ingestion.CHUNKS: Change(rows, keys=bad.select("doc_id"))}, v.notes, v)

    monkeypatch.setattr(ingestion, "ingest_changes", spoilt)
    got = catalog.QUERIES["dc32_ingest_changes"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got if r.stale} >= {1} and {r.doc_id for r in got if r.unlike} == {2}


@settings(max_examples=2000, deadline=None)
@given(st.text(st.sampled_from("ab1-'/. \t\n\x1c\x00\x7f,!"), max_size=30))
def test_tokens_are_counted_without_making_them(text):
    assert chunking.n_tokens(text) == len(docprep.TOKEN.findall(text)) and chunking.n_tokens(text + "高é") == len(docprep.TOKEN.findall(text + "高é"))
