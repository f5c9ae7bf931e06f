"""Versioned tables: one document replaced without harm to others, layers together, conflicts, and incremental ingestion."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, ingestion, snapshots
from corpusmill.sources.snapshots import Change

ROWS = "doc_id long, n int, text string"


def rows_of(spark, top, table="chunks", number=None):
    return sorted((tuple(r) for r in snapshots.read(spark, top, table, number).collect()), key=str)


def test_one_document_is_replaced_and_its_neighbours_stay(spark, tmp_path):
    """All documents share one bucket."""
    top = f"file://{tmp_path}/t"
    first = [(k, n, f"text {k} {n}") for k in (1, 9, None, 2**62) for n in range(3)]
    snapshots.commit(spark, top, {"chunks": Change(spark.createDataFrame(first, ROWS), buckets=1)})
    files.replace_chunks(spark, top, spark.createDataFrame([(1, 0, "new")], ROWS))
    assert rows_of(spark, top) == sorted([r for r in first if r[0] != 1] + [(1, 0, "new")], key=str)
    assert rows_of(spark, top, number=1) == sorted(first, key=str)
    gone = spark.createDataFrame([(9,), (None,), (77,)], "doc_id long")
    files.replace_chunks(spark, top, spark.createDataFrame([(77, 5, "x"), (1, 8, "not asked for")], ROWS), gone)
    assert rows_of(spark, top) == sorted([r for r in first if r[0] == 2**62] + [(1, 0, "new"), (77, 5, "x")], key=str)
    snapshots.commit(spark, top, {"chunks": Change(spark.createDataFrame([], ROWS), keys=spark.createDataFrame([(k,) for k in (1, 2**62, 77)], "doc_id long"))})
    assert rows_of(spark, top) == [] and snapshots.versions(spark, top) == [1, 2, 3, 4]


def test_only_touched_buckets_are_written(spark, tmp_path):
    top = f"file://{tmp_path}/t"
    snapshots.commit(spark, top, {"chunks": Change(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), buckets=16)})
    new = snapshots.commit(spark, top, {"chunks": Change(spark.createDataFrame([(3, "b", 1)], "doc_id long, text string, more int"))})
    old = snapshots.version(spark, top, 1)
    moved = [b for b, p in new.tables["chunks"]["buckets"].items() if old.tables["chunks"]["buckets"][b] != p]
    assert len(moved) == 1 == new.notes["buckets_written"]["chunks"]
    got = {r.doc_id: (r.text, r.more) for r in snapshots.read(spark, top, "chunks").collect()}
    assert len(got) == 500 and got[3] == ("b", 1) and got[4] == ("a", None)
    assert snapshots.vacuum(spark, top) == 1 and snapshots.versions(spark, top) == [2] and len(rows_of(spark, top)) == 500
    with pytest.raises(ValueError, match="kept by doc_id"):
        snapshots.commit(spark, top, {"chunks": Change(spark.createDataFrame([("x",)], "text string"), key="text")})


def test_reader_and_conflict(spark, tmp_path):
    """A reader has the version it began with; of two commits from one version the later one fails and changes nothing."""
    top = f"file://{tmp_path}/t"
    one = lambda text: {"chunks": Change(spark.createDataFrame([(1, 0, text)], ROWS))}
    base = snapshots.commit(spark, top, one("first"))
    reader = snapshots.read(spark, top, "chunks")
    snapshots.commit(spark, top, one("second"), base=base)
    assert [r.text for r in reader.collect()] == ["first"]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, top, one("late"), base=base)
    assert rows_of(spark, top) == [(1, 0, "second")] and snapshots.versions(spark, top) == [1, 2]


def test_layers_change_together_or_not_at_all(spark, tmp_path):
    top = f"file://{tmp_path}/t"
    docs = spark.createDataFrame([(k, 0, f"d{k}") for k in range(6)], ROWS)
    layers = dict.fromkeys(["documents", "pages", "blocks", "tables", "chunks", "reports"], docs)
    files.replace_layers(spark, top, layers, docs.select("doc_id"))
    some = docs.filter("doc_id < 2").withColumn("text", F.lit("new"))
    broken = some.withColumn("n", F.expr("assert_true(doc_id > 5, 'broken layer')").cast("int"))
    with pytest.raises(Exception, match="broken layer"):
        files.replace_layers(spark, top, dict.fromkeys(layers, some) | {"tables": broken}, some.select("doc_id"))
    assert all(rows_of(spark, top, k) == rows_of(spark, top, k, 1) for k in layers) and snapshots.versions(spark, top) == [1]
    files.replace_layers(spark, top, dict.fromkeys(layers, some), some.select("doc_id"))
    assert all({r[2] for r in rows_of(spark, top, k)} == {"new", "d2", "d3", "d4", "d5"} for k in layers)


def test_ingestion_embeds_only_changed_texts(spark, tmp_path):
    """A hundred documents, then one changed, one copied, one gone: the calls of the embedding function are counted by what they were given."""
    top, asked = f"file://{tmp_path}/t", f"{tmp_path}/asked"

    def embed(texts):
        with open(asked, "a") as f:
            f.writelines(t.split()[0] + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    def told():
        with open(asked) as f:
            return sorted(f.read().split())

    docs = [(k, f"text{k} number {k} is here.") for k in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    v = ingestion.ingest_changes(frame(docs), top, embed, "m", 2)
    assert v.notes["added"] == 100 == v.notes["embedded"] and v.notes["without_vector"] == 0 and len(told()) == 100
    v = ingestion.ingest_changes(frame(docs), top, embed, "m", 2)
    assert v.notes["kept"] == 100 and v.notes["embedded"] == 0 and v.notes["buckets_written"] == {"documents": 0, "chunks": 0, "vectors": 0}
    docs[4] = (4, "changed4 now.")
    more = [*docs[:50], *docs[51:], (200, docs[7][1])]  # 50 goes, 200 has 7's text
    v = ingestion.ingest_changes(frame(more), top, embed, "m", 2)
    assert (v.notes["changed"], v.notes["added"], v.notes["removed"], v.notes["kept"], v.notes["embedded"], v.notes["reused"]) == (1, 1, 1, 98, 1, 1)
    assert told()[0] == "changed4" and len(told()) == 101 and v.notes["buckets_written"]["chunks"] <= 3
    got = {r.doc_id: (r.content, list(r.embedding)) for r in snapshots.read(spark, top, "chunks").filter("chunk_type = 'child'").collect()}
    assert got == {k: (t, [float(len(t)), 1.0]) for k, t in more}
    v = ingestion.ingest_changes(frame([(4, "wrong4 size")]), top, lambda ts: [[0.0] for _ in ts], "m", 2, complete=False)
    assert v.notes["without_vector"] == 1 and v.notes["kept"] == 0 and v.notes["removed"] == 0
    assert snapshots.read(spark, top, "chunks").filter("chunk_type = 'child' and doc_id = 4").first().embedding is None
    assert snapshots.read(spark, top, "documents").count() == 100
    assert not list((tmp_path / "t" / "_work").iterdir())  # what a run wrote for itself is gone
