"""Python tasks hand rows on as they come, and remember what they have read of a sentence."""

from types import SimpleNamespace

import pyarrow as pa

from corpusmill.operators import chunking, docprep, tables


def test_pieces_leave_a_task_in_small_batches(spark, monkeypatch):
    # A long header stands in each piece, so one document gives much more than it holds.
    text = "h" * 20_000 + "\n" + "\n".join(f"{'word ' * 400}{k}" for k in range(200))
    batch = pa.RecordBatch.from_pydict({"k": [1, None, 2], "t": [text, None, text]})
    seen = {}
    monkeypatch.setattr(docprep, "keyed", lambda *_: SimpleNamespace(mapInArrow=lambda job, schema: seen.update(out=job(iter([batch]))) or SimpleNamespace(withColumnRenamed=lambda *_: None)))
    docprep.pack_lines(None, header_lines=1)
    out = list(seen["out"])
    assert sum(b.num_rows for b in out) == 400 and len(out) > 7
    assert max(b.nbytes for b in out) < 2 * tables.CHARS_HELD
    assert [r for b in out for r in b.column(0).to_pylist()] == [1] * 200 + [2] * 200


def test_flat_map_gives_all_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (None, "c")], "k long, t string")
    got = tables.flat_map(df, lambda k, t: ((k, n, c) for n, c in enumerate(t or "")), "k long, n int, c string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, "a"), (1, 1, "b"), (None, 0, "c")]


def test_a_childs_sentences_are_known_from_its_parent():
    text = " ".join(f"Sentence number {k} has some words of its own, like w{k * 7} and x{k * 11}." for k in range(60))
    chunking.terms.cache_clear()
    (parent, *_), *_ = chunking.pack_text(text, 100_000, 0)
    read = chunking.terms.cache_info().misses
    children = chunking.pack_text(parent, 100, 20)
    assert len(children) > 5 and chunking.terms.cache_info().misses == read == 60


def test_cleaned_blocks_are_computed_once(spark):
    rows = [(1, 1, 0, "header", "Same  12"), (1, 2, 0, "header", "same 13"), (1, 1, 1, "text", "a-\nb\tc"), (1, 1, 2, "text", "A-b c"), (1, 2, 1, "text", "x  yﬁ"), (2, 1, 0, "text", None)]
    left, done = docprep.clean_documents(spark.createDataFrame(rows, "doc_id long, page int, block_order int, kind string, text string"))
    for df in (left, done):
        assert "EvalPython" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, left.collect())) == [(1, 1, 1, "text", "a- b c"), (1, 2, 1, "text", "x yfi")]
    assert sorted((r.page, r.block_order, r.action) for r in done.collect()) == [(1, 0, "remove_header"), (1, 1, "merge_visual_lines"), (1, 2, "remove_duplicate"), (2, 0, "remove_header")]


def test_parts_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from corpusmill.plans import more_queries

    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    spark.range(1000).selectExpr("id div 5 as l_orderkey", "id as l_partkey", "cast(id % 5 as int) as l_linenumber", "'A' as l_returnflag", "1.0D as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (more_queries.dc7_merge_tables, more_queries.wn11_reading_order, more_queries.wn8_table_islands):
        df = query(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 20


def test_numbers_of_one_large_group_come_from_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 40)
    df = spark.range(300).selectExpr("if(id < 250, 1, if(id < 299, null, 3)) as k", "sha1(cast(id as string)) as line")
    got = tables.numbered(df, ["k"], "line", "n").collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r.line)
    assert sorted(((r.k, r.n, r.line) for r in got), key=str) == sorted(((k, n, x) for k, v in want.items() for n, x in enumerate(sorted(v), 1)), key=str)
    assert sorted(r.n for r in tables.numbered(df.select("line"), [], "line", "n").collect()) == list(range(1, 301))


def test_phrases_leave_as_they_are_found(spark):
    """The search of phrases holds some texts of a batch at once, none as a pandas table."""
    from corpusmill.operators import retrieval

    texts = spark.createDataFrame([(1, "abcab"), (2, ""), (3, None), (4, "xbc")], "chunk_id long, _text string")
    found = retrieval.contained(texts, spark.createDataFrame([("ab",), ("bc",), ("",), ("zz",), ("ab",)], "phrase string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "ab"), (1, "bc"), (4, "bc")]
    assert retrieval.contained(texts, spark.createDataFrame([], "phrase string")).collect() == []
