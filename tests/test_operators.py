"""Hand-made cases: golden values, folds, ties, empty inputs."""

import hashlib
import hmac
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import docprep, evaluation, facts, graph, ops, retrieval, vector_index


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rrf_prefers_shared_and_records_routes(spark):
    ranked = spark.createDataFrame([(1, "dense", 1, 1, 0.9), (1, "dense", 2, 2, 0.8), (1, "exact", 1, 2, 1.0), (1, "exact", 2, 3, 0.5)], "query_id long, route string, rank int, chunk_id long, score double")
    got = {r.chunk_id: r for r in retrieval.rrf(ranked).collect()}
    assert max(got, key=lambda k: got[k].rrf_score) == 2 and got[2].n_routes == 2 and got[2].first_route == "dense"


@pytest.mark.parametrize("parts", [1, 8])
def test_rrf_does_not_depend_on_partitions(spark, parts):
    ranked = spark.range(400).select((F.col("id") % 5).alias("query_id"), F.when(F.col("id") % 2 == 0, "dense").otherwise("exact").alias("route"), (F.col("id") % 40 + 1).cast("int").alias("rank"), (F.col("id") % 23).alias("chunk_id"), F.lit(1.0).alias("score"))
    got = retrieval.rrf(ranked.repartition(parts)).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("s"))
    assert sorted(rows(got)) == sorted(rows(retrieval.rrf(ranked).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("s"))))


def test_budget_passes_over_what_does_not_fit(spark):
    ranked = spark.createDataFrame([(1, 1, 10, 15), (1, 2, 11, 10), (1, 3, 12, 5), (2, 1, 20, 99)], "query_id long, rank int, chunk_id long, tokens int")
    assert sorted((r.query_id, r.chunk_id) for r in retrieval.budget_select(ranked, 5, 20).collect()) == [(1, 10), (1, 12), (2, 20)]


def test_empty_scope_gives_nothing(spark):
    chunks = spark.createDataFrame([(1, 5, "child")], "chunk_id long, kb_id long, chunk_type string")
    assert rows(retrieval.scope_filter(chunks, spark.createDataFrame([], "kb_id long"))) == []
    allowed = spark.createDataFrame([(1, 1), (1, 3)], "user_id long, kb_id long")
    asked = spark.createDataFrame([(1, [3, 1, 3])], "user_id long, requested array<long>")
    assert rows(retrieval.resolve_scope(asked, allowed)) == [(1, "ok", [3, 1])]
    denied = spark.createDataFrame([(1, [2])], "user_id long, requested array<long>")
    assert rows(retrieval.resolve_scope(denied, allowed)) == [(1, "denied", None)]


def test_scope_filter_is_below_the_ranking(spark):
    chunks = spark.createDataFrame([(1, 1, "child", 7, 0.5)], "chunk_id long, kb_id long, chunk_type string, query_id long, score double").withColumn("route", F.lit("dense"))
    plan = retrieval.rank_routes(retrieval.scope_filter(chunks, spark.createDataFrame([(1,)], "kb_id long")), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


@pytest.mark.parametrize(("ranked", "relevant", "k", "want"), [(["x", "b", "a"], ["a", "b"], 3, (1.0, 2 / 3, 1.0, 0.5)), (["doc1", "doc1", "doc2"], ["doc1", "doc2"], 5, (1.0, 2 / 5, 1.0, 1.0))])
def test_ranking_metrics_golden(spark, ranked, relevant, k, want):
    r = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ranked)], "query_id long, rank int, item string")
    g = spark.createDataFrame([(1, x, 1) for x in relevant], "query_id long, item string, grade int")
    m = evaluation.ranking_metrics(r, g, k).first()
    assert (m.hit, pytest.approx(m.precision), pytest.approx(m.recall), pytest.approx(m.mrr)) == want
    if len(set(ranked)) == 2:
        assert m.ndcg == pytest.approx(1.0)


def test_js_divergence_of_disjoint_is_one(spark):
    p, q = (spark.createDataFrame([(x, 1.0)], "value string, share double") for x in "ab")
    assert evaluation.js_divergence(p, q).first()[0] == 1.0 and evaluation.js_divergence(p, p).first()[0] == 0.0


def test_compare_cases_golden(spark):
    s = "case_key string, overall_score double, passed boolean, critical boolean"
    a = spark.createDataFrame([("a", 0.9, True, False), ("b", 0.4, False, False)], s)
    b = spark.createDataFrame([("b", 0.8, True, False), ("a", 0.7, True, False)], s)
    assert {r.case_key: r.change for r in evaluation.compare_cases(a, b).collect()} == {"a": "regressed", "b": "fixed"}


def test_arguments_match(spark):
    df = spark.createDataFrame([('{"a": 1.0, "t": 5}', '{"a": 1.005, "t": 9, "x": 2}')], "e string, a string")
    got = df.select(*[evaluation.arguments_match(F.col("e"), F.col("a"), F.lit(m), F.lit("t"), F.lit(0.01)).alias(m) for m in ("subset", "exact")]).first()
    assert (got.subset, got.exact) == (True, False)


def test_tool_scores_golden(spark):
    calls = spark.createDataFrame([(1, "a", "x=1", True), (1, "x", "", True), (2, "a", "1", True), (2, "a", "2", True), (2, "a", "2", True)], "case_id long, tool string, arguments string, success boolean")
    want = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "case_id long, tools array<string>")
    got = {r.case_id: r for r in evaluation.tool_scores(calls, want).collect()}
    assert (got[1].exact, got[1].precision, got[1].recall) == (0.0, 0.5, 0.5) and got[2].redundant_rate == pytest.approx(1 / 3)


def test_preference_vote_moves(spark):
    votes = spark.createDataFrame([(1, 1, "concise", 1), (1, 1, "concise", 2), (1, 1, "detailed", 3)], "user_id long, message_id long, style string, ts long")
    r = ops.preference_profile(votes).first()
    assert (r.concise, r.detailed, r.preferred) == (0, 1, "detailed")


def test_table_merge_golden(spark):
    t = spark.createDataFrame([(1, "t1", 1, 1, ["Drug", "Dose"], [["A", "5 mg"]], ["n"], 0.9), (1, "t2", 2, 2, ["Drug", "Dose"], [["Drug", "Dose"], ["B", "10 mg"]], ["n"], 0.8), (1, "t3", 4, 4, ["Drug", "Dose"], [["C", "1"]], [], 1.0)], "doc_id long, table_id string, page_start int, page_end int, headers array<string>, rows array<array<string>>, footnotes array<string>, confidence double")
    got = {r.table_id: r for r in docprep.merge_tables(t).collect()}
    assert set(got) == {"t1", "t3"} and got["t1"].page_end == 2 and [list(x) for x in got["t1"].rows] == [["A", "5 mg"], ["B", "10 mg"]] and got["t1"].confidence == 0.8 and got["t1"].merged == 2
    assert docprep.table_markdown(t).first().markdown == "| Drug | Dose |\n| --- | --- |\n| A | 5 mg |"


def test_split_chars_ends(spark):
    docs = spark.createDataFrame([(1, "a." + "b" * 600)], "doc_id long, text string")
    got = docprep.split_chars(docs).collect()
    assert got[-1].start + len(got[-1].content) == 602 and all(b.start > a.start for a, b in zip(got, got[1:], strict=False))


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "a&amp;b  \uff43\nx\nx\nx\n\n\n\nend \u200b"), (2, None), (3, "see https://x.org now")], "id int, text string")
    assert [r.clean for r in tx.clean_text(df, remove_urls=True).orderBy("id").collect()] == ["a&b c\nx\n\nend", "", "see now"]


def test_hmac(spark):
    got = spark.range(1).select(tx.hmac_sha256("secret", F.lit("1:2:3")).alias("h")).first().h
    assert got == hmac.new(b"secret", b"1:2:3", hashlib.sha256).hexdigest()


def test_merge_changes(spark):
    s = "tenant_id long, user_id long, subject string, predicate string, value string, source_type string, confidence double, ts timestamp"
    c = [(1, 1, "s", "p", v, src, 0.9, f"2024-01-0{d} 00:00:00") for d, (v, src) in enumerate([("x", "user_explicit"), ("x", "web"), ("y", "web"), ("z", "clinician")], 1)]
    df = spark.createDataFrame(c, s.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.version, r.value, r.status, r.sources) for r in facts.merge_changes(df).collect())
    assert got == [(1, "x", "superseded", 2), (1, "y", "disputed", 1), (2, "z", "active", 1)]


def test_bfs_and_relations(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")], "source string, relation string, target string")
    got = graph.bfs(e, spark.createDataFrame([("b",)], "id string"), 1)
    assert sorted(rows(got)) == [("a", 1), ("b", 0), ("c", 1)]
    both = graph.relations(e, graph.bfs(e, spark.createDataFrame([("b",)], "id string"), 2), 2)
    assert both.filter("source = 'a'").count() == 2


def test_citations(spark):
    a = spark.createDataFrame([(1, "x [ev_0123456789abcdef] y [ev_ffffffffffffffff] [ev_0123456789abcdef]")], "answer_id long, answer string")
    e = spark.createDataFrame([("ev_0123456789abcdef",)], "evidence_id string")
    r = retrieval.validate_citations(a, e).first()
    assert r.known == ["ev_0123456789abcdef"] and r.unknown == ["ev_ffffffffffffffff"] and "[ev_ffff" not in r.answer


def test_evidence_conflicts(spark):
    e = spark.createDataFrame([(1, "e1", True, True, "take", "50 mg", False), (1, "e2", True, True, "take", "100 mg", False), (2, "e3", True, True, "t", "50 mg", False)], "query_id long, evidence_id string, authorized boolean, usable boolean, text string, dosage string, missing boolean")
    assert {r.query_id: r.status for r in retrieval.evidence_status(e).collect()} == {1: "conflicting", 2: "sufficient"}


def through_index(queries, chunks, k, **more):
    """dense_topk's arguments, by an index in a folder of its own."""
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    vector_index.build_index(chunks, f"file://{top}/index", sample=2000)
    return vector_index.search_index(queries, f"file://{top}/index", k, most=4 * k, **more)


def test_ann_on_the_embeddings(spark):
    """Recall at 10 of 0.9 at least on the given vectors, with full vectors of at most a tenth of the chunks a query."""
    from corpusmill.plans.retrieval_queries import vectors_of

    q, v = vectors_of(spark, "/root/testdata/sf0.01")
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    vector_index.build_index(v, f"file://{top}/index")
    n, found = v.count(), vector_index.candidates(q, f"file://{top}/index", 40)
    assert spark.read.parquet(f"file://{top}/index/codes").count() == n and max(r["count"] for r in found.groupBy("query_id").count().collect()) <= n / 10
    exact, near = (set(rows(df.select("query_id", "chunk_id"))) for df in (retrieval.dense_topk(q, v, 10), vector_index.search_index(q, f"file://{top}/index", 10, 40)))
    assert len(near) == len(exact) and len(exact & near) / len(exact) >= 0.95


def test_ann_recall(spark):
    import numpy as np

    r = np.random.default_rng(0)
    centre = r.normal(size=(20, 16))
    v = [(int(i), [float(x) for x in centre[i % 20] + 0.15 * r.normal(size=16)]) for i in range(400)]
    c = spark.createDataFrame(v, "chunk_id long, embedding array<float>")
    q = c.filter("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    exact, near = (set(rows(f(q, c, 5).select("query_id", "chunk_id"))) for f in (retrieval.dense_topk, through_index))
    assert len(exact & near) / len(exact) >= 0.9


def test_ann_recall_without_clusters(spark):
    import numpy as np

    r = np.random.default_rng(1)
    c = spark.createDataFrame([(i, [float(x) for x in r.normal(size=64)]) for i in range(2000)], "chunk_id long, embedding array<float>")
    q = c.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    exact, near = (set(rows(f(q, c, 10).select("query_id", "chunk_id"))) for f in (retrieval.dense_topk, through_index))
    others = {x for x in exact if x[0] != x[1]}
    assert len(near) == 1000 and len(exact & near) / len(exact) >= 0.9 and len(others & near) / len(others) >= 0.9


@pytest.mark.parametrize("f", [retrieval.dense_topk, through_index])
def test_dense_takes_any_number_of_queries(spark, f):
    import numpy as np

    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(300, 8)), 2)
    c = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    q = c.withColumnRenamed("chunk_id", "query_id")
    got = rows(f(q, c, 5, most_queries=64).select("query_id", "rank", "chunk_id"))
    assert len(got) == 1500 and len({x[:2] for x in got}) == 1500
    if f is retrieval.dense_topk:
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5]
        assert set(got) == {(i, k + 1, int(best[i, k])) for i in range(300) for k in range(5)}
    assert f(q.limit(0), c, 5).collect() == []


def test_text_metrics(spark):
    """Shares worked out by hand."""
    rows = [
        ('Give 5 mg and "one dose" to Patients', "take 5 MG as one dose", "how much", "give 5 mg", 0.5),
        ("plain words only here", "plain words elsewhere", "what is plain here", "plain words only here", 1.0),
        ("", "context", "question", "x", 0.0),
        ("aaaa bbbb. cccc dddd", "aaaa", "zz yy", "aaaa bbbb cccc", 0.5),
    ]
    df = spark.createDataFrame(rows, "a string, c string, q string, e string, want double")
    got = df.select("want", evaluation.faithfulness(F.col("a"), F.col("c")).alias("f"), evaluation.relevancy(F.col("q"), F.col("a")).alias("r"), evaluation.correctness(F.col("a"), F.col("e")).alias("x"), evaluation.token_f1(F.col("a"), F.col("e")).alias("t")).collect()
    assert [round(g.f, 6) for g in got] == [round(g.want, 6) for g in got]
    assert [round(g.r, 6) for g in got] == [0.0, 1.0, 0.0, 0.0] and got[1].x == 1.0 and got[2].x == 0.0
    assert abs(got[3].t - 2 * 2 / (4 + 3)) < 0.3 and 0 < got[3].x < 1
    han = spark.createDataFrame([("高血压怎么治疗", "高血压的治疗")], "q string, a string").select(evaluation.relevancy(F.col("q"), F.col("a")).alias("r")).first().r
    assert 0 < han < 1


def test_longest_common_subsequence_against_a_table(spark):
    import random

    r, pairs = random.Random(1), []
    for _ in range(60):
        x, y = ("".join(r.choice("abcé ") for _ in range(r.randrange(0, 90))) for _ in range(2))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        pairs.append((x, y, t[-1][-1] / max(len(x), len(y)) if x and y else float(x == y)))
    got = spark.createDataFrame(pairs, "x string, y string, want double").select("want", evaluation.longest_common_share(F.col("x"), F.col("y")).alias("s")).collect()
    assert all(abs(g.s - g.want) < 1e-9 for g in got)


def test_exact_terms_count_in_their_order(spark):
    """The first 20 distinct terms as given, not by the alphabet; one that only metadata holds scores 0."""
    terms = spark.createDataFrame([(1, f"z{k:02d}", k) for k in range(20)] + [(1, "aaa", 20), (1, "Z00", 21)], "query_id long, term string, pos int")
    chunks = spark.createDataFrame([(1, "z00 z19", []), (2, "aaa", []), (3, "none", ["has z05"])], "chunk_id long, content string, codes array<string>")
    got = {r.chunk_id: r.score for r in retrieval.exact_topk(terms, chunks, 10, metadata=["codes"]).collect()}
    assert got == {1: 0.1, 3: 0.0}


def test_budget_falls_back_to_own_content(spark):
    ranked = spark.createDataFrame([(1, 1, 10, 99, 5), (1, 2, 11, 10, 2)] + [(2, k, k, 30, 30) for k in range(1, 90)] + [(2, 90, 500, 1, 1)], "query_id long, rank int, chunk_id long, tokens int, own_tokens int")
    got = [(r.query_id, r.chunk_id, r.tokens, r.own) for r in retrieval.budget_select(ranked, 5, 31).orderBy("query_id", "place").collect()]
    assert got == [(1, 10, 5, True), (1, 11, 10, False), (2, 1, 30, False), (2, 500, 1, False)]


def test_prefix_pairs_lose_nothing(spark):
    import random

    r, rows = random.Random(4), []
    for k in range(60):
        w = {b: r.random() for b in r.sample(range(20), 6)} if k % 3 else {b: 1 + r.random() / 9 for b in range(k % 5, k % 5 + 6)}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(k, b, x / norm) for b, x in w.items()]
    v = spark.createDataFrame(rows, "id long, bucket int, weight double")
    by = {k: {b: x for i, b, x in rows if i == k} for k in range(60)}
    want = {(a, b) for a in by for b in by if a < b and round(sum(x * by[b].get(k, 0) for k, x in by[a].items()), 6) >= 0.8}
    assert {(p.a, p.b) for p in evaluation.near_duplicate_pairs(v, 0.8).collect()} == want and want


def test_line_runs_against_groups(spark):
    import itertools
    import random

    r, texts = random.Random(2), ["", "a", "a\na", "a\na\na", "\n\n\n\nx", "a\na\na\nb\nb\na"]
    texts += ["\n".join(r.choice(["a", "b", ""]) for _ in range(r.randrange(30))) for _ in range(80)]
    want = ["\n".join(x for k, g in itertools.groupby(t.split("\n")) for x in (lambda g: g[:1] if len(g) >= 3 else g)(list(g))) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", tx.drop_line_runs(F.col("t")).alias("t")).orderBy("id").collect()
    assert [x.t for x in got] == want


CHUNKS = "chunk_id long, document_id long, kb_id long, chunk_index int, chunk_type string, parent_chunk_id long, content string, content_type string, section_path array<string>, quality_status string, source_type string, embedding array<double>"


def hybrid_fixture(spark):
    def child(key, doc, kb, n, content, vector, path=("a",)):
        return (key, doc, kb, n, "child", doc * 100, content, "text", list(path), "good", "local_knowledge_base", vector)

    chunks = [
        child(1, 1, 1, 0, "alpha opens", [1.0, 0.0]), child(2, 1, 1, 1, "beta dose 5 mg", [0.0, 1.0], ()), child(3, 1, 1, 2, "gamma ends", [0.6, 0.8]),
        child(4, 2, 2, 0, "beta dose 5 mg", [0.0, 1.0]), child(5, 3, 1, 0, "beta " * 60 + "dose", [0.1, 1.0]),
        (100, 1, 1, -1, "parent", None, "whole of one", "text", ["a"], "good", None, None), (300, 3, 1, -1, "parent", None, "word " * 200, "text", ["a"], "good", None, None),
    ]
    queries = [(1, "beta dose", [0.0, 1.0], ["5 mg"]), (2, "beta dose", None, []), (3, "  ", [0.0, 1.0], []), (4, "unheard", None, [])]
    terms = [(1, "beta dose"), (2, "beta dose"), (3, "beta")]
    return (
        spark.createDataFrame(queries, "query_id long, query string, embedding array<double>, constraints array<string>"),
        spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(terms, "query_id long, term string"),
    )


def test_hybrid_scope_context_and_status(spark):
    queries, chunks, terms = hybrid_fixture(spark)
    scope = spark.createDataFrame([(1,)], "kb_id long")
    rows = retrieval.hybrid_retrieve(queries, chunks, terms, scope, k=3).collect()
    status = {r.query_id: r.status for r in rows}
    assert status == {1: "success", 2: "partial", 3: "no_result", 4: "partial"}  # 4: a route was missing, and nothing was found
    got = {(r.query_id, r.chunk_id): r for r in rows if r.chunk_id is not None}
    assert not any(k[1] == 4 for k in got)  # outside the scope
    assert got[1, 2].place == 1 and got[1, 2].context == "alpha opens\ngamma ends\nwhole of one"  # neighbours, then the parent
    assert got[1, 2].tokens == 2 + 2 + 3
    assert {k[1] for k in got if k[0] == 2} == {2, 5}


def test_hybrid_budget_and_empty_scope(spark):
    queries, chunks, terms = hybrid_fixture(spark)
    only = chunks.filter("document_id = 3")
    scope = spark.createDataFrame([(1,), (1,)], "kb_id long")
    r = retrieval.hybrid_retrieve(queries.filter("query_id = 1"), only, terms, scope, k=3, most_tokens=100).first()
    assert r.tokens == 61 and r.context == ("beta " * 60 + "dose")  # the parent is too large, so its own text counts
    rows = retrieval.hybrid_retrieve(queries, chunks, terms, scope.filter("kb_id = 9")).collect()
    assert len(rows) == 4 and {(r.status, r.chunk_id) for r in rows} == {("error", None)}


def test_numbers_and_kinds(spark):
    rows = [("take 5.0 mg", 5.0, True), ("take 1.5.0 mg", 5.0, False), ("take 50 mg", 5.0, False), ("5 %", 5.0, False)]
    df = spark.createDataFrame(rows, "t string, v double, want boolean")
    got = df.select("want", retrieval.numeric_present(F.col("t"), F.lit(""), F.lit("numeric_condition"), F.lit("MG"), F.array("v")).alias("g"), retrieval.numeric_present(F.col("t"), F.lit(""), F.lit(""), F.lit(""), F.array().cast("array<double>")).alias("none")).collect()
    assert all(r.g == r.want and not r.none for r in got)
    kinds = spark.createDataFrame([("drug_label", 9), (None, 7), ("", 7), ("blog", 5)], "s string, want int")
    assert all(r.a == r.want for r in kinds.select("want", tx.authority(F.col("s")).alias("a")).collect())


def test_complexity_bounds_and_clashing_names(spark):
    from corpusmill.functions import requests as rq

    rows = [("什么是高血压", 1), ("查询我的检查结果", 2), ("based on the record, compare dose; compare renal risk; then search, and then plan", 3), (None, 4)]
    df = spark.createDataFrame(rows, "text string, size int")
    got = {r["size"]: r for r in rq.complexity(df, "text").collect()}
    assert {k: r["mode"] for k, r in got.items()} == {1: "direct", 2: "react", 3: "multi_agent", 4: "direct"}
    assert got[2]["score"] >= 0.22 and got[3]["score"] >= 0.5 and got[3]["signals"]["tool_dependency"] == 1.0 and got[4]["score"] == 0.0
    more = rq.complexity(df.withColumn("s", F.lit("x" * 240)), "text", summary="s").filter("size = 4").first()
    assert more["signals"]["multi_turn_dependency"] == 0.75 and abs(more["signals"]["context_complexity"] - 0.2) < 1e-9


def test_cleaning_rules_and_audit(spark):
    """Hand-made blocks: what is removed, repaired, merged, and what the audit says of it."""
    rows = [
        ("header", "Report 1", 1, 0), ("text", "the con-\ntrolled dose-\ndependent élé-\nment", 1, 1), ("text", "first line\nsecond line.\n- item", 1, 2), ("text", "***", 1, 3), ("text", "===", 1, 4),
        ("text", "Draft", 1, 5), ("text", "Page 3 of 9", 1, 6), ("text", "one  two", 1, 7), ("text", "One, two", 1, 8), ("text", "   ", 1, 9), ("text", "1.2 Methods", 1, 10), ("header", "Report 2", 2, 0), ("text", "l0 mg", 2, 1),
    ]
    b = spark.createDataFrame(rows, "kind string, text string, page int, block_order int").withColumn("doc_id", F.lit(1)).withColumn("confidence", F.when(F.col("page") == 2, 0.5))
    kept, done = docprep.clean_documents(b)
    got = {(r.page, r.block_order): (r.kind, r.text) for r in kept.collect()}
    assert got == {
        (1, 1): ("text", "the controlled dose-dependent élé- ment"), (1, 2): ("text", "first line second line. - item".replace(" - ", "\n- ")), (1, 3): ("text", "***"), (1, 4): ("text", "==="),
        (1, 7): ("text", "one two"), (1, 10): ("heading", "1.2 Methods"), (2, 1): ("heading", "10 mg"),
    }
    said = sorted((r.page, r.block_order, r.action) for r in done.collect())
    assert said == [
        (1, 0, "remove_header"), (1, 1, "merge_visual_lines"), (1, 1, "repair_hyphenation"), (1, 2, "merge_visual_lines"), (1, 5, "remove_watermark"), (1, 6, "remove_page_number"),
        (1, 8, "remove_duplicate"), (2, 0, "remove_header"), (2, 1, "repair_ocr_numeric_unit"),
    ]
