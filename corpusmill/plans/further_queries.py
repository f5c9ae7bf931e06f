"""Queries over runs, files, sections, text metrics and pairs, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as tx
from corpusmill.operators import benchmarks as bm
from corpusmill.operators import docprep
from corpusmill.operators import evaluation as ev
from corpusmill.operators import retrieval as rt
from corpusmill.plans.document_queries import VECTORS
from corpusmill.plans.evaluation_queries import CASES, case_runs
from corpusmill.plans.registry import query, scratch, table
from corpusmill.sources import files, snapshots


@query(f"WITH {CASES} SELECT k AS case_key, a.passed AS before, b.passed AS after FROM a JOIN b USING (k)")
def jn2_match_runs(spark: SparkSession, sf: str) -> DataFrame:
    return ev.match_runs(*case_runs(spark, sf)).select("case_key", F.col("a.passed").alias("before"), F.col("b.passed").alias("after"))


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return tx.hashed_vector(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), "id", "text")


PAIRS = f"WITH {VECTORS}, s AS (SELECT x.item_id AS a, y.item_id AS b, round(sum(x.weight * y.weight), 6) AS similarity FROM v x JOIN v y USING (bucket) WHERE x.item_id <> y.item_id GROUP BY 1, 2)"


@query(f"{PAIRS} SELECT a, b, similarity FROM s WHERE a < b AND similarity >= 0.7")
def jn8_near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ev.near_duplicate_pairs(vectors_of(spark, sf), 0.7)


@query(f"{PAIRS} SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM s WHERE similarity >= 0.6) WHERE n = 1")
def jn9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ev.nearest(vectors_of(spark, sf), vectors_of(spark, sf), 0.6)


RESULTS = "r AS (SELECT event_id, ts, event_type, value, value > 50 AS passed, event_type = 'error' AS error, user_id % 5 AS steps FROM events)"


@query(f"""WITH {RESULTS}, t AS (SELECT avg(passed::INT) AS pass_rate, avg(value) AS latency_mean, quantile_disc(value, 0.5) AS latency_p50, quantile_disc(value, 0.95) AS latency_p95, quantile_disc(value, 0.99) AS latency_p99,
    sum(event_id % 100)::DOUBLE AS tokens, sum(event_id % 7)::DOUBLE AS cost, count(*)::DOUBLE AS calls, sum(steps)::DOUBLE AS steps, count(*) FILTER (error)::DOUBLE AS errors, count(*) FILTER (NOT error)::DOUBLE AS valid FROM r),
  u AS (UNPIVOT t ON COLUMNS(*) INTO NAME measure VALUE value)
  SELECT measure, round(value, 3) AS value FROM u UNION ALL SELECT 'mean_whole', round(avg(value), 3) FROM r UNION ALL SELECT 'mean_some', round(avg(value), 3) FROM r WHERE passed""")
def ag6_run_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    scores = F.create_map(F.lit("whole"), F.col("value"), F.lit("some"), F.when(F.col("value") > 50, F.col("value")))
    results = e.select(
        scores.alias("scores"), (F.col("value") > 50).alias("passed"), F.col("value").alias("latency"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 7).alias("cost"), F.lit(1).alias("calls"),
        (F.col("user_id") % 5).alias("steps"), (F.col("event_type") == "error").alias("error"),
    )
    return ev.run_aggregate(results).select("measure", F.round("value", 3).alias("value"))


@query("""WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200), p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM n)
  SELECT 'status_' || event_type AS measure, count(*)::DOUBLE AS value FROM n GROUP BY 1 UNION ALL SELECT 'average_evidence', round(avg(user_id % 9), 4) FROM n UNION ALL SELECT 'latency_p95', round(value, 4) FROM p WHERE i = least(n - 1, floor(n * 0.95))""")
def ag3_retrieval_monitor(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("trace_id"), "ts", F.col("event_type").alias("status"), (F.col("user_id") % 9).alias("evidence"), F.col("value").alias("latency"))
    return ev.retrieval_monitor(e, 200).select("measure", F.round("value", 4).alias("value"))


@query("SELECT o_orderpriority AS suite, count(*) AS cases, round(avg(o_totalprice), 3) AS price, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END), 3) AS third FROM orders GROUP BY 1")
def ev8_suite_averages(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("suite"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("third"))
    return ev.suite_averages(o, ["price", "third"]).select("suite", "cases", F.round("price", 3).alias("price"), F.round("third", 3).alias("third"))


@query(r"""WITH q AS (SELECT conv_id, text AS query FROM conversations WHERE turn = 0), c AS (SELECT conv_id, turn, CASE WHEN v = 'B' THEN regexp_replace(text, '[0-9]', '', 'g') ELSE text END AS text, v FROM conversations, (VALUES ('A'), ('B')) x(v) WHERE turn > 0),
  s AS (SELECT v, conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')), regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')))::DOUBLE AS share FROM c JOIN q USING (conv_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY v, conv_id ORDER BY share DESC, turn) AS rank FROM s), f AS (SELECT v, conv_id, min(rank) AS rank FROM r WHERE turn = 1 GROUP BY 1, 2)
  SELECT v AS variant, count(*) AS cases, round(avg((rank <= 5)::INT), 6) AS recall_at_5, round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM f GROUP BY 1""")
def ev31_variant_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's first message as the query for the answer to it, among its other messages, as they are or without digits."""
    c = table(spark, sf, "conversations")
    rows = c.filter("turn > 0").join(c.filter("turn = 0").select("conv_id", F.col("text").alias("query")), "conv_id").withColumn("variant", F.explode(F.array(F.lit("A"), F.lit("B"))))
    rows = rows.select("variant", F.col("conv_id").alias("case_id"), "query", F.when(F.col("variant") == "B", F.regexp_replace("text", "[0-9]", "")).otherwise(F.col("text")).alias("text"), F.col("turn").alias("place"), (F.col("turn") == 1).alias("relevant"))
    return ev.variant_benchmark(rows).select("variant", "cases", *[F.round(n, 6).alias(n) for n in ("recall_at_5", "recall_at_10", "mrr")])


@query()
def ev7_text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer of a conversation against the message before it as question, context and expected answer."""
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    answer, question = F.col("text"), F.col("question")
    metrics = {"faithfulness": ev.faithfulness(answer, question), "relevancy": ev.relevancy(question, answer), "correctness": ev.correctness(answer, question)}
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", *[F.round(m, 6).alias(n) for n, m in metrics.items()])


@query("SELECT c_custkey AS id, c_name AS query FROM customer")
def src1_read_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as JSON lines and read back as cases."""
    path = scratch(spark, "cases")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("query")).coalesce(1).write.json(path)
    return files.read_cases(spark, path, "id long, query string")


@query("""SELECT CASE WHEN c_custkey % 10 = 2 THEN NULL ELSE c_custkey END AS id, CASE WHEN c_custkey % 10 = 2 THEN '{"id": ' || c_custkey ELSE NULL END AS bad_line FROM customer WHERE c_custkey % 10 NOT IN (0, 1)""")
def src2_read_jsonl_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Lines from customers: comments, blanks, broken objects and good ones."""
    k = F.col("c_custkey")
    line = F.when(k % 10 == 0, "# comment").when(k % 10 == 1, "  ").when(k % 10 == 2, F.concat(F.lit('{"id": '), k)).otherwise(F.concat(F.lit('{"id": '), k, F.lit("}")))
    path = scratch(spark, "lines")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    good, bad = files.read_jsonl_strict(spark, path, "id long")
    return good.select("id", F.lit(None).cast("string").alias("bad_line")).unionByName(bad.select(F.lit(None).cast("long").alias("id"), F.col("line").alias("bad_line")))


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE (o_orderkey // 2)::VARCHAR END AS case_id, o_orderkey AS k FROM orders)
  SELECT case_id, 'no case_id' AS violation FROM r WHERE case_id = '' UNION ALL SELECT case_id, 'no status' FROM r WHERE k % 5 = 0 UNION ALL SELECT case_id, 'no answer' FROM r WHERE k % 7 = 0
  UNION ALL SELECT case_id, 'bad evidence' FROM r WHERE k % 3 = 0 UNION ALL SELECT case_id, 'bad tool call' FROM r WHERE k % 13 = 0 UNION ALL SELECT case_id, 'no tool list' FROM r WHERE k % 17 = 0 AND k % 13 <> 0
  UNION ALL SELECT case_id, 'repeated case_id' FROM r WHERE case_id <> '' GROUP BY 1 HAVING count(*) > 1""")
def src4_validate_run(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as captured executions with faults by their keys."""
    k = F.col("o_orderkey")
    call = F.struct(F.lit("find").alias("name"), F.create_map(F.lit("q"), F.lit("x")).alias("arguments"), F.when(k % 13 != 0, "ok").alias("status"))
    rows = table(spark, sf, "orders").select(
        F.when(k % 11 == 0, "").otherwise(F.floor(k / 2).cast("string")).alias("case_id"), F.when(k % 5 != 0, "success").alias("status"), F.lit(None).cast("string").alias("answer"), F.when(k % 7 != 0, "text").alias("final_answer"),
        F.array(F.struct(F.when(k % 3 != 0, "e1").alias("evidence_id"), F.lit("held").alias("content"))).alias("retrieved_evidence"), F.when((k % 17 != 0) | (k % 13 == 0), F.array(call)).alias("tool_calls"),
    )
    return files.validate_run(rows)


@query("""WITH m AS (SELECT min(conv_id) AS lo, max(conv_id) AS hi FROM conversations)
  SELECT conv_id, turn, CASE WHEN conv_id = lo THEN 'new ' ELSE '' END || text AS text, text AS before, 0 AS unlike FROM conversations, m WHERE conv_id <> hi AND NOT (conv_id = lo AND turn > 0)""")
def src6_replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as chunks: one conversation is written again, shorter, and one deleted; all others stay, whatever bucket they share.

    before: the text in the version before, which can still be read; unlike: conversations whose chunks are not as many as they should be.
    """
    top = scratch(spark, "chunks")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    ends = c.agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    first = files.replace_chunks(spark, top, c, key="conv_id")
    again = c.join(ends, (F.col("conv_id") == F.col("lo")) & (F.col("turn") == 0), "left_semi").withColumn("text", F.concat(F.lit("new "), "text"))
    second = files.replace_chunks(spark, top, again, ends.select(F.explode(F.array("lo", "hi")).alias("conv_id")), "conv_id")
    now, old = (snapshots.read(spark, top, "chunks", of=v) for v in (second, first))
    unlike = files.unlike_counts(now, again, "conv_id", "text").select(F.col("conv_id").alias("_u"))
    before = old.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("text").alias("before"))
    j = now.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").join(unlike, F.col("conv_id") == F.col("_u"), "left")
    return j.select("conv_id", "turn", "text", "before", F.col("_u").isNotNull().cast("int").alias("unlike"))


@query(r"""WITH l AS (SELECT doc_id, doc_id % 3 = 0 AS again, text, unnest(['document', 'page', 'block', 'table', 'chunk', 'report']) AS layer FROM documents)
  SELECT doc_id, layer, CASE layer WHEN 'document' THEN CASE WHEN doc_id % 5 = 0 THEN 'approved' WHEN again THEN 'second' ELSE 'first' END WHEN 'page' THEN sha256(text) WHEN 'block' THEN len(string_split(text, chr(10)))::VARCHAR
    WHEN 'table' THEN len(regexp_extract_all(text, '[|]'))::VARCHAR WHEN 'chunk' THEN left(text, 20) ELSE CASE WHEN again THEN '2' ELSE '1' END END AS value FROM l""")
def src7_replace_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Six layers of documents in one commit, a third of the documents in a second one: their approved reviews survive, the others stay."""
    top = scratch(spark, "layers")
    d = table(spark, sf, "documents")

    def layers(docs: DataFrame, run: int, review: str) -> dict[str, DataFrame]:
        value = {"page": F.sha2("text", 256), "block": F.size(F.split("text", "\n", -1)).cast("string"), "table": F.regexp_count("text", F.lit("[|]")).cast("string"), "chunk": F.substring("text", 1, 20), "report": F.lit(str(run))}
        first = docs.withColumn("review_status", F.when((F.lit(run) == 1) & (F.col("doc_id") % 5 == 0), "approved").otherwise(review))
        return {"document": first.select("doc_id", "review_status")} | {k: docs.select("doc_id", v.alias("value")) for k, v in value.items()}

    files.replace_layers(spark, top, layers(d, 1, "first"), d.select("doc_id"))
    some = d.filter("doc_id % 3 = 0")
    again = layers(some, 2, "second")
    again["document"] = files.keep_reviews(again["document"], snapshots.read(spark, top, "document"))
    last = files.replace_layers(spark, top, again, some.select("doc_id"))
    out = [snapshots.read(spark, top, k, of=last).select("doc_id", F.lit(k).alias("layer"), F.col("review_status" if k == "document" else "value").alias("value")) for k in again]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


SECTION_BLOCKS = """b AS (SELECT user_id AS doc_id, event_id // 500 AS page, event_id AS o, event_type = 'error' AS head, CASE WHEN event_type = 'click' THEN 'table' ELSE 'paragraph' END AS block_type FROM events),
  h AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY page, o) AS heads FROM b)"""


@query(f"""WITH {SECTION_BLOCKS}, k AS (SELECT *, coalesce(lag(page) OVER w = page AND lag(heads) OVER w = heads AND lag(block_type) OVER w = block_type, false) AS same FROM h WHERE NOT head WINDOW w AS (PARTITION BY doc_id ORDER BY page, o)),
  s AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY doc_id ORDER BY page, o) - 1 AS section FROM k)
  SELECT s.doc_id, section::BIGINT AS section, s.page, s.block_type, string_agg('line ' || o, chr(10) ORDER BY o) AS text, count(*) AS blocks, (SELECT count(*) FROM h WHERE h.doc_id = s.doc_id AND head AND h.heads <= s.heads) > 0 AS headed FROM s GROUP BY s.doc_id, section, s.page, s.block_type, s.heads""")
def dc21_structural_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as blocks: clicks as tables, errors as headings, 500 event numbers to a page."""
    kind = F.col("event_type")
    blocks = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 500).alias("page"), F.col("event_id").alias("block_order"), F.when(kind == "error", "heading").when(kind == "click", "table").otherwise("text").alias("kind"),
        F.concat(F.lit("line "), "event_id").alias("text"),
    )
    return docprep.structural_sections(blocks).select("doc_id", "section", "page", "block_type", "text", "blocks", (F.size("heading_path") > 0).alias("headed"))


@query("""WITH v AS (SELECT l_orderkey AS answer_id, l_linenumber AS variant_id, l_linestatus AS style, l_orderkey % 2 * l_linenumber AS basis FROM lineitem), m AS (SELECT answer_id FROM v GROUP BY 1 HAVING count(DISTINCT basis) > 1)
  SELECT answer_id, variant_id, row_number() OVER (PARTITION BY answer_id ORDER BY style <> 'F', variant_id) AS place FROM v WHERE answer_id NOT IN (SELECT answer_id FROM m)""")
def rt22_order_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("variant_id"), F.col("l_linestatus").alias("style"), (F.col("l_orderkey") % 2 * F.col("l_linenumber")).alias("basis_id"))
    return rt.order_variants(v, "F")[0].select("answer_id", "variant_id", "place")


@query("""SELECT o_orderkey, 'order' AS text, 'u' || o_orderkey AS url FROM orders UNION ALL SELECT l_orderkey, l_linestatus, 'l' || l_linenumber FROM lineitem""")
def tx21_flatten_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as topics that hold their lines as topics."""
    line = F.struct(F.col("l_linestatus").alias("text"), F.concat(F.lit("l"), "l_linenumber").alias("url"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.collect_list(line)).alias("topics"))
    top = F.array(F.struct(F.lit("order").alias("text"), F.concat(F.lit("u"), "o_orderkey").alias("url"), F.col("topics").alias("topics")))
    rows = table(spark, sf, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.to_json(top).alias("topics"))
    return bm.flatten_topics(rows, "topics").select("o_orderkey", "text", "url")


@query("""WITH RECURSIVE b AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_id AS chunk_id, floor(value)::BIGINT * 3 AS tokens FROM events),
  r AS (SELECT query_id, rank, tokens AS used, 1 AS n, true AS took FROM b WHERE rank = 1
    UNION ALL SELECT b.query_id, b.rank, r.used + CASE WHEN r.n < 3 AND r.used + b.tokens <= 600 THEN b.tokens ELSE 0 END, r.n + (r.n < 3 AND r.used + b.tokens <= 600)::INT, r.n < 3 AND r.used + b.tokens <= 600 FROM r JOIN b ON b.query_id = r.query_id AND b.rank = r.rank + 1)
  SELECT query_id, n AS place, rank, chunk_id, tokens FROM r JOIN b USING (query_id, rank) WHERE took""")
def wn5_budget_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events in their order, three tokens a unit of value: at most three, and 600 tokens, what does not fit passed over."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    ranked = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), place.alias("rank"), F.col("event_id").alias("chunk_id"), (F.floor("value").cast("long") * 3).alias("tokens"))
    return rt.budget_select(ranked, 3, 600).select("query_id", "place", "rank", "chunk_id", "tokens")


@query("""WITH p AS (SELECT part.p_partkey AS chunk_id, lower(p_name) AS c, lower(p_type || chr(10) || p_brand) AS m FROM part), t(pos, term) AS (VALUES (0, 'a'), (1, 'promo'), (2, 'brand#2')),
  h AS (SELECT chunk_id, sum(contains(c, term)::INT) AS hits, bool_or(contains(c, term) OR contains(m, term)) AS held FROM p, t GROUP BY 1)
  SELECT rank, chunk_id, round(score, 6) AS score FROM (SELECT chunk_id, hits / 3.0::DOUBLE AS score, row_number() OVER (ORDER BY hits DESC, chunk_id) AS rank FROM h WHERE held) WHERE rank <= 50""")
def rt3_exact_topk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by terms in their names, or in their makers and brands at score 0."""
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"), F.array("p_type", "p_brand").alias("codes"))
    terms = table(spark, sf, "region").filter("r_regionkey = 0").select(F.lit(1).alias("query_id"), F.posexplode(F.array(F.lit("a"), F.lit("PROMO"), F.lit(" brand#2 "))).alias("pos", "term"))
    return rt.exact_topk(terms, chunks, 50, metadata=["codes"]).select("rank", "chunk_id", F.round("score", 6).alias("score"))
