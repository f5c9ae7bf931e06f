"""Evaluation over the driver's tables: dense rankings with labels as relevance; events and orders as case results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as ev
from corpusmill.plans.registry import query, table
from corpusmill.plans.retrieval_queries import DENSE, dense_of, vectors_of


def rankings_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, item) of the dense route, and (query_id, item, grade): vectors of the query's label, the query itself twice as good."""
    queries, chunks = vectors_of(spark, sf)
    rel = queries.join(chunks.select("chunk_id", "label"), F.col("q_label") == F.col("label")).select("query_id", F.col("chunk_id").alias("item"), F.when(F.col("query_id") == F.col("chunk_id"), 2).otherwise(1).alias("grade"))
    return dense_of(spark, sf).select("query_id", "rank", F.col("chunk_id").alias("item")), rel


def metric_sql(k: int, discount: str, gain: str, precision: str) -> str:
    div = "log2(rank + 1)" if discount == "standard" else "(CASE WHEN rank = 1 THEN 1.0 ELSE log2(rank) END)"
    value = {"linear": "grade", "exponential": "(pow(2, grade) - 1)", "binary": "(grade > 0)::INT"}[gain]
    p = f"hits / {k}.0::DOUBLE" if precision == "k" else "CASE WHEN returned > 0 THEN hits / returned::DOUBLE ELSE 0 END"
    return f"""WITH {DENSE}, rel AS (SELECT query_id, vec_id AS item, CASE WHEN query_id = vec_id THEN 2 ELSE 1 END AS grade FROM q JOIN embeddings ON label = q_label),
  g AS (SELECT d.query_id, d.rank, coalesce(r.grade, 0) AS grade FROM dense d LEFT JOIN rel r ON d.query_id = r.query_id AND d.chunk_id = r.item),
  u AS (SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM g),
  a AS (SELECT query_id, count(*) FILTER (rank <= {k} AND grade > 0) AS hits, count(*) FILTER (rank <= {k}) AS returned, sum({value} / {div}) FILTER (rank <= {k}) AS dcg,
    min(rank) FILTER (grade > 0) AS first, sum(upto / rank::DOUBLE) FILTER (rank <= {k} AND grade > 0) AS ps FROM u GROUP BY 1),
  i AS (SELECT query_id, count(*) AS n, sum({value} / {div}) FILTER (rank <= {k}) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rank FROM rel) GROUP BY 1),
  m AS (SELECT query_id, {p} AS p, hits / n::DOUBLE AS r, (hits > 0)::INT::DOUBLE AS hit, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(ps, 0) / least(n, {k}) AS ap, coalesce(dcg / ideal, 0) AS ndcg FROM i JOIN a USING (query_id))
  SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, hit, round(mrr, 6) AS mrr, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg FROM m"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "query_id"])


@query(metric_sql(10, "late", "linear", "k"))
def ev1_ranking_metrics_late(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.ranking_metrics(*rankings_of(spark, sf), 10, discount="late"))


@query(metric_sql(5, "standard", "linear", "k"))
def ev2_ranking_metrics_standard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.ranking_metrics(*rankings_of(spark, sf), 5))


@query(metric_sql(5, "standard", "binary", "returned"))
def ev3_ranking_metrics_captured(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.ranking_metrics(*rankings_of(spark, sf), 5, gain="binary", dedup=False, precision_by="returned"))


@query(metric_sql(3, "standard", "exponential", "k"))
def ev4_ranking_metrics_graded(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.ranking_metrics(*rankings_of(spark, sf), 3, gain="exponential"))


@query(f"WITH per AS ({metric_sql(5, 'standard', 'linear', 'k')}) SELECT count(*) AS queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM per")
def ev6_macro_average(spark: SparkSession, sf: str) -> DataFrame:
    m = ev.macro_average(ev.ranking_metrics(*rankings_of(spark, sf), 5))
    return m.select("queries", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(f"WITH a AS ({metric_sql(5, 'standard', 'linear', 'k')}), b AS ({metric_sql(3, 'standard', 'exponential', 'k')}), x AS (SELECT avg(mrr) AS m, avg(ndcg) AS n FROM a), y AS (SELECT avg(mrr) AS m, avg(ndcg) AS n FROM b) SELECT 'mrr' AS metric, round(y.m - x.m, 4) AS delta FROM x, y UNION ALL SELECT 'ndcg', round(y.n - x.n, 4) FROM x, y")
def ev5_compare_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = rankings_of(spark, sf)
    a, b = ev.macro_average(ev.ranking_metrics(*r, 5), 9), ev.macro_average(ev.ranking_metrics(*r, 3, gain="exponential"), 9)
    return ev.compare_metrics(a, b, ["mrr", "ndcg"]).select("metric", F.round("delta", 4).alias("delta"))


@query("""WITH x AS (SELECT quality AS t, (length(text) >= 1000)::INT AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT t AS label FROM x UNION SELECT DISTINCT p FROM x),
  a AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS called, (SELECT count(*) FROM x WHERE t = label AND p = label) AS hit FROM l)
  SELECT label, round(hit::DOUBLE / called, 6) AS precision, round(hit::DOUBLE / support, 6) AS recall, round(2.0 * hit / (called + support), 6) AS f1, support, round((SELECT avg((t = p)::INT) FROM x), 6) AS accuracy FROM a""")
def ag15_classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Length as a rule for quality."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("quality", (F.length("text") >= 1000).cast("int").alias("rule"))
    m = ev.classification_metrics(rows, "quality", "rule")
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT lang AS value, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def ag12_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ev.distribution(table(spark, sf, "documents"), "lang").select("value", F.round("share", 6).alias("share"))


@query("""WITH p AS (SELECT event_type AS v, count(*)::DOUBLE / (SELECT count(*) FROM events WHERE user_id % 2 = 0) AS p FROM events WHERE user_id % 2 = 0 GROUP BY 1),
  q AS (SELECT event_type AS v, count(*)::DOUBLE / (SELECT count(*) FROM events WHERE user_id % 2 = 1) AS q FROM events WHERE user_id % 2 = 1 GROUP BY 1),
  j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q USING (v))
  SELECT round(sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2), 6) AS js_divergence FROM j""")
def ev12_js_divergence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return ev.js_divergence(ev.distribution(e.filter("user_id % 2 = 0"), "event_type"), ev.distribution(e.filter("user_id % 2 = 1"), "event_type"))


@query("""SELECT round(0.45 * (SELECT count(DISTINCT lang) / 6.0::DOUBLE FROM documents) + 0.30 * (SELECT count(DISTINCT text)::DOUBLE / count(*) FROM documents) + 0.25, 6) AS health""")
def ev13_dataset_health(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg((F.count_distinct("lang") / 6).alias("coverage"), (1 - F.count_distinct(F.sha2("text", 256)) / F.count("*")).alias("duplicates"))
    return d.select(ev.dataset_health(F.col("coverage"), F.col("duplicates"), F.lit(0.0)).alias("health"))


@query("SELECT event_type, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def ag6_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ranks = ev.values_at_ranks(e, ["event_type"], "value", {f"p{int(p * 100)}": (p, ev.nearest_rank(p)) for p in (0.5, 0.95, 0.99)})
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean")).join(ranks, "event_type")


@query("""SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  WHERE i = least(n - 1, floor(n * 0.95))""")
def ag3_index_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return ev.index_percentile(table(spark, sf, "events"), ["event_type"], "value", 0.95)


@query("""SELECT event_type, 'value' AS metric, round(avg(value), 4) AS mean, count(*) AS applicable, count(*) FILTER (value = 1.0) AS perfect, 'VERIFIED' AS status FROM events GROUP BY 1""")
def ag9_metric_provenance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.create_map(F.lit("value"), "value").alias("scores"))
    return ev.aggregate_metrics(e, ["event_type"]).withColumn("mean", F.round("mean", 4))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(round(l_discount * 100)::BIGINT) / count(*) / 100, 6) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def ag11_category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("cents", F.round(F.col("l_discount") * 100).cast("long"))
    return ev.category_rollup(rows, ["l_returnflag", "l_linestatus"], "cents").withColumn("mean", F.round(F.col("mean") / 100, 6))


@query("""SELECT o_orderpriority AS variant, count(*) AS rows, round(avg(o_totalprice), 4) AS price, NULL::DOUBLE AS partial FROM orders GROUP BY 1""")
def ag10_variant_means(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("partial"))
    return ev.variant_means(o, ["price", "partial"]).withColumn("price", F.round("price", 4))


CASES = """a AS (SELECT o_orderkey AS k, o_totalprice > 100000 AS passed, o_orderpriority = '1-URGENT' AS critical, round(o_totalprice / 1e6, 6) AS s FROM orders),
  b AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) > 100000 AS passed, round(sum(l_extendedprice * (1 - l_discount)) / 1e6, 3) AS s FROM lineitem GROUP BY 1)"""


def case_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An order's total as the baseline's score, its net lines as the candidate's."""
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_key"), (F.col("o_totalprice") > 100000).alias("passed"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"), F.round(F.col("o_totalprice") / 1e6, 6).alias("overall_score"))
    net = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_key")).agg((net > 100000).alias("passed"), F.round(net / 1e6, 3).alias("overall_score")).withColumn("critical", F.lit(False))
    return a, b


@query(f"""WITH {CASES}, j AS (SELECT k AS case_key, a.critical, b.s - a.s AS d, CASE WHEN NOT a.passed AND b.passed THEN 'fixed' WHEN a.passed AND NOT b.passed THEN 'new_failure' WHEN b.s - a.s < -1e-9 THEN 'regressed' WHEN b.s - a.s > 1e-9 THEN 'improved' ELSE 'unchanged' END AS change FROM a JOIN b USING (k))
  SELECT case_key, change, round(round(d, 6), 3) + 0.0::DOUBLE AS delta, critical AND change IN ('new_failure', 'regressed') AS critical_regression FROM j""")
def ev28_compare_cases(spark: SparkSession, sf: str) -> DataFrame:
    return ev.compare_cases(*case_runs(spark, sf)).withColumn("delta", F.round("delta", 3) + 0.0)


@query("SELECT o_orderkey AS case_key, 'baseline' AS only_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION SELECT l_orderkey, 'candidate' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def jn4_unmatched_cases(spark: SparkSession, sf: str) -> DataFrame:
    a, b = case_runs(spark, sf)
    return ev.unmatched(a, b, "case_key")


@query("SELECT d.doc_id AS case_id, coalesce(CASE WHEN quality = 1 THEN 'ok' WHEN quality = 0 THEN 'poor' END, 'missing') AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn3_expected_with_captured(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    runs = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "poor").alias("status"), F.lit("").alias("answer"))
    return ev.expected_with_captured(cases, runs).select("case_id", "status")


@query("""WITH m AS (SELECT avg((event_type <> 'error')::INT) AS ok, avg((event_type = 'error')::INT) AS bad FROM events)
  SELECT 'overall_pass_rate' AS metric, round(ok, 6) AS value, ok >= 0.85 AS passed FROM m UNION ALL SELECT 'error_rate', round(bad, 6), bad <= 0.02 FROM m""")
def ev29_release_gate(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.avg((F.col("event_type") == "error").cast("double"))
    m = table(spark, sf, "events").agg((1 - bad).alias("ok"), bad.alias("bad")).select(F.explode(F.create_map(F.lit("overall_pass_rate"), "ok", F.lit("error_rate"), "bad")).alias("metric", "value"))
    return ev.release_gate(m).filter(F.col("metric").isin("overall_pass_rate", "error_rate")).select("metric", F.round("value", 6).alias("value"), "passed")


STEPS = "w AS (SELECT user_id AS run_id, event_id, event_type AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)"


@query(f"""WITH {STEPS} SELECT run_id, count(*) AS steps, count(*) FILTER (a = p) AS loops, count(*) - count(DISTINCT a) AS repeats, round(1.0::DOUBLE / (1 + count(*) FILTER (a = p) + count(*) - count(DISTINCT a)), 6) AS efficiency FROM w GROUP BY 1""")
def ev19_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_no"), F.col("event_type").alias("action"))
    return ev.loops(s).withColumn("efficiency", F.round("efficiency", 6))


@query(f"WITH {STEPS} SELECT run_id, count(*) FILTER (a = p) AS loops FROM w GROUP BY 1")
def wn12_loop_count(spark: SparkSession, sf: str) -> DataFrame:
    return ev19_trajectory(spark, sf).select("run_id", "loops")


@query("""SELECT user_id AS case_id, greatest(0, 1 - 0.25 * count(*) FILTER (event_type = 'error'))::DOUBLE * (CASE WHEN count(*) FILTER (event_type = 'error' AND value > 99) > 0 THEN 0 ELSE 1 END) AS score FROM events GROUP BY 1""")
def ev20_safety_scores(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.count_if(bad).alias("violations"), F.count_if(bad & (F.col("value") > 99)).alias("critical_violations"))
    return ev.safety_scores(runs).select("case_id", "score")


@query("""WITH c AS (SELECT user_id AS case_id, list(DISTINCT event_type) AS used, count(*) AS n, avg((event_type <> 'error')::INT) AS ok, count(DISTINCT (event_type, floor(value))) AS diff FROM events GROUP BY 1),
  r AS (SELECT *, len(list_filter(used, lambda x: x IN ('click', 'view')))::DOUBLE AS hit FROM c)
  SELECT case_id, (len(used) = 2 AND hit = 2)::INT::DOUBLE AS exact, round(hit / len(used), 6) AS precision, round(hit / 2, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / len(used)) * (hit / 2) / (hit / len(used) + hit / 2) ELSE 0 END, 6) AS f1, round(ok, 6) AS success_rate, round(1 - diff::DOUBLE / n, 6) AS redundant_rate FROM r""")
def ev16_tool_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Users as cases that should click and view; a call's argument is its value's whole part."""
    e = table(spark, sf, "events")
    calls = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("tool"), F.floor("value").alias("arguments"), (F.col("event_type") != "error").alias("success"))
    expected = e.select(F.col("user_id").alias("case_id")).distinct().withColumn("tools", F.array(F.lit("click"), F.lit("view")))
    s = ev.tool_scores(calls, expected)
    return s.select("case_id", *[F.round(c, 6).alias(c) for c in s.columns if c != "case_id"])


@query("""WITH f AS (SELECT user_id AS case_id, count(*) FILTER (event_type = 'error') > 2 AS t, min(value) < 1 AS r, max(value) > 99 AS h, count(*) < 3 AS i FROM events GROUP BY 1)
  SELECT case_id, CASE WHEN t THEN 'tool' WHEN r THEN 'retrieval' WHEN h THEN 'hallucination' WHEN i THEN 'incomplete' END AS failure FROM f""")
def ev25_attribute_failures(spark: SparkSession, sf: str) -> DataFrame:
    return ev.attribute_failures(flags_of(spark, sf)).select("case_id", "failure")


def flags_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("case_id")).agg(
        (F.count_if(F.col("event_type") == "error") > 2).alias("tool_failed"), (F.min("value") < 1).alias("retrieval_failed"), (F.max("value") > 99).alias("hallucinated"), (F.count("*") < 3).alias("incomplete"), F.avg((F.col("event_type") != "error").cast("double")).alias("tool_score"),
    )


@query("""WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error') > 2 AS t, min(value) < 1 AS r, max(value) > 99 AS h, count(*) < 3 AS i, avg((event_type <> 'error')::INT) AS ts FROM events GROUP BY 1),
  g AS (SELECT *, CASE WHEN t THEN 'tool' WHEN r THEN 'retrieval' WHEN h THEN 'hallucination' WHEN i THEN 'incomplete' END AS failure FROM f)
  SELECT count(*) AS cases, round(avg(ts), 6) AS tool_score, round(0.30 * avg(ts) + 0.70, 6) AS overall, round(avg((failure IS NULL)::INT), 6) AS strict_pass, count(*) FILTER (failure = 'tool') AS n_tool, count(*) FILTER (failure = 'retrieval') AS n_retrieval FROM g""")
def ev26_run_report(spark: SparkSession, sf: str) -> DataFrame:
    cases = ev.attribute_failures(flags_of(spark, sf)).withColumns({c: F.lit(None).cast("double") for c in ("retrieval_score", "grounding_score", "completion_score")})
    return ev.run_report(cases).select("cases", "tool_score", "overall", "strict_pass", "n_tool", "n_retrieval")


@query("""WITH s AS (SELECT user_id AS case_id, string_agg(event_type, ',' ORDER BY event_id) AS steps, list_distinct(list(event_type)) AS kinds FROM events GROUP BY 1)
  SELECT case_id, CASE WHEN steps = 'view,click' THEN 1.0 WHEN regexp_matches(steps, 'view,(.*,)?click') THEN 0.8 ELSE len(list_intersect(kinds, ['view', 'click'])) / 2.0 END::DOUBLE AS score FROM s""")
def ev17_routing_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's sequence of event types against view, then click."""
    steps = table(spark, sf, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("actual"))
    return ev.routing_scores(steps.withColumn("expected", F.array(F.lit("view"), F.lit("click")))).select("case_id", F.round("score", 6).alias("score"))


@query()
def ev7_longest_common_share(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring benchmark items."""
    a = table(spark, sf, "benchmark")
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(ev.longest_common_share(F.col("text"), F.col("other")), 6).alias("share"))


@query("SELECT event_id, true AS same FROM events")
def tx23_compare_arguments(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", ev.arguments_match(p, p, F.lit("exact"), F.lit("ts"), F.lit(0.01)).alias("same"))
