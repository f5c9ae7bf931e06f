"""Operational rollups, facts, graph and streams over the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import facts as fa
from corpusmill.operators import graph as gr
from corpusmill.operators import ops
from corpusmill.plans.registry import ORACLE_SQL, query, table
from corpusmill.streaming import jobs


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def wn2_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ops.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def flt5_page(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = ops.page(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 20)
    return rows.select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500")
def flt6_recent(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recent(table(spark, sf, "events"), ["ts", "event_id"], 1000, F.col("event_type") == "error").select("event_id", "user_id")


@query("SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') AND len(list_intersect(string_split(p_type, ' '), ['ECONOMY', 'PROMO'])) > 0")
def flt7_select_cases(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("tags"))
    return ops.select_cases(p, ["Brand#2", "Brand#17"], ["ECONOMY", "PROMO"]).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND epoch(TIMESTAMP '1998-08-02' - o_orderdate) > 86400 * 30")
def flt9_stale_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "processing").otherwise("done").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return ops.stale_tasks(t, F.lit("1998-08-02").cast("timestamp"), 86400 * 30).select("o_orderkey")


@query("SELECT event_id AS id, ts AS created_at, user_id, event_type AS action FROM events")
def flt10_project_for(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("action"), "value")
    return ops.project_for(e, "auditor")


@query("SELECT o_custkey, max(o_orderdate) AS last, count(*) AS documents, sum(o_orderkey % 7)::BIGINT AS chunks FROM orders GROUP BY 1")
def ag1_revision(spark: SparkSession, sf: str) -> DataFrame:
    return ops.revision(table(spark, sf, "orders").withColumn("n", F.col("o_orderkey") % 7), "o_custkey", "o_orderdate", "n")


@query("""SELECT count(*) FILTER (e) AS eligible, count(*) FILTER (h) AS hits, round(count(*) FILTER (h)::DOUBLE / count(*) FILTER (e), 6) AS hit_rate,
  round(greatest(0, 1 - avg(value) FILTER (h) / avg(value) FILTER (NOT h)), 6) AS speed_up, round(sum(h::INT)::DOUBLE / count(*), 6) AS call_reduction FROM (SELECT value, event_type <> 'error' AS e, event_type = 'view' AS h FROM events)""")
def ag4_cache_rollup(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("event_type") == "view"
    e = table(spark, sf, "events").select((F.col("event_type") != "error").alias("eligible"), hit.alias("hit"), F.col("value").alias("latency_ms"), hit.cast("int").alias("calls_avoided"), (~hit).cast("int").alias("calls_executed"))
    return ops.cache_rollup(e)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), k AS (SELECT * FROM l WHERE n <= 200),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM k),
  a AS (SELECT user_id AS tool, count(*) AS calls, avg((event_type = 'error')::INT) AS er, max(value) FILTER (i = least(c - 1, floor(c * 0.95))) AS p95, max(ts) FILTER (event_type <> 'error') AS last_success, coalesce(min(n) FILTER (event_type <> 'error'), count(*) + 1) - 1 AS failures_in_a_row FROM p GROUP BY 1)
  SELECT tool, calls, round(er, 6) AS error_rate, p95, last_success, failures_in_a_row, CASE WHEN failures_in_a_row >= 3 THEN 'open' WHEN er > 0.2 THEN 'degraded' ELSE 'healthy' END AS state FROM a""")
def ag5_tool_health(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").select(F.col("user_id").alias("tool"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return ops.tool_health(c).withColumn("error_rate", F.round("error_rate", 6))


@query("""WITH r AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'multi' ELSE 'simple' END AS e, CASE WHEN o_orderkey % 5 = 0 OR o_totalprice > 150000 THEN 'multi' ELSE 'simple' END AS a, o_orderkey % 5 = 0 AS x, o_orderstatus = 'F' AS p FROM orders)
  SELECT round(avg((e = a)::INT), 6) AS accuracy, round(count(*) FILTER (e = 'multi' AND a <> 'multi')::DOUBLE / count(*) FILTER (e = 'multi'), 6) AS under_routing, round(count(*) FILTER (e <> 'multi' AND a = 'multi')::DOUBLE / count(*) FILTER (e <> 'multi'), 6) AS over_routing,
  round(avg(x::INT), 6) AS escalation_rate, round(count(*) FILTER (x AND p)::DOUBLE / count(*) FILTER (x), 6) AS successful_escalation_rate FROM r""")
def ag7_routing_quality(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "multi").otherwise("simple").alias("expected_mode"), F.when(F.col("o_totalprice") > 150000, "multi").otherwise("simple").alias("actual_mode"),
        (F.col("o_orderkey") % 5 == 0).alias("escalated"), (F.col("o_orderstatus") == "F").alias("passed"),
    )
    return ops.routing_quality(o)


@query("""WITH v AS (SELECT user_id, floor(event_id / 3) AS m, CASE WHEN value > 10 THEN 'detailed' ELSE 'concise' END AS style, ts, row_number() OVER (PARTITION BY user_id, floor(event_id / 3) ORDER BY ts DESC, CASE WHEN value > 10 THEN 'detailed' ELSE 'concise' END DESC) AS n FROM events),
  a AS (SELECT user_id, count(*) FILTER (style = 'concise') AS concise, count(*) FILTER (style = 'detailed') AS detailed FROM v WHERE n = 1 GROUP BY 1)
  SELECT user_id, concise, detailed, CASE WHEN detailed > concise THEN 'detailed' ELSE 'concise' END AS preferred, round((greatest(concise, detailed) + 1) / (concise + detailed + 2)::DOUBLE, 6) AS strength FROM a""")
def ag13_preference_profile(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 3).alias("message_id"), F.when(F.col("value") > 10, "detailed").otherwise("concise").alias("style"), "ts")
    return ops.preference_profile(v)


@query("SELECT o_orderkey AS run_id, o_orderdate AS finished_at, coalesce(s, 0)::BIGINT AS value FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) LEFT JOIN (SELECT l_orderkey, count(*) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def ag17_trend(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "completed").alias("status"))
    metrics = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("lines"))
    return ops.trend(runs, metrics, "lines", 50).withColumn("value", F.col("value").cast("long"))


@query("SELECT l_orderkey AS run_id, string_agg(l_shipmode_, ',' ORDER BY l_linenumber, l_shipmode_) AS actions FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1")
def ag19_step_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_no"), F.col("l_returnflag").alias("action"))
    return ops.step_summary(s).select("run_id", F.array_join("actions", ",").alias("actions"))


@query("""SELECT 'customers' AS measure, count(*) AS value FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'messages', count(*) FROM conversations UNION ALL SELECT 'active_users', count(DISTINCT user_id) FROM events""")
def ag2_system_stats(spark: SparkSession, sf: str) -> DataFrame:
    counts = {"customers": table(spark, sf, "customer"), "documents": table(spark, sf, "documents"), "messages": table(spark, sf, "conversations")}
    return ops.system_stats(counts, table(spark, sf, "events"), "user_id")


@query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substr(arg_max(text, turn) FILTER (role = 'user'), 1, 200) AS topic FROM conversations GROUP BY 1")
def mm13_session_state(spark: SparkSession, sf: str) -> DataFrame:
    return fa.session_state(table(spark, sf, "conversations"))


@query("""SELECT conv_id, sha256(right(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn), 4000)) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10 GROUP BY 1""")
def mm14_conversation_tail(spark: SparkSession, sf: str) -> DataFrame:
    return fa.conversation_tail(table(spark, sf, "conversations")).select("conv_id", F.sha2("tail", 256).alias("tail"))


def changes_of(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of each user's fact `last type`."""
    return table(spark, sf, "events").select(
        F.lit(1).alias("tenant_id"), "user_id", F.lit("self").alias("subject"), F.lit("last_type").alias("predicate"), F.col("event_type").alias("value"),
        F.when(F.col("value") > 50, "web").otherwise("user_explicit").alias("source_type"), (F.col("value") / 100).alias("confidence"), F.lit(0.5).alias("importance"),
        F.lit("normal").alias("sensitivity"), F.lit("user").alias("source_role"), F.lit(True).alias("explicit"), F.lit(True).alias("confirmed"), "ts", "event_id",
    )


@query("SELECT event_id, CASE WHEN value / 100 < 0.6 THEN 'rejected:low_confidence' ELSE 'accept' END AS decision FROM events")
def mm1_decide_write(spark: SparkSession, sf: str) -> DataFrame:
    return fa.decide_write(changes_of(spark, sf)).select("event_id", "decision")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'low' ELSE 'high' END AS trust, concat('tenant:', 1, '/user:', user_id, '/memory_type:fact') AS namespace FROM events")
def mm3_trust_and_namespace(spark: SparkSession, sf: str) -> DataFrame:
    c = changes_of(spark, sf)
    return c.select("event_id", fa.trust(F.col("source_type")).alias("trust"), fa.namespace(F.col("tenant_id").cast("string"), F.col("user_id").cast("string"), F.lit("fact")).alias("namespace"))


@query("""WITH c AS (SELECT user_id, event_type AS value, ts, value / 100 AS confidence, (event_id % 10) / 10.0::DOUBLE AS importance, value <= 50 AS trusted, row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1 AS first FROM events),
  a AS (SELECT *, last_value(CASE WHEN trusted OR first THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active FROM c),
  d AS (SELECT *, NOT trusted AND NOT first AND value <> active AS disputed FROM a), n AS (SELECT *, sum((NOT disputed AND (first OR value <> active))::INT) OVER (PARTITION BY user_id ORDER BY ts) AS version FROM d),
  k AS (SELECT user_id, version, max(value) AS value, min(ts) AS valid_from, max(confidence) AS confidence, max(importance) AS importance, count(*) AS sources FROM n WHERE NOT disputed GROUP BY 1, 2),
  v AS (SELECT *, lead(valid_from) OVER (PARTITION BY user_id ORDER BY version) AS valid_to FROM k)
  SELECT user_id, version, value, valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'superseded' END AS status, sources, round(confidence, 6) AS confidence, importance FROM v
  UNION ALL SELECT user_id, version, value, ts, NULL, 'disputed', 1, round(confidence, 6), importance FROM n WHERE disputed""")
def mm2_merge_changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = changes_of(spark, sf).withColumn("importance", (F.col("event_id") % 10) / 10)
    return fa.merge_changes(changes).select("user_id", "version", "value", "valid_from", "valid_to", "status", "sources", F.round("confidence", 6).alias("confidence"), "importance")


@query("SELECT event_id AS fact_id, CASE WHEN ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-15' THEN 'expired' ELSE 'active' END AS status FROM events")
def mm7_expire(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("valid_to"), (F.col("ts") + F.expr("interval 5 days")).alias("expires_at"))
    return fa.expire(f, F.lit("2024-01-15").cast("timestamp")).select("fact_id", "status")


@query("SELECT event_id AS fact_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'active' END AS status, CASE WHEN event_type = 'error' THEN '[DELETED]' ELSE event_type END AS value FROM events")
def mm8_delete(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.lit("active").alias("status"), F.col("event_type").alias("value"))
    return fa.delete(f, f.filter("value = 'error'"))


@query("SELECT event_id AS fact_id, 'changed' AS change, 'active:error' AS old, 'deleted:[DELETED]' AS new FROM events WHERE event_type = 'error'")
def mm9_change_audit(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.lit("active").alias("status"), F.col("event_type").alias("value"), F.lit("normal").alias("sensitivity"))
    return fa.change_audit(f, fa.delete(f, f.filter("value = 'error'")))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '[PROTECTED]' ELSE c_name END AS value, CASE WHEN c_acctbal < 0 THEN c_name END AS opened FROM customer")
def mm10_protect(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("value"), F.when(F.col("c_acctbal") < 0, "sensitive").otherwise("normal").alias("sensitivity"))
    return fa.reveal(fa.protect(f, "0123456789abcdef", "00" * 16), "0123456789abcdef").select("c_custkey", "value", "opened")


@query("""WITH f AS (SELECT user_id, event_id, value / 100 AS importance, ts, list_distinct(list_concat(['user', 'did'], regexp_extract_all(lower(event_type), '[a-z0-9]+'))) AS ft, row_number() OVER (PARTITION BY user_id ORDER BY value / 100 DESC, ts DESC, event_id) AS n FROM events),
  s AS (SELECT *, len(list_intersect(ft, ['what', 'error', 'did', 'the', 'user', 'see'])) AS hits FROM f WHERE n <= 200),
  r AS (SELECT user_id AS query_id, event_id AS fact_id, round(least(1, 0.35::DOUBLE * hits / (6 + len(ft) - hits) + 0.25::DOUBLE * hits / 6 + 0.20::DOUBLE * importance + 0.10::DOUBLE * pow(0.5, (epoch(TIMESTAMP '2024-03-01') - floor(epoch(ts))) / 86400 / 30) + 0.10::DOUBLE * 0.9), 6) AS score FROM s),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM r) SELECT query_id, rank, fact_id, score FROM o WHERE rank <= 6""")
def mm5_retrieve_facts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    facts = e.select(F.lit(1).alias("tenant_id"), "user_id", F.lit("user").alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("value"), F.col("event_id").alias("fact_id"), (F.col("value") / 100).alias("importance"), F.lit(0.9).alias("confidence"), F.col("ts").alias("updated_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit("active").alias("status"))
    queries = e.select("user_id").distinct().select(F.col("user_id").alias("query_id"), F.lit(1).alias("tenant_id"), "user_id", F.lit("what error did the user see").alias("query"))
    return fa.retrieve(queries, facts, F.lit("2024-03-01").cast("timestamp"))


EDGES = """edges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    """Region, nation, supplier and customer as a graph."""
    join = lambda a, x, b, y, r: (F.concat(F.lit(a), x).alias("source"), F.lit(r).alias("relation"), F.concat(F.lit(b), y).alias("target"))
    e = table(spark, sf, "nation").select(*join("r", F.col("n_regionkey"), "n", F.col("n_nationkey"), "holds"))
    e = e.unionByName(table(spark, sf, "supplier").select(*join("n", F.col("s_nationkey"), "s", F.col("s_suppkey"), "supplies")))
    return e.unionByName(table(spark, sf, "customer").select(*join("n", F.col("c_nationkey"), "c", F.col("c_custkey"), "buys")))


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
  w AS (SELECT 'r0' AS id, 0 AS depth UNION SELECT b.b, w.depth + 1 FROM w JOIN b ON b.a = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1""")
def gr3_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "region").filter("r_regionkey = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return gr.bfs(edges_of(spark, sf), seeds, 3)


@query(f"WITH {EDGES} SELECT source, target FROM edges WHERE source IN ('n1', 'n2') OR target IN ('n1', 'n2')")
def jn11_incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "nation").filter("n_nationkey in (1, 2)").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return gr.incident_edges(edges_of(spark, sf), ids).select("source", "target")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1")
def gr2_find_vertices(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return gr.find_vertices(v, table(spark, sf, "nation").filter("n_regionkey = 1").select(F.concat(F.lit(" "), F.upper("n_name")).alias("name"))).select("id")


@query("SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation WHERE n_regionkey < 3")
def gr1_build_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose ends are both known: three regions and all nations are."""
    v = table(spark, sf, "region").filter("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey").alias("id")).unionByName(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    return gr.build_graph(v, edges_of(spark, sf))[1].select("source", "target")


def stream_of(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream; as a pattern the path may be a file or a folder."""
    path = os.path.join(sf, "events.parquet")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf, "events.parque[t]")).withColumn("ts", F.col("ts").cast("timestamp"))


def run_stream(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    base = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return jobs.run_available(stream, f"{base}/out", f"{base}/state")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) WHERE n = 1")
def st1_dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    return run_stream(spark, jobs.dedup_stream(stream_of(spark, sf), "event_id", "ts").select("event_id"), "st1")


@query("""WITH k AS (SELECT user_id AS key, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1), w AS (SELECT max(last_ms) - 600000 AS mark FROM k)
  SELECT key, last_ms, 'active' AS status FROM k UNION ALL SELECT key, last_ms, 'expired' FROM k, w WHERE last_ms + 3600000 < mark""")
def st2_expire_stream(spark: SparkSession, sf: str) -> DataFrame:
    return run_stream(spark, jobs.expire_stream(stream_of(spark, sf), "user_id", "ts"), "st2")


@query(ORACLE_SQL["mm2_merge_changes"])
def mm2_facts_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The versions of mm2_merge_changes, kept as state while the changes stream in."""
    e = stream_of(spark, sf)
    changes = e.select(
        F.lit(1).cast("long").alias("tenant_id"), F.col("user_id").cast("long").alias("user_id"), F.lit("self").alias("subject"), F.lit("last_type").alias("predicate"), F.col("event_type").alias("value"),
        F.when(F.col("value") > 50, "web").otherwise("user_explicit").alias("source_type"), (F.col("value") / 100).alias("confidence"), ((F.col("event_id") % 10) / 10).alias("importance"), "ts",
    )
    facts = jobs.current_facts(run_stream(spark, jobs.facts_stream(changes), "mm2"))
    return facts.select("user_id", "version", "value", "valid_from", "valid_to", "status", "sources", F.round("confidence", 6).alias("confidence"), "importance")


@query("""WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), g AS (SELECT date_trunc('day', ts) AS window_start, event_type AS tool, count(*) AS calls, avg((event_type = 'error')::INT) AS rate, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1, 2)
  SELECT window_start, tool, calls, round(rate, 6) AS error_rate, p95, CASE WHEN rate > 0.2 THEN 'degraded' ELSE 'healthy' END AS state FROM g, w WHERE window_start + INTERVAL 1 DAY <= mark""")
def st3_health_stream(spark: SparkSession, sf: str) -> DataFrame:
    s = stream_of(spark, sf).withColumn("failed", F.col("event_type") == "error")
    return jobs.window_health(run_stream(spark, jobs.health_stream(s, "event_type", "ts", "failed", "value", "1 day"), "st3"))


@query("""WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER u + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o)
  SELECT user_id AS session_key, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS messages FROM s, w GROUP BY user_id, session, mark HAVING max(ts) + INTERVAL 1 HOUR <= mark""")
def st4_session_stream(spark: SparkSession, sf: str) -> DataFrame:
    return run_stream(spark, jobs.session_stream(stream_of(spark, sf), "user_id", "ts", "1 hour"), "st4")
