"""Rules over requests and runs: conversation messages, orders and events in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import requests as rq
from corpusmill.functions import text as tx
from corpusmill.operators import evaluation as ev
from corpusmill.operators import ops
from corpusmill.plans.registry import query, table


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


PERSONAL = " OR ".join(f"regexp_matches(text, '{p[4:]}', 'i')" for p in rq.PERSONAL)


@query(f"""SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'memory_profile' WHEN turn > 1 THEN 'multi_turn_session' WHEN conv_id % 7 = 0 THEN 'no_knowledge_base'
  WHEN length(text) NOT BETWEEN 2 AND 300 THEN 'question_length' WHEN {PERSONAL} THEN 'personal_medical_context' ELSE 'standard_question' END AS reason FROM conversations""")
def tx8_cache_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select("conv_id", "turn", F.when(F.col("role") == "user", "general_qa").otherwise("other").alias("profile"), F.when(F.col("turn") > 1, F.col("conv_id")).alias("session_id"), F.when(F.col("conv_id") % 7 != 0, F.array("conv_id")).alias("kb_ids"), F.col("text").alias("question"))
    return rq.cache_eligibility(m).select("conv_id", "turn", "reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'not_completed' WHEN o_totalprice < 50000 OR o_orderkey % 4 = 0 THEN 'insufficient_evidence' WHEN o_orderpriority = '1-URGENT' THEN 'safety_not_passed' WHEN o_orderkey % 11 = 0 THEN 'non_reusable_state' ELSE 'reusable' END AS reason FROM orders""")
def tx9_cacheable(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").alias("status"), F.when(F.col("o_totalprice") >= 50000, "sufficient").alias("evidence_status"), (F.col("o_orderkey") % 4).alias("n_citations"), F.lit("pass").alias("safety_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high").alias("risk_level"), (F.col("o_orderkey") % 11 == 0).alias("blocked"), F.lit("a").alias("answer"),
    )
    return rq.cacheable(o).select("o_orderkey", "reason")


@query("""SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '"}') AS cache_key FROM conversations""")
def tx10_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return rq.cache_key(messages(spark, sf), ["role", "conv_id"]).select("conv_id", "turn", "cache_key")


RISK = "(" + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for p in tx.SELF_HARM + tx.EMERGENCY) + ")"
INTENT = f"CASE WHEN {RISK} THEN 'emergency_risk' " + " ".join(f"WHEN regexp_matches(text, '{p[4:]}', 'i') THEN '{k}'" for k, p in rq.INTENTS) + " ELSE 'general_knowledge' END"


@query(f"SELECT conv_id, turn, {INTENT} AS intent FROM conversations")
def tx11_triage(spark: SparkSession, sf: str) -> DataFrame:
    return rq.triage(messages(spark, sf), tx.risk_level(F.col("text")), "text").select("conv_id", "turn", "intent")


COUNTS = ", ".join(f"len(regexp_extract_all(q, '{p[4:]}', 0, 'i')) AS {k}" for k, p in rq.SIGNALS.items())


@query(f"""WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || '　') AS q FROM conversations),
  n AS (SELECT *, {COUNTS}, len(list_filter(regexp_split_to_array(q, '[，。；;,.!?！？\\n]+'), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS clauses FROM t),
  f AS (SELECT *, greatest(1, clauses + connector) AS subtasks, greatest(tool, (rag > 0)::INT, (private > 0)::INT) AS tools, definition > 0 AND NOT (rag > 0 OR private > 0 OR tool > 0 OR dependency > 0 OR safety > 0) AS simple FROM n),
  x AS (SELECT *, dependency > 0 OR (subtasks >= 4 AND (cross_domain > 0 OR "constraint" >= 2)) AS crossing FROM f),
  r AS (SELECT *, least(1, 0.08::DOUBLE * least(1, (connector + (cross_domain > 0)::INT) / 3) + 0.15::DOUBLE * least(1, (subtasks - 1) / 5) + 0.08::DOUBLE * least(1, tools / 3) + 0.13::DOUBLE * (dependency > 0)::INT + 0.08::DOUBLE * (rag > 0)::INT
    + 0.08::DOUBLE * (private > 0)::INT + 0.10::DOUBLE * (cross_domain > 0)::INT + 0.13::DOUBLE * crossing::INT + 0.04::DOUBLE * least(1, length(q) / 500) + 0.07::DOUBLE * least(1, "constraint" / 4) + 0.10::DOUBLE * (safety > 0)::INT) AS raw FROM x),
  b AS (SELECT *, CASE WHEN simple THEN least(raw, 0.09) WHEN tools > 0 THEN greatest(raw, 0.22) ELSE raw END AS bound FROM r),
  s AS (SELECT *, round(CASE WHEN crossing AND (dependency > 0 OR subtasks >= 4) THEN greatest(bound, 0.5) ELSE bound END, 4) AS score FROM b)
  SELECT conv_id, turn, score, CASE WHEN score < 0.2 THEN 'direct' WHEN score < 0.45 THEN 'react' ELSE 'multi_agent' END AS mode,
    CASE WHEN score < 0.1 THEN 'very_simple' WHEN score < 0.325 THEN 'simple' WHEN score < 0.45 THEN 'medium' WHEN score < 0.75 THEN 'complex' ELSE 'very_complex' END AS level,
    round(least(0.99, 0.62 + 1.8 * least(abs(score - 0.2), abs(score - 0.45)) + CASE WHEN simple OR crossing THEN 0.12 ELSE 0 END), 4) AS confidence FROM s""")
def tx14_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return rq.complexity(messages(spark, sf), "text").select("conv_id", "turn", "score", "mode", "level", "confidence")


@query("""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS f, count(*) - count(DISTINCT event_type) AS rep, count(DISTINCT event_type) AS uq, count(*) AS n, sum(value) AS tok FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN f >= 2 THEN 'consecutive_tool_failures' WHEN rep > 1 THEN 'repeated_tool_loop' WHEN uq > 2 THEN 'multiple_dependent_tools' WHEN n > 3 THEN 'tool_call_budget_exceeded' WHEN n >= 7 THEN 'react_step_budget_exceeded' WHEN tok >= 3200 THEN 'token_budget_pressure' END AS reason FROM r""")
def tx15_escalation_reason(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count("*").alias("calls"), F.count_distinct("event_type").alias("unique_tools"), F.sum("value").alias("tokens"))
    r = r.withColumns({"repeated": F.col("calls") - F.col("unique_tools"), "steps": F.col("calls"), "conflict": F.lit(False), "remaining": F.lit(0), "budget": F.lit(4000), "risk_level": F.lit("low")})
    return rq.escalation_reason(r).select("user_id", "reason")


def tools_of(spark: SparkSession) -> DataFrame:
    names = sorted({t for ts in rq.TOOLS.values() for t in ts})
    web = {"web_search": "web_source", "pubmed": "medical_source", "msd_manual": "medical_source", "fda_drug_label": "medical_source"}
    return spark.createDataFrame([(n, web.get(n, "local"), ["*"], ["read"] if n in web else [], n != "pubmed", "local_knowledge_base", 2, False) for n in names], "tool string, category string, agents array<string>, scopes array<string>, healthy boolean, fallback string, max_calls int, requires_approval boolean")


WANTED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rq.TOOLS.items())


@query(f"""WITH r AS (SELECT conv_id * 1000 + turn AS request_id, turn % 2 = 0 AS may_read, conv_id % 2 = 0 AS online, {INTENT} AS intent FROM conversations),
  w AS (SELECT *, CASE intent {WANTED} ELSE ['local_knowledge_base'] END AS tools FROM r), t AS (SELECT *, unnest(tools) AS tool, generate_subscripts(tools, 1) AS pos FROM w),
  f AS (SELECT request_id, CASE WHEN tool = 'pubmed' THEN 'local_knowledge_base' ELSE tool END AS tool, min(pos) AS pos FROM t WHERE tool NOT IN ('web_search', 'pubmed', 'msd_manual', 'fda_drug_label') OR (online AND may_read) GROUP BY 1, 2),
  p AS (SELECT request_id, tool, row_number() OVER (PARTITION BY request_id ORDER BY pos, tool) AS place FROM f) SELECT request_id, place, tool FROM p WHERE place <= 4""")
def tx16_tool_candidates(spark: SparkSession, sf: str) -> DataFrame:
    m = rq.triage(messages(spark, sf), tx.risk_level(F.col("text")), "text")
    r = m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "intent", F.col("role").alias("agent"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("read"))).otherwise(F.array().cast("array<string>")).alias("scopes"), (F.col("conv_id") % 2 == 0).alias("online"), F.lit("low").alias("risk_level"))
    return rq.tool_candidates(r, tools_of(spark)).select("request_id", "place", "tool")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown_tool' WHEN user_id % 2 = 0 AND event_type = 'view' THEN 'offline' WHEN value > 100 THEN 'token_budget' ELSE 'allowed' END AS reason FROM events""")
def tx17_replay_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logged calls: errors of a tool nobody knows, views of the web."""
    tool = F.when(F.col("event_type") == "view", "web_search").when(F.col("event_type") == "error", "none").otherwise("local_knowledge_base")
    c = table(spark, sf, "events").select(F.col("event_id").alias("call_id"), tool.alias("tool"), F.lit("a").alias("agent"), F.array(F.lit("read")).alias("have"), (F.col("user_id") % 2 == 1).alias("online"), F.lit("low").alias("risk_level"), F.lit(3).alias("calls_left"), F.lit(0).alias("calls_for_tool"), F.when(F.col("value") > 100, 0).otherwise(10).alias("tokens_left"), F.lit(True).alias("logged_allowed"))
    return rq.replay_policy(c, tools_of(spark)).select(F.col("call_id").alias("event_id"), "reason")


PREF = f"CASE WHEN regexp_matches(text, '{rq.DURABLE[4:]}', 'i') THEN CASE " + " ".join(f"WHEN regexp_matches(text, '{p[4:]}', 'i') THEN '{k}'" for k, p in rq.PREFERENCES) + " ELSE 'general_preference' END END"


@query(f"SELECT conv_id, turn, {PREF} AS predicate FROM conversations")
def tx19_preference_intent(spark: SparkSession, sf: str) -> DataFrame:
    return rq.preference_intent(messages(spark, sf), "text").select("conv_id", "turn", "predicate")


@query(r"""SELECT doc_id, contains(regexp_replace(lower(text), '\s+', '', 'g'), 'ofthe') OR contains(regexp_replace(lower(text), '\s+', '', 'g'), 'dela') AS first, contains(regexp_replace(lower(text), '\s+', '', 'g'), 'license') AS second FROM documents""")
def tx24_has_term_group(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.array(F.lit("of the"), F.lit("de la")), F.array(F.lit("License")))
    return table(spark, sf, "documents").withColumn("g", rq.has_term_group(F.col("text"), groups)).select("doc_id", F.get("g", F.lit(0)).alias("first"), F.get("g", F.lit(1)).alias("second"))


@query("SELECT event_id, value BETWEEN 10 AND 50 AND event_type IN ('click', 'view') AS ok FROM events")
def tx22_match_rules(spark: SparkSession, sf: str) -> DataFrame:
    rule = "struct<equals:string,one_of:array<string>,min:double,max:double,contains:array<string>>"
    e = table(spark, sf, "events").withColumn("v", F.col("value").cast("string")).withColumn("r", F.from_json(F.lit('{"min": 10, "max": 50}'), rule)).withColumn("q", F.from_json(F.lit('{"one_of": ["click", "view"]}'), rule))
    return e.select("event_id", (rq.match_rules(e, "v", "r") & rq.match_rules(e, "event_type", "q")).alias("ok"))


@query("""WITH f AS (SELECT page_id % 10 AS query_id, page_id AS pos, url, row_number() OVER (PARTITION BY page_id % 10, url ORDER BY page_id) AS n FROM pages WHERE regexp_matches(url, '^https?://', 'i')),
  p AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS place FROM f WHERE n = 1)
  SELECT query_id, place, round(greatest(0.35, 0.72 - 0.05 * place), 6) AS score, 'web_' || substr(sha256(url), 1, 16) AS evidence_id FROM p WHERE place < 10""")
def tx26_rows_to_evidence(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "pages").select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("pos"), "url", F.lit("t").alias("title"), F.lit("").alias("snippet"))
    return rq.rows_to_evidence(r).select("query_id", "place", F.round("score", 6).alias("score"), "evidence_id")


@query("""WITH x AS (SELECT doc_id, lower(text) AS t FROM documents)
  SELECT doc_id, ((1 + (trim(t) <> '')::INT + contains(t, 'the')::INT + (NOT contains(t, 'license'))::INT) / 4.0)::DOUBLE AS functional, contains(t, 'the')::INT::DOUBLE AS completion FROM x""")
def ev15_content_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("output"), F.lit("success").alias("status"), F.array(F.lit("The")).alias("required"), F.array(F.lit("license")).alias("forbidden"), F.array(F.lit("of"), F.lit("de")).alias("facts"))
    return rq.content_scores(d).select("doc_id", "functional", "completion")


@query("""SELECT o_orderkey, round(1 / (1 + o_totalprice / 8000 + 0.1 * (o_orderkey % 5) + 0.05 * (o_orderkey % 7)), 6) AS efficiency, round((0.15 * (o_orderkey % 2) + 0.10 * round(1 / (1 + o_totalprice / 8000 + 0.1 * (o_orderkey % 5) + 0.05 * (o_orderkey % 7)), 6)) / 0.25, 6) AS overall FROM orders""")
def ev21_case_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 5).alias("tools"), (F.col("o_orderkey") % 7).alias("steps"), (F.col("o_orderkey") % 2).cast("double").alias("tool"))
    weights = {"task_completion": 0.20, "answer_quality": 0.15, "rag": 0.15, "tool": 0.15, "routing": 0.05, "execution_mode": 0.10, "trajectory": 0.10, "efficiency": 0.10}
    return rq.case_scores(o, "o_totalprice", "tools", "steps", weights).select("o_orderkey", "efficiency", "overall")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'forbidden_claim' WHEN doc_id % 5 = 0 THEN 'unknown_citation' WHEN doc_id % 5 = 1 AND trim(text) <> '' THEN 'uncited' END AS hallucination FROM documents""")
def ev23_hallucination(spark: SparkSession, sf: str) -> DataFrame:
    cites = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("x"))).when(F.col("doc_id") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"), F.array(F.lit("License")).alias("forbidden"), F.array(F.lit("e")).alias("evidence_ids"), cites.alias("citations"), F.lit(True).alias("needs_citations"))
    return rq.hallucination(d).select("doc_id", "hallucination")


@query(r"""SELECT doc_id, CASE WHEN lang = 'en' AND trim(text) <> '' THEN (contains(regexp_replace(lower(text), '\s+', '', 'g'), 'the')::INT + contains(regexp_replace(lower(text), '\s+', '', 'g'), 'license')::INT) / 2.0::DOUBLE ELSE 0 END AS completion FROM documents""")
def ev24_completion(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"), F.when(F.col("lang") == "en", "completed").otherwise("failed").alias("status"), F.array(F.lit("completed")).alias("allowed"), F.array(F.array(F.lit("the")), F.array(F.lit("license"))).alias("groups"))
    return rq.completion(d).select("doc_id", "completion")


@query("SELECT r.l_orderkey AS case_id, r.l_linenumber AS line, o.o_orderpriority AS category FROM lineitem r JOIN orders o ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def jn1_case_results_with_case(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"))
    return ev.results_with_cases(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line")), cases)


@query("SELECT o_orderpriority AS mode, count(*) AS results, round(avg(n), 6) AS mean_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def jn13_results_with_trace(spark: SparkSession, sf: str) -> DataFrame:
    traces = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trace_id")).agg(F.count("*").alias("n"))
    j = ev.results_with_traces(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "trace_id"), traces)
    return ev.mode_profile(j, "o_orderpriority", "n").select("mode", "results", F.round("mean", 6).alias("mean_lines"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn10_visible(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ev.visible(table(spark, sf, "orders"), seen, "o_custkey").select("o_orderkey")


@query("""SELECT o_orderpriority AS mode, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS usage, round(avg(o_totalprice), 4) AS mean_cost FROM orders GROUP BY 1""")
def ag8_mode_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ev.mode_profile(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("mode", F.round("usage", 6).alias("usage"), F.round("mean", 4).alias("mean_cost"))


@query("""SELECT d.doc_id, CASE WHEN lang = 'en' THEN 100 WHEN lang = 'fr' THEN least(99, greatest(0, coalesce(p, 0))) WHEN p IS NOT NULL THEN p WHEN lang = 'de' THEN 65 ELSE 0 END AS shown
  FROM documents d LEFT JOIN (SELECT doc_id, quality * 150 AS p FROM labels) USING (doc_id)""")
def ag20_doc_progress(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("lang") == "en", "completed").when(F.col("lang") == "fr", "failed").when(F.col("lang") == "de", "processing").otherwise("pending")
    docs = table(spark, sf, "documents").select("doc_id", state.alias("vector_status"), F.lit("pending").alias("parse_status"))
    return ops.doc_progress(docs, table(spark, sf, "labels").select("doc_id", (F.col("quality") * 150).alias("progress"))).select("doc_id", "shown")
