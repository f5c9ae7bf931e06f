"""Rules over tables of requests, answers and runs: each adds columns, none acts on one row at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Patterns by signal. (?i) asks for any letter case.
PERSONAL = [
    r"(?i)(?:我|本人|患者|家人|孩子|父亲|母亲|孕妇).{0,16}(?:症状|诊断|检查|化验|用药|剂量|血压|血糖|体温|心率|疼痛|过敏|病史|怀孕|孕周)",
    r"(?i)\b\d{1,4}(?:\.\d+)?\s*(?:mmHg|mmol/L|mg/dL|mg|μg|kg|cm|℃|bpm)\b",
]
SIGNALS = {
    "connector": r"(?i)(?:并且|同时|分别|比较|对比|综合|权衡|以及|形成.+方案|and\s+then|compare|versus)",
    "rag": r"(?i)(?:指南|证据|文献|研究|知识库|出处|引用|共识|病历|最近.+次|guide|evidence|paper|source|record)",
    "private": r"(?i)(?:我的|患者|病历|检查结果|最近.+(?:血压|血糖|HbA1c)|既往|当前用药|my\s+(?:record|result)|patient)",
    "cross_domain": r"(?i)(?:药物.+(?:检验|影像|疾病|手术)|疾病.+(?:药物|检查|治疗)|用药.+指南|drug.+(?:lab|disease)|disease.+drug)",
    "constraint": r"(?i)(?:孕妇|妊娠|儿童|老人|老年|肾|肝|过敏|剂量|疗程|禁忌|相互作用|既往史|合并用药|监测|pregnan|child|renal|hepatic|dose|contraind)",
    "safety": r"(?i)(?:急救|急诊|胸痛|呼吸困难|昏迷|自杀|大量服用|出血|中毒|停药|换药|加量|减量|emergency|suicid|overdose)",
    "tool": r"(?i)(?:搜索|检索|查询|计算|知识图谱|网页|查表|数据库|病历|检查结果|search|lookup|calculate|graph|database)",
    "dependency": r"(?i)(?:先.+再|根据.+结合|依赖|基于.+结果|趋势.+建议|then|depends?\s+on|based\s+on)",
    "definition": r"(?i)^(?:请)?(?:简单)?(?:解释|介绍|说明)?\s*(?:一下)?[^，；;,.!?！？]{1,36}(?:是什么|的定义|什么意思|有哪些常见表现)?[？?。]?$",
}
#: The signals of a query, their weights, and what each is worth, from the patterns' counts.
SIGNAL_VALUES = [
    ("intent_count", 0.08, "least(1, (connector + int(cross_domain > 0)) / 3)"), ("subtask_count", 0.15, "least(1, (subtasks - 1) / 5)"), ("estimated_tool_count", 0.08, "least(1, tools / 3)"),
    ("tool_dependency", 0.13, "int(dependency > 0)"), ("requires_rag", 0.08, "int(rag > 0)"), ("requires_private_data", 0.08, "int(private > 0)"), ("cross_domain", 0.10, "int(cross_domain > 0)"),
    ("cross_agent_requirement", 0.13, "int(crossing)"), ("context_complexity", 0.04, "least(1, size / 500 + summary / 1200)"), ("constraint_count", 0.07, "least(1, constraint / 4)"),
    ("multi_turn_dependency", 0.03, "if(summary > 0, 0.75D, 0)"), ("safety_complexity", 0.10, "int(safety > 0)"),
]
INTENTS = [
    ("drug_information", r"(?i)药|用药|副作用|相互作用|drug|medication|dose|剂量|说明书"), ("literature_search", r"(?i)论文|文献|研究|指南|PMID|PubMed|meta[- ]?analysis"),
    ("symptom_consultation", r"(?i)疼|痛|发热|咳|吐|晕|乏力|症状|不舒服|symptom|ache|fever"), ("document_summary", r"(?i)这份|本文|文档|附件|总结|概括|document|attachment|summari"),
    ("medical_knowledge", r"(?i)病|医|治疗|检查|健康|症|血压|血糖|胆固醇|感染|肿瘤|营养|康复|disease|medical|health|clinical|blood pressure|glucose|cholesterol"),
]
TOOLS = {
    "general_knowledge": ["local_knowledge_base", "web_search"], "drug_information": ["local_knowledge_base", "fda_drug_label", "msd_manual"], "literature_search": ["pubmed", "local_knowledge_base"],
    "document_summary": ["local_knowledge_base", "get_document_evidence_context", "get_medical_table"], "medical_knowledge": ["local_knowledge_base", "msd_manual"], "symptom_consultation": ["local_knowledge_base"],
}
DURABLE = r"(?i)请记住|记住我的|以后(?:请|不要|别|都)|今后(?:请|不要|别|都)|我(?:更)?偏好|我更喜欢|please remember|from now on|i prefer"
PREFERENCES = [
    ("answer_language", r"(?i)中文|英文|汉语|英语|chinese|english"), ("answer_detail_level", r"(?i)简洁|精简|详细|展开|concise|brief|detailed"),
    ("answer_format", r"(?i)表格|分点|列表|markdown|table|bullet"), ("answer_tone", r"(?i)专业|通俗|语气|口吻|professional|plain language|tone"),
]
#: Limits of a reactive run.
LIMITS = {"steps": 7, "calls": 3, "unique": 2, "repeated": 1, "failures": 2, "tokens": 4000}


def first_match(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first rule that holds."""
    chain = F.when(rules[0][0], rules[0][1])
    for holds, label in rules[1:]:
        chain = chain.when(holds, label)
    return chain.otherwise(otherwise)


def cache_eligibility(requests: DataFrame, question: str = "question", longest: int = 300) -> DataFrame:
    """requests: profile, session_id, kb_ids array, question. Adds `reason`; standard_question is the eligible one."""
    q = F.coalesce(F.col(question), F.lit(""))
    rules = [
        (F.col("profile") != "general_qa", "memory_profile"), (F.col("session_id").isNotNull(), "multi_turn_session"), (F.coalesce(F.size("kb_ids"), F.lit(0)) <= 0, "no_knowledge_base"),
        (~F.length(q).between(2, longest), "question_length"), (reduce(lambda a, b: a | b, [q.rlike(p) for p in PERSONAL]), "personal_medical_context"),
    ]
    return requests.withColumn("reason", first_match(rules, "standard_question"))


def cacheable(results: DataFrame) -> DataFrame:
    """results: status, evidence_status, n_citations, safety_status, risk_level, blocked boolean, answer."""
    rules = [
        (~F.col("status").eqNullSafe("completed"), "not_completed"), (~F.col("evidence_status").eqNullSafe("sufficient") | (F.col("n_citations") <= 0), "insufficient_evidence"),
        (~F.col("safety_status").eqNullSafe("pass") | ~F.coalesce("risk_level", F.lit("low")).isin("low"), "safety_not_passed"), (F.col("blocked"), "non_reusable_state"),
        (F.trim(F.coalesce("answer", F.lit(""))) == "", "empty_answer"),
    ]
    return results.withColumn("reason", first_match(rules, "reusable"))


def cache_key(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("cache_key", F.sha2(F.to_json(F.struct(*sorted(fields))), 256))


def triage(df: DataFrame, risk: Column, col: str) -> DataFrame:
    """Intent by ordered patterns; an emergency goes before all."""
    q = F.coalesce(F.col(col), F.lit(""))
    rules = [(risk.isin("emergency", "self_harm"), "emergency_risk"), *[(q.rlike(p), name) for name, p in INTENTS]]
    return df.withColumn("intent", first_match(rules, "general_knowledge"))


def complexity(df: DataFrame, col: str, direct: float = 0.20, multi: float = 0.45, summary: str | None = None) -> DataFrame:
    """Adds signals (name to value), score, mode, level and confidence. summary: the column of a conversation's summary.

    The score is the weighted sum of the signals, kept within the bounds that plain definitions, requests for data and
    requests of several parts have.
    """
    bare = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f\u3000"))
    q = bare(F.col(col))
    clauses = F.size(F.filter(F.split(q, r"[，。；;,.!?！？\n]+"), lambda x: bare(x) != ""))
    counts = {k: F.regexp_count(q, F.lit(p)) for k, p in SIGNALS.items()}
    facts = counts | {"size": F.length(q), "clauses": clauses, "summary": F.length(bare(F.col(summary))) if summary else F.lit(0)}
    steps = [  # each step reads the ones before it
        {"subtasks": "greatest(1, clauses + connector)", "tools": "greatest(tool, int(rag > 0), int(private > 0))", "simple": "definition > 0 and rag + private + tool + dependency + safety = 0"},
        {"crossing": "dependency > 0 or (subtasks >= 4 and (cross_domain > 0 or constraint >= 2))"},
        {"values": "map(" + ", ".join(f"'{name}', double({value})" for name, _, value in SIGNAL_VALUES) + ")"},
        {"raw": "least(1D, " + " + ".join(f"{weight}D * values['{name}']" for name, weight, _ in SIGNAL_VALUES) + ")"},
        {"low": f"greatest(if(not simple and tools > 0, {direct + 0.02}D, 0D), if(crossing and (dependency > 0 or subtasks >= 4), {multi + 0.05}D, 0D))", "high": f"if(simple, {direct * 0.45}D, 1D)"},
        {"score": "round(greatest(least(raw, high), low), 4)"},
    ]
    out = df.select(F.struct(*df.columns).alias("_row"), *[c.alias(k) for k, c in facts.items()])
    for step in steps:
        out = out.select("*", *[F.expr(e).alias(k) for k, e in step.items()])
    s = F.col("score")
    below = [(direct / 2, "direct", "very_simple"), (direct, "direct", "simple"), ((direct + multi) / 2, "react", "simple"), (multi, "react", "medium"), (0.75, "multi_agent", "complex")]
    mode = first_match([(s < bound, m) for bound, m, _ in below[:4]], "multi_agent")
    level = first_match([(s < bound, x) for bound, _, x in below], "very_complex")
    near = F.least(F.abs(s - direct), F.abs(s - multi))
    sure = F.round(F.least(F.lit(0.99), 0.62 + near * 1.8 + F.when(F.col("simple") | F.col("crossing"), 0.12).otherwise(0.0)), 4)
    return out.select("_row.*", F.col("values").alias("signals"), "score", mode.alias("mode"), level.alias("level"), sure.alias("confidence"))


def escalation_reason(runs: DataFrame) -> DataFrame:
    """runs: conflict, failures, repeated, unique_tools, calls, remaining, steps, tokens, budget, risk_level."""
    rules = [
        (F.col("conflict"), "conflicting_rag_evidence"), (F.col("failures") >= LIMITS["failures"], "consecutive_tool_failures"), (F.col("repeated") > LIMITS["repeated"], "repeated_tool_loop"),
        (F.col("unique_tools") > LIMITS["unique"], "multiple_dependent_tools"), (F.col("calls") > LIMITS["calls"], "tool_call_budget_exceeded"), (F.col("remaining") >= 3, "new_independent_subtasks"),
        (F.col("steps") >= LIMITS["steps"], "react_step_budget_exceeded"), (F.col("tokens") >= 0.8 * F.least("budget", F.lit(LIMITS["tokens"])), "token_budget_pressure"),
        (F.col("risk_level").isin("high", "emergency") & (F.col("steps") > 2), "safety_complexity_increased"),
    ]
    return runs.withColumn("reason", first_match(rules, None))


def tool_candidates(requests: DataFrame, tools: DataFrame, most: int = 4) -> DataFrame:
    """(request_id, place, tool). requests: request_id, intent, agent, scopes, online, risk_level; tools: tool, category, agents, scopes, healthy, fallback."""
    by_intent = F.create_map(*[x for k, v in TOOLS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    wanted = requests.filter("risk_level <> 'emergency'").select("request_id", "agent", F.col("scopes").alias("have"), "online", F.posexplode(F.coalesce(by_intent[F.col("intent")], F.array(F.lit("local_knowledge_base")))).alias("pos", "tool"))
    j = wanted.join(tools, "tool")
    open_to = F.array_contains("agents", "*") | F.expr("array_contains(agents, agent)")
    j = j.filter((~F.col("category").isin("web_source", "medical_source") | F.col("online")) & open_to & (F.size(F.array_except("scopes", "have")) == 0))
    j = j.withColumn("tool", F.when(F.col("healthy"), F.col("tool")).otherwise(F.col("fallback"))).filter("tool is not null")
    j = j.groupBy("request_id", "tool").agg(F.min("pos").alias("pos"))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("pos", "tool"))).filter(F.col("place") <= most).drop("pos")


def replay_policy(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """The reason a logged call is refused, or `allowed`; compared with the logged decision. calls: call_id, tool, agent, have, online, risk_level, calls_left, calls_for_tool, tokens_left, logged_allowed."""
    j = calls.join(tools, "tool", "left")
    rules = [
        (F.col("category").isNull(), "unknown_tool"), (~F.col("healthy"), "health"), (~(F.array_contains("agents", "*") | F.expr("array_contains(agents, agent)")), "agent"), (F.size(F.array_except("scopes", "have")) > 0, "scope"),
        ((F.col("risk_level") == "emergency") & ~F.col("category").isin("safety", "workflow"), "emergency"), (F.col("category").isin("web_source", "medical_source") & ~F.col("online"), "offline"),
        ((F.col("calls_left") <= 0) | (F.col("calls_for_tool") >= F.col("max_calls")), "call_budget"), (F.col("tokens_left") <= 0, "token_budget"), (F.col("requires_approval"), "approval"),
    ]
    j = j.withColumn("reason", first_match(rules, "allowed"))
    return j.withColumn("agrees", (F.col("reason") == "allowed") == F.col("logged_allowed")).select("call_id", "reason", "agrees")


def preference_intent(messages: DataFrame, col: str) -> DataFrame:
    """The predicate of an explicit, durable preference, else null."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\s+", " "))
    return messages.withColumn("predicate", F.when(t.rlike(DURABLE), first_match([(t.rlike(p), k) for k, p in PREFERENCES], "general_preference")))


def has_term_group(text: Column, groups: Column) -> Column:
    """Per group of alternatives: is any contained, blanks and letter case aside?"""
    compact = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    return F.transform(groups, lambda g: F.exists(g, lambda a: F.contains(compact(text), compact(a))))


def match_rules(df: DataFrame, value: str, rule: str) -> Column:
    """A value against a rule struct (equals, one_of, min, max, contains); unset parts hold."""
    v, r = F.col(value), F.col(rule)
    number = F.expr(f"try_cast(`{value}` as double)")
    compact = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    parts = [
        r["equals"].isNull() | v.eqNullSafe(r["equals"]), r["one_of"].isNull() | F.coalesce(F.array_contains(r["one_of"], v), F.lit(False)), r["min"].isNull() | F.coalesce(number >= r["min"], F.lit(False)),
        r["max"].isNull() | F.coalesce(number <= r["max"], F.lit(False)), r["contains"].isNull() | F.coalesce(F.forall(r["contains"], lambda x: F.contains(compact(v), compact(x))), F.lit(False)),
    ]
    return reduce(lambda a, b: a & b, parts)


def rows_to_evidence(results: DataFrame, most: int = 10) -> DataFrame:
    """Search rows as evidence: http addresses, first of each, a score by place, a hashed id. results: query_id, pos, url, title, snippet."""
    ok = results.filter(F.col("url").rlike(r"(?i)^https?://") & (F.trim(F.concat_ws("", "title", "snippet")) != ""))
    first = ok.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("pos"))).filter("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    out = first.withColumn("place", place).filter(F.col("place") < most)
    return out.select("query_id", "place", "url", F.greatest(F.lit(0.35), 0.72 - 0.05 * F.col("place")).alias("score"), F.when(host.rlike(r"\.(gov|int)$"), 7).when(host.rlike(r"\.(edu|org)$"), 5).otherwise(4).alias("authority"), F.concat(F.lit("web_"), F.substring(F.sha2("url", 256), 1, 16)).alias("evidence_id"))


def content_scores(df: DataFrame) -> DataFrame:
    """functional, completion and quality of outputs against contents. df: output, status, required, forbidden, facts (arrays)."""
    low = F.lower(F.coalesce("output", F.lit("")))
    inside = lambda x: F.contains(low, F.lower(x))
    share = lambda c: F.when(F.size(c) > 0, F.size(F.filter(c, inside)) / F.size(c)).otherwise((low != "").cast("double"))
    ok, none = (F.col("status") == "success"), ~F.exists("forbidden", inside)
    checks = [ok, F.trim(low) != "", F.forall("required", inside), none]
    df = df.withColumn("functional", sum((c.cast("double") for c in checks), F.lit(0.0)) / 4)
    df = df.withColumn("completion", F.when(F.size("required") > 0, share("required")))
    parts = [share("facts"), share("required"), ((low != "") & ok).cast("double"), F.lit(1.0), none.cast("double"), F.length(low).between(1, 12000).cast("double")]
    return df.withColumn("quality", F.when(F.size("facts") + F.size("required") > 0, sum(parts, F.lit(0.0)) / 6))


def case_scores(df: DataFrame, latency: str, tools: str, steps: str, weights: dict[str, float]) -> DataFrame:
    """Overall: the weighted mean of the metrics that apply (not null), efficiency among them."""
    df = df.withColumn("efficiency", F.round(1 / (1 + F.col(latency) / 8000 + 0.1 * F.col(tools) + 0.05 * F.col(steps)), 6))
    has = {k: w for k, w in weights.items() if k in df.columns}
    top = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in has.items()), F.lit(0.0))
    low = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in has.items()), F.lit(0.0))
    return df.withColumn("overall", F.round(top / F.greatest(low, F.lit(1e-9)), 6))


def hallucination(runs: DataFrame) -> DataFrame:
    """runs: answer, forbidden (array), evidence_ids, citations (arrays), needs_citations. Adds the first reason, or null."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    rules = [
        (F.exists("forbidden", lambda x: F.contains(low, F.lower(x))), "forbidden_claim"), (F.size(F.array_except("citations", "evidence_ids")) > 0, "unknown_citation"),
        (F.col("needs_citations") & (F.trim(low) != "") & (F.size("citations") == 0), "uncited"),
    ]
    return runs.withColumn("hallucination", first_match(rules, None))


def completion(runs: DataFrame) -> DataFrame:
    """runs: status, allowed (array), answer, groups (array of arrays). Adds completion score and failed flag."""
    held = has_term_group(F.col("answer"), F.col("groups"))
    n = F.size("groups")
    ok = F.array_contains("allowed", F.col("status")) & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    share = F.when(n > 0, F.size(F.filter(held, lambda x: x)) / n).otherwise(1.0)
    return runs.withColumn("completion", F.when(ok, share).otherwise(0.0)).withColumn("incomplete", ~ok | (share < 1))
