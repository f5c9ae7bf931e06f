"""Filters, listings and rollups over operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page(df: DataFrame, filters: Column | None, order: list[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and the total."""
    kept = df.filter(filters) if filters is not None else df
    return kept.orderBy(*order).offset((number - 1) * size).limit(size), kept.agg(F.count("*").alias("total"))


def recent(df: DataFrame, order: list[str], limit: int, only: Column | None = None) -> DataFrame:
    kept = df.filter(only) if only is not None else df
    return kept.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, min(500, limit)))


def select_cases(cases: DataFrame, categories: list[str] | None, tags: list[str] | None, fast: bool = False) -> DataFrame:
    if categories:
        cases = cases.filter(F.col("category").isin(categories))
    if tags:
        cases = cases.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return cases.orderBy("id").limit(10) if fast else cases


def pending_documents(docs: DataFrame) -> DataFrame:
    kinds = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin("pdf", "docx", "txt", "md", "html")
    again = (F.col("vector_status") == "failed") & F.col("error").isin("worker lost", "service restarted")
    return docs.filter(F.col("parse_status").isin("pending", "processing", "completed") & F.col("path").isNotNull() & kinds & (F.col("vector_status").isin("pending", "processing") | again))


def stale_tasks(tasks: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows in processing that have not moved for the limit, 60 s at least."""
    return tasks.filter((F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > max(ttl_seconds, 60)))


#: Columns that a role may see.
COMMON_COLUMNS = ["id", "query", "created_at"]
ROLE_COLUMNS = {"auditor": [*COMMON_COLUMNS, "user_id", "action"], "operator": [*COMMON_COLUMNS, "latency_ms", "status"]}


def project_for(df: DataFrame, role: str, columns: dict[str, list[str]] = ROLE_COLUMNS, common: list[str] = COMMON_COLUMNS) -> DataFrame:
    return df.select(*[c for c in columns.get(role, common) if c in df.columns])


def find_tables(tables: DataFrame, doc_id: int, term: str | None = None, most: int = 20) -> DataFrame:
    """The first tables by page, and of these the ones with the term."""
    first = tables.filter(F.col("doc_id") == doc_id).orderBy("page_start", "table_id").limit(most)
    return first if term is None else first.filter(F.lower(F.concat_ws(" ", "title", "markdown")).contains(term.lower()))


def rebuild_candidates(docs: DataFrame, tasks: DataFrame, kb_id: int) -> DataFrame:
    """(scheduled, skipped): documents to rebuild, and those with an active task."""
    active = tasks.filter(F.col("status").isin("pending", "processing")).select(F.col("doc_id").alias("_d")).distinct()
    wanted = docs.filter((F.col("kb_id") == kb_id) & F.col("path").isNotNull())
    j = wanted.join(active, F.col("doc_id") == F.col("_d"), "left")
    return j.agg(F.count_if(F.col("_d").isNull()).alias("scheduled"), F.count_if(F.col("_d").isNotNull()).alias("skipped"))


def revision(docs: DataFrame, group: str, updated: str, chunks: str) -> DataFrame:
    """(group, last, documents, chunks): what a cached answer over a collection depends on."""
    return docs.groupBy(group).agg(F.max(updated).alias("last"), F.count("*").alias("documents"), F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks"))


def cache_rollup(events: DataFrame) -> DataFrame:
    """events: (eligible, hit boolean, latency_ms, calls_avoided, calls_executed)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = events.agg(
        F.count_if("eligible").alias("eligible"), F.count_if("hit").alias("hits"), F.avg(F.when(~F.col("hit"), F.col("latency_ms"))).alias("cold"), F.avg(F.when(F.col("hit"), F.col("latency_ms"))).alias("warm"),
        F.sum("calls_avoided").alias("avoided"), F.sum("calls_executed").alias("executed"),
    )
    return agg.select(
        "eligible", "hits", F.round(zero(F.try_divide("hits", "eligible")), 6).alias("hit_rate"), F.round(F.greatest(F.lit(0.0), zero(1 - F.try_divide("warm", "cold"))), 6).alias("speed_up"),
        F.round(zero(F.try_divide("avoided", F.col("avoided") + F.col("executed"))), 6).alias("call_reduction"),
    )


def tool_health(calls: DataFrame, most: int = 200) -> DataFrame:
    """Per tool over its last calls: error rate, p95 by index, last success, failures in a row, state.

    calls: (tool, success, latency_ms, at, id).
    """
    w = Window.partitionBy("tool").orderBy(F.col("at").desc(), F.col("id").desc())
    last = calls.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    rank = F.row_number().over(Window.partitionBy("tool").orderBy("latency_ms", "id")) - 1
    n = F.count("*").over(Window.partitionBy("tool"))
    last = last.withColumn("_p", rank == F.least(n - 1, F.floor(n * 0.95)))
    agg = last.groupBy("tool").agg(
        F.count("*").alias("calls"), F.avg((~F.col("success")).cast("double")).alias("error_rate"), F.max(F.when(F.col("_p"), F.col("latency_ms"))).alias("p95"),
        F.max(F.when(F.col("success"), F.col("at"))).alias("last_success"), (F.coalesce(F.min(F.when(F.col("success"), F.col("_n"))), F.count("*") + 1) - 1).alias("failures_in_a_row"),
    )
    return agg.withColumn("state", F.when(F.col("failures_in_a_row") >= 3, "open").when(F.col("error_rate") > 0.2, "degraded").otherwise("healthy"))


def routing_quality(results: DataFrame) -> DataFrame:
    """results: (expected_mode, actual_mode, escalated, passed); an escalated run counts as multi."""
    actual = F.when(F.col("escalated"), "multi").otherwise(F.col("actual_mode"))
    e, zero = F.col("expected_mode"), lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return results.withColumn("_a", actual).agg(
        F.round(F.avg((e == F.col("_a")).cast("double")), 6).alias("accuracy"), zero(F.count_if((e == "multi") & (F.col("_a") != "multi")), F.count_if(e == "multi")).alias("under_routing"),
        zero(F.count_if((e != "multi") & (F.col("_a") == "multi")), F.count_if(e != "multi")).alias("over_routing"), F.round(F.avg(F.col("escalated").cast("double")), 6).alias("escalation_rate"),
        zero(F.count_if(F.col("escalated") & F.col("passed")), F.count_if("escalated")).alias("successful_escalation_rate"),
    )


def preference_profile(votes: DataFrame) -> DataFrame:
    """Last vote of each message, votes by style, the preferred one (a tie is concise) and its strength. votes: (user_id, message_id, style, ts)."""
    last = latest(votes, ["user_id", "message_id"], ["ts", "style"])
    agg = last.groupBy("user_id").agg(F.count_if(F.col("style") == "concise").alias("concise"), F.count_if(F.col("style") == "detailed").alias("detailed"))
    most = F.greatest("concise", "detailed")
    return agg.withColumn("preferred", F.when(F.col("detailed") > F.col("concise"), "detailed").otherwise("concise")).withColumn("strength", F.round((most + 1) / (F.col("concise") + F.col("detailed") + 2), 6))


def trend(runs: DataFrame, metrics: DataFrame, metric: str, n: int) -> DataFrame:
    """The last n completed runs, oldest first, with the metric (0 where missing)."""
    last = runs.filter("status = 'completed'").orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(n)
    return last.join(metrics.filter(F.col("metric") == metric).select("run_id", "value"), "run_id", "left").select("run_id", "finished_at", F.coalesce("value", F.lit(0.0)).alias("value")).orderBy("finished_at", "run_id")


def step_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step_no", "action"))), lambda x: x["action"]).alias("actions"))


def doc_progress(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """A document's final state wins over its task's progress; failures stay below 100."""
    j = docs.join(tasks.select("doc_id", "progress"), "doc_id", "left")
    p = F.coalesce("progress", F.lit(0))
    value = F.when(F.col("vector_status") == "completed", 100).when(F.col("vector_status") == "failed", F.least(F.lit(99), F.greatest(F.lit(0), p))).when(F.col("progress").isNotNull(), p)
    return j.withColumn("shown", value.when(F.col("vector_status") == "processing", 65).when(F.col("parse_status") == "completed", 60).when(F.col("parse_status") == "processing", 2).otherwise(0))


def owned_messages(messages: DataFrame, sessions: DataFrame, session: str, user: str) -> DataFrame:
    """Messages with their session's owner; those of sessions without one drop out. sessions: session, user."""
    owner = sessions.select(F.col(session).alias("_s"), F.col(user).alias("owner"))
    return messages.join(owner, F.col(session) == F.col("_s")).drop("_s")


def system_stats(counts: dict[str, DataFrame], active: DataFrame, user: str) -> DataFrame:
    """(measure, value): rows of each table, and the distinct users of the active one; each table is read once, for a count."""
    out = active.agg(F.count_distinct(user).alias("value")).select(F.lit("active_users").alias("measure"), "value")
    for name, df in counts.items():
        out = out.unionByName(df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value"))
    return out
