"""Versioned facts: write policy, merge of changes, expiry, retrieval, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as tx

KEY = ["tenant_id", "user_id", "subject", "predicate"]
#: Sources by trust.
HIGH, LOW = ["user_confirmed", "clinician", "user_explicit"], ["model_inference", "assistant", "web"]


def trust(source: Column) -> Column:
    return F.when(source.isin(HIGH), "high").when(source.isin(LOW), "low").otherwise("medium")


def namespace(tenant: Column, user: Column, kind: Column) -> Column:
    return F.concat(F.lit("tenant:"), tenant, F.lit("/user:"), user, F.lit("/memory_type:"), kind)


def decide_write(candidates: DataFrame, least_confidence: float = 0.6, least_importance: float = 0.3) -> DataFrame:
    """accept, needs_confirmation, or the first reason to reject."""
    return candidates.withColumn(
        "decision",
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "rejected:empty").when(F.col("source_role") == "assistant", "rejected:assistant_source").when(F.col("confidence") < least_confidence, "rejected:low_confidence")
        .when(F.col("importance") < least_importance, "rejected:low_importance").when((F.col("sensitivity") == "sensitive") & ~F.col("explicit"), "rejected:sensitive_not_explicit")
        .when((F.col("sensitivity") == "sensitive") & ~F.col("confirmed"), "needs_confirmation").otherwise("accept"),
    )


def merge_changes(changes: DataFrame, days: int = 90) -> DataFrame:
    """Versions of each key from its changes in order of time: runs of one value are one version (slowly changing dimension, type 2).

    changes: KEY, value, source_type, confidence, importance (may be missing), ts; a version has the greatest confidence and importance. A change from a low-trust source that contradicts is `disputed`
    and doesn't move the active version; the last undisputed version is active until it expires.
    """
    if "importance" not in changes.columns:
        changes = changes.withColumn("importance", F.lit(None).cast("double"))
    c = changes.withColumn("trusted", trust(F.col("source_type")) != "low")
    w = Window.partitionBy(*KEY).orderBy("ts", "value")
    first = F.row_number().over(w) == 1
    lead = F.last(F.when(F.col("trusted") | F.col("_first"), F.col("value")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_first", first).withColumn("_active", lead)
    c = c.withColumn("disputed", ~F.col("trusted") & ~F.col("_first") & (F.col("value") != F.col("_active")))
    c = c.withColumn("_new", (~F.col("disputed") & (F.col("_first") | (F.col("value") != F.col("_active")))).cast("int"))
    c = c.withColumn("version", F.sum("_new").over(w))
    kept = c.filter(~F.col("disputed")).groupBy(*KEY, "version").agg(F.max("value").alias("value"), F.min("ts").alias("valid_from"), F.max("ts").alias("last_seen"), F.max("confidence").alias("confidence"), F.max("importance").alias("importance"), F.count("*").alias("sources"))
    after = Window.partitionBy(*KEY).orderBy("version")
    kept = kept.withColumn("valid_to", F.lead("valid_from").over(after)).withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))
    kept = kept.withColumn("expires_at", F.col("last_seen") + F.expr(f"interval {days} days"))
    lost = c.filter("disputed").select(*KEY, "version", "value", F.col("ts").alias("valid_from"), F.col("ts").alias("last_seen"), "confidence", "importance", F.lit(1).cast("long").alias("sources"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("disputed").alias("status"), (F.col("ts") + F.expr(f"interval {days} days")).alias("expires_at"))
    return kept.unionByName(lost)


def expire(facts: DataFrame, now: Column) -> DataFrame:
    """Active or disputed facts whose time is over get the status expired and their end."""
    over = F.col("status").isin("active", "disputed") & (F.col("expires_at") <= now)
    return facts.withColumn("valid_to", F.when(over, now).otherwise(F.col("valid_to"))).withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def delete(facts: DataFrame, ids: DataFrame, key: str = "fact_id") -> DataFrame:
    """Deleted facts stay as rows without their text."""
    gone = ids.select(F.col(key).alias("_id")).distinct()
    j = facts.join(gone, F.col(key) == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return j.withColumn("status", F.when(hit, "deleted").otherwise(F.col("status"))).withColumn("value", F.when(hit, "[DELETED]").otherwise(F.col("value"))).drop("_id")


def change_audit(before: DataFrame, after: DataFrame, key: str = "fact_id") -> DataFrame:
    """(key, change, old, new) of rows that differ; a sensitive value is masked."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    show = lambda t: F.when(F.col(f"{t}.sensitivity") == "sensitive", "[PROTECTED]").otherwise(F.concat_ws(":", f"{t}.status", f"{t}.value"))
    same = F.col("a.status").eqNullSafe(F.col("b.status")) & F.col("a.value").eqNullSafe(F.col("b.value"))
    change = F.when(F.col(f"a.{key}").isNull(), "created").when(F.col(f"b.{key}").isNull(), "removed").otherwise("changed")
    return j.filter(~same | F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), show("a").alias("old"), show("b").alias("new"))


def protect(facts: DataFrame, secret: str, iv: str) -> DataFrame:
    """Sensitive values encrypted, their searchable text masked. The iv fixes the ciphertext; leave it to Spark in production."""
    sealed = F.base64(F.aes_encrypt("value", F.lit(secret), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit(iv))))
    hot = F.col("sensitivity") == "sensitive"
    return facts.withColumn("sealed", F.when(hot, sealed)).withColumn("value", F.when(hot, "[PROTECTED]").otherwise(F.col("value")))


def reveal(facts: DataFrame, secret: str) -> DataFrame:
    """`opened`: what was sealed, for those who have the secret; null where nothing was."""
    return facts.withColumn("opened", F.aes_decrypt(F.unbase64("sealed"), F.lit(secret), F.lit("CBC"), F.lit("PKCS")).cast("string"))


def retrieve(queries: DataFrame, facts: DataFrame, now: Column, items: int = 6, pool: int = 200) -> DataFrame:
    """Facts of each query's owner: 0.35 Jaccard + 0.25 share of the query + 0.20 importance + 0.10 recency + 0.10 confidence.

    queries: (query_id, tenant_id, user_id, query); facts: KEY, fact_id, value, importance, confidence, updated_at, expires_at, status.
    """
    live = facts.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    top = Window.partitionBy("tenant_id", "user_id").orderBy(F.col("importance").desc(), F.col("updated_at").desc(), F.col("fact_id"))
    live = live.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= pool)
    j = queries.withColumn("qt", tx.fact_tokens(F.col("query"))).join(live.withColumn("ft", tx.fact_tokens(F.concat_ws(" ", "subject", "predicate", "value"))), ["tenant_id", "user_id"])
    both = F.size(F.array_intersect("qt", "ft"))
    days = (F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 86400
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = 0.35 * zero(F.try_divide(both, F.size(F.array_union("qt", "ft")))) + 0.25 * zero(F.try_divide(both, F.size("qt"))) + 0.20 * F.col("importance") + 0.10 * F.pow(F.lit(0.5), days / 30) + 0.10 * F.col("confidence")
    j = j.withColumn("score", F.round(F.least(F.lit(1.0), score), 6))
    j = j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "fact_id")))
    return j.filter(F.col("rank") <= items).select("query_id", "rank", "fact_id", "score")


def session_state(messages: DataFrame, size: int = 200) -> DataFrame:
    """Per session: messages, last turn, and the topic: the last user message's first characters. messages: (conv_id, turn, role, text)."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.substring(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))), 1, size).alias("topic"))


def conversation_tail(messages: DataFrame, n: int = 10, size: int = 4000) -> DataFrame:
    """The last n messages of each session as one text, its last characters."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))), lambda x: x["line"])
    return last.groupBy("conv_id").agg(F.right(F.array_join(lines, "\n"), F.lit(size)).alias("tail"))


def leak_rate(rankings: DataFrame, cases: DataFrame) -> DataFrame:
    """Share of cases that return a row of another owner or of the assistant. rankings: (case_id, owner, role); cases: (case_id, user)."""
    j = cases.join(rankings, "case_id", "left").groupBy("case_id").agg(F.coalesce(F.bool_or((F.col("owner") != F.col("user")) | (F.col("role") == "assistant")), F.lit(False)).alias("leaks"))
    return j.agg(F.round(F.avg(F.col("leaks").cast("double")), 6).alias("leak_rate"))
