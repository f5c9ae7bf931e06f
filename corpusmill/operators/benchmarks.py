"""Benchmarks, reviews and summaries over case tables, and set operations on arrays."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as tx
from corpusmill.operators import retrieval as rt


def ratio(a: Column, b: Column) -> Column:
    """Share of 1 that b is of a, 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def is_subsequence(expected: Column, actual: Column) -> Column:
    """Does `expected` stand in `actual` in order? A fold with a cursor."""
    return F.aggregate(actual, F.lit(0), lambda i, x: F.when((i < F.size(expected)) & F.get(expected, i).eqNullSafe(x), i + 1).otherwise(i)) == F.size(expected)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of several sources, one after the other: source_no says which."""
    out = sources[0].withColumn("source_no", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source_no", F.lit(k)), allowMissingColumns=True)
    return out


def review(rows: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows after their reviews (approved ones with the next version), and decisions that the state doesn't allow."""
    j = rows.join(decisions, key, "left")
    may = F.col("status").isin("pending", "approved")
    hit = F.col("decision").isNotNull()
    done = j.withColumn("version", F.when(hit & may & (F.col("decision") == "approved") & (F.col("status") != "approved"), F.col("version") + 1).otherwise(F.col("version")))
    done = done.withColumn("status", F.when(hit & may, F.col("decision")).otherwise(F.col("status"))).drop("decision")
    return done, j.filter(hit & ~may).select(key, "status", "decision")


def snapshot(cases: DataFrame, version: str, key: str, fields: list[str]) -> DataFrame:
    """A version's rows by key, with a hash of what they say."""
    return cases.select(F.lit(version).alias("version"), key, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256).alias("content_sha256"))


def snapshot_changes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = a.select(F.col(key).alias("_a"), F.col("content_sha256").alias("_x")), b.select(F.col(key).alias("_b"), F.col("content_sha256").alias("_y"))
    j = x.join(y, F.col("_a") == F.col("_b"), "full").filter("_x is null or _y is null or _x <> _y")
    return j.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").otherwise("changed").alias("change"))


def tool_contract(calls: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: share of expected tools with a call that is no error, and whether any failed. expected: (case_id, tool)."""
    good = calls.filter(~F.col("status").isin("error", "forbidden", "timeout", "cancelled")).select("case_id", "tool").distinct().withColumn("ok", F.lit(1))
    bad = calls.filter("error_code is not null").select("case_id").distinct().withColumn("bad", F.lit(True))
    e = expected.join(good, ["case_id", "tool"], "left").groupBy("case_id").agg((F.sum(F.coalesce("ok", F.lit(0))) / F.count("*")).alias("score"))
    return e.join(bad, "case_id", "left").select("case_id", F.round("score", 6).alias("score"), (F.coalesce("bad", F.lit(False)) | (F.col("score") < 1)).alias("failed"))


def compare_reports(a: DataFrame, b: DataFrame, metrics: list[str], slack: float = 1e-6) -> DataFrame:
    """One row: the verdict over the deltas of two one-row reports."""
    deltas = a.select(*[F.col(m).alias(f"a_{m}") for m in metrics]).crossJoin(b.select(*[F.col(m).alias(f"b_{m}") for m in metrics]))
    d = F.array(*[F.col(f"b_{m}") - F.col(f"a_{m}") for m in metrics])
    up, down = F.exists(d, lambda x: x > slack), F.exists(d, lambda x: x < -slack)
    return deltas.select(F.when(up & down, "mixed").when(up, "better").when(down, "worse").otherwise("unchanged").alias("verdict"), *[F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 6).alias(m) for m in metrics])


def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of two texts that matching runs cover; for short texts such as cases and blocks."""
    return F.pandas_udf(_sequence_ratio, "double")(a, b)


def cleaning_benchmark(cases: DataFrame, cleaned: str, expected: str, symbols: str = "μ±≤≥℃%") -> DataFrame:
    """One row: exact matches, symbols kept, containment. Longer texts need no alignment for these."""
    kept = lambda c: F.length(c) - F.length(F.translate(c, symbols, ""))
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg((F.col(cleaned) == F.col(expected)).cast("double")), 6).alias("exact"), F.round(F.avg((kept(F.col(cleaned)) == kept(F.col(expected))).cast("double")), 6).alias("symbols_kept"), F.round(F.avg(F.col(cleaned).contains(F.col(expected)).cast("double")), 6).alias("contained"))


def merge_native_ocr(native: DataFrame, ocr: DataFrame, least: float = 0.88) -> DataFrame:
    """Native blocks, and OCR blocks that none of their page is similar to, in order of (y, x). blocks: doc_id, page, block_id, text, x0, y0."""
    n = native.select("doc_id", "page", F.col("text").alias("_native"))
    same = ocr.join(n, ["doc_id", "page"]).filter(sequence_ratio(F.col("text"), F.col("_native")) >= least).select("doc_id", "page", "block_id").distinct()
    both = native.withColumn("method", F.lit("native")).unionByName(ocr.join(same, ["doc_id", "page", "block_id"], "left_anti").withColumn("method", F.lit("ocr")))
    return both.withColumn("block_order", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "block_id")) - 1)


def merge_table_variants(tables: DataFrame) -> DataFrame:
    """The first source's table of each fingerprint (headers and two rows). tables: doc_id, source_no, table_id, headers, rows."""
    print_ = F.lower(F.regexp_replace(F.concat_ws("|", F.array_join("headers", "|"), F.array_join(F.flatten(F.slice("rows", 1, 2)), "|")), r"[^\p{L}\p{N}|]+", ""))
    return rt.keep_first(tables.withColumn("fingerprint", print_), ["doc_id", "fingerprint"], [F.col("source_no"), F.col("table_id")])


def memory_benchmark(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Two rows: mean reciprocal rank and hit@1 of 0.7 dense + 0.3 sparse, and of exact hits before fused ranks. candidates: case_id, id, dense, sparse, exact, relevant."""
    by = Window.partitionBy("case_id")
    rank = lambda *o: F.row_number().over(by.orderBy(*o, F.col("id")))
    c = candidates.withColumn("_d", rank(F.col("dense").desc())).withColumn("_s", rank(F.col("sparse").desc())).withColumn("_b", 0.7 * F.col("dense") + 0.3 * F.col("sparse"))
    c = c.withColumn("_f", 1 / (k + F.col("_d")) + 1 / (k + F.col("_s"))).withColumn("weighted", rank(F.col("_b").desc())).withColumn("fused", rank(F.col("exact").desc(), F.col("_f").desc()))
    first = c.filter("relevant").groupBy("case_id").agg(F.min("weighted").alias("weighted"), F.min("fused").alias("fused"))
    long = first.select(F.explode(F.create_map(F.lit("weighted"), "weighted", F.lit("fused"), "fused")).alias("ranking", "rank"))
    return long.groupBy("ranking").agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("hit_at_1"))


def routing_benchmark(cases: DataFrame) -> DataFrame:
    """One row, over all cases: accuracy, routed below and above what was expected. cases: expected, actual as levels 0, 1, 2."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return cases.agg(share(F.col("expected") == F.col("actual")).alias("accuracy"), share(F.col("actual") < F.col("expected")).alias("under"), share(F.col("actual") > F.col("expected")).alias("over"))


def suite_summary(rows: DataFrame) -> DataFrame:
    """One row: intent accuracy, and recall and precision of emergencies (1 where there are none). rows: expected, actual intents."""
    e, a = F.col("expected") == "emergency_risk", F.col("actual") == "emergency_risk"
    one = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(1.0)), 6)
    return rows.agg(F.round(F.avg((F.col("expected") == F.col("actual")).cast("double")), 6).alias("accuracy"), one(F.count_if(e & a), F.count_if(e)).alias("emergency_recall"), one(F.count_if(e & a), F.count_if(a)).alias("emergency_precision"))


def on_off_report(off: DataFrame, on: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, off, on, delta, lift) of two one-row tables with `queries`; refused (no rows) if their sizes differ."""
    long = lambda d, n: d.select("queries", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", n))
    j = long(off, "off").join(long(on, "on"), ["queries", "metric"])
    return j.withColumn("delta", F.round(F.col("on") - F.col("off"), 6)).withColumn("lift", F.round(F.try_divide(F.col("on") - F.col("off"), F.nullif("off", F.lit(0.0))), 6))


def latest_against_previous(runs: DataFrame, kind: str, metric: str) -> DataFrame:
    """The newest run of a kind with the one before it and the change. runs: run_id, kind, finished_at, metric columns."""
    own = runs.filter(F.col("kind") == kind)
    w = Window.partitionBy("kind").orderBy(F.col("finished_at"), F.col("run_id"))
    last = own.orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(2)
    return last.withColumn("previous", F.lag(metric).over(w)).orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(1).select("run_id", metric, F.round(F.col(metric) - F.coalesce("previous", F.col(metric)), 6).alias("delta"))


def retrieve_episodes(queries: DataFrame, episodes: DataFrame, most: int = 3, pool: int = 50) -> DataFrame:
    """Reusable episodes of the owner or shared ones, best quality first, ranked by shared words. episodes: episode_id, tenant_id, user_id (null: shared), text, quality, reusable."""
    e = episodes.filter("reusable").withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.col("quality").desc(), "episode_id"))).filter(F.col("_n") <= pool)
    e = e.select(F.col("tenant_id").alias("_t"), F.col("user_id").alias("_u"), "episode_id", "quality", tx.fact_tokens(F.col("text")).alias("_et"))
    j = queries.withColumn("_qt", tx.fact_tokens(F.col("query"))).join(e, (F.col("tenant_id") == F.col("_t")) & (F.col("_u").isNull() | (F.col("_u") == F.col("user_id"))))
    j = j.withColumn("overlap", F.size(F.array_intersect("_qt", "_et"))).filter("overlap > 0")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), F.col("quality").desc(), "episode_id"))).filter(F.col("rank") <= most).select("query_id", "rank", "episode_id", "overlap")


def retrieve_procedures(requests: DataFrame, procedures: DataFrame, most: int = 3, least: float = 0.8) -> DataFrame:
    """Active procedures (score, approval) of the tenant and agent, or of any. procedures: procedure_id, tenant_id, agent (null: any), score, approved."""
    p = procedures.filter((F.col("score") >= least) & F.col("approved")).select(F.col("tenant_id").alias("_t"), F.col("agent").alias("_a"), "procedure_id", "score")
    j = requests.join(p, (F.col("_t").isNull() | (F.col("_t") == F.col("tenant_id"))) & (F.col("_a").isNull() | (F.col("_a") == F.col("agent"))))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("score").desc(), "procedure_id"))).filter(F.col("rank") <= most).select("request_id", "rank", "procedure_id")


def heading_paths(blocks: DataFrame, most_blocks: int | None = None) -> DataFrame:
    """Each block with the titles above it: the last heading of each level that no higher one has closed.

    A heading's level is one more than the dots of its number. The last heading of each level up to 6 and the place of
    the last one of a higher level are running window values, so a document needs no collecting.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "block_order").rowsBetween(Window.unboundedPreceding, 0)
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)", 1)
    level = F.when(F.col("kind") == "heading", F.least(F.lit(6), F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1).otherwise(1)))
    b = blocks.withColumn("_level", level).withColumn("_at", F.struct("page", "block_order"))
    for k in range(1, 7):
        b = b.withColumn(f"_t{k}", F.last(F.when(F.col("_level") == k, F.struct(F.col("_at"), F.col("text"))), True).over(w)).withColumn(f"_h{k}", F.max(F.when(F.col("_level") < k, F.col("_at"))).over(w))
    parts = [F.when(F.col(f"_t{k}").isNotNull() & (F.col(f"_h{k}").isNull() | (F.col(f"_t{k}")["_at"] > F.col(f"_h{k}"))), F.col(f"_t{k}")["text"]) for k in range(1, 7)]
    return b.withColumn("section_path", F.array_compact(F.array(*parts))).drop("_level", "_at", *[f"_{x}{k}" for k in range(1, 7) for x in "th"])


def resolve_pronouns(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pronouns at a query's start replaced by the session's first entity or topic. sessions: session_id, entities, topic."""
    j = queries.join(sessions, "session_id", "left").withColumn("_e", F.coalesce(F.get("entities", F.lit(0)), "topic"))
    said = F.regexp_replace("query", rf"(?i){EDGE}(it|this|that|they){EDGE}|它|这个|那个", "\u0001")
    return j.withColumn("resolved", F.when(F.col("_e").isNotNull(), F.replace(said, F.lit("\u0001"), F.col("_e"))).otherwise(F.col("query"))).drop("_e")


#: Borders of ASCII words (Java's own takes places beside accented letters for borders), and the blanks that a trim takes off.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def plan_features(queries: DataFrame, col: str = "query") -> DataFrame:
    """Numbers with units (ranges first), negations, and up to five sub-questions of each query; a null query has none of them, but nulls."""
    q = F.col(col)
    unit = r"[\t\n\f\r ]*(?:mg|g|ml|kg|%|mmHg|mmol/L|years?|days?|岁|天|周|月)"
    span = rf"(?iu)\d+(?:\.\d+)?[\t\n\f\r ]*(?:-|~|to|至|到)[\t\n\f\r ]*\d+(?:\.\d+)?{unit}"
    ranges = F.regexp_extract_all(q, F.lit(span), F.lit(0))
    single = F.regexp_extract_all(F.regexp_replace(q, span, " "), F.lit(rf"(?iu)\d+(?:\.\d+)?{unit}"), F.lit(0))
    negations = F.regexp_extract_all(F.lower(q), F.lit(rf"{EDGE}(?:not|no|without|never){EDGE}|不|无|非|禁"), F.lit(0))
    parts = F.slice(F.filter(F.transform(F.split(q, rf"[?？;；]|{EDGE}and{EDGE}"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != ""), 1, 5)
    return queries.select("*", F.concat(ranges, single).alias("numbers"), F.array_distinct(negations).alias("negations"), parts.alias("sub_questions"))


def flatten_topics(df: DataFrame, col: str, depth: int = 3) -> DataFrame:
    """Topics nested up to `depth` levels (each a struct with text, url and a JSON list of topics), as rows."""
    schema = "array<struct<text:string,url:string,topics:string>>"
    now, out = df.withColumn("_t", F.explode(F.from_json(col, schema))), None
    for _ in range(depth):
        leaf = now.filter("_t.url is not null").select(*df.columns, "_t.text", "_t.url")
        out = leaf if out is None else out.unionByName(leaf)
        now = now.filter("_t.topics is not null").withColumn("_t", F.explode(F.from_json("_t.topics", schema)))
    return out


def distinct_in_order(values: Column) -> Column:
    """An array's values, each where it first stands; a null counts as one value."""
    return F.array_distinct(values)


def set_counts(expected: Column, actual: Column) -> Column:
    """(both, missing, unexpected): how many distinct values two arrays share, and each has alone."""
    return F.struct(F.size(F.array_intersect(expected, actual)).alias("both"), F.size(F.array_except(expected, actual)).alias("missing"), F.size(F.array_except(actual, expected)).alias("unexpected"))


def tool_benchmark(cases: DataFrame, expected: str = "expected", used: str = "used") -> DataFrame:
    """One row: cases, and the shares of them with the expected tools exactly, with one missing, with one too many."""
    c = cases.select(set_counts(F.coalesce(F.col(expected), F.array().cast("array<string>")), F.coalesce(F.col(used), F.array().cast("array<string>"))).alias("x"))
    share = lambda x: F.round(F.avg(x.cast("double")), 6)
    return c.agg(F.count("*").alias("cases"), share((F.col("x.missing") == 0) & (F.col("x.unexpected") == 0)).alias("exact"), share(F.col("x.missing") > 0).alias("missing"), share(F.col("x.unexpected") > 0).alias("unnecessary"))
