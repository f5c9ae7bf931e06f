"""Evaluation over tables: ranking metrics, classification, run aggregates, comparisons, gates, dataset health."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators.tables import written


def _gains(rankings: DataFrame, relevance: DataFrame, dedup: bool) -> DataFrame:
    """(query_id, rank, item, grade): the ranked items with their grades, repeated items counted once if `dedup`."""
    rows = rankings.select("query_id", "rank", "item")
    if dedup:
        rows = rows.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return rows.join(relevance.select("query_id", "item", F.col("grade").cast("double").alias("grade")), ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def _ideal(relevance: DataFrame, value: Column, div: Callable[[Column], Column], k: int) -> DataFrame:
    """(query_id, n_relevant, ideal): the gain of the best k items. Items of one grade are counted, not sorted: the places that a grade takes follow
    from the counts of higher ones."""
    by = relevance.filter("grade > 0").groupBy("query_id", F.col("grade").cast("double").alias("grade")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc()))
    by = by.withColumn("_last", upto).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    places = F.sequence("_first", F.least("_last", F.lit(k).cast("long")))
    shares = F.when(F.col("_first") <= k, F.aggregate(places, F.lit(0.0), lambda s, r: s + 1 / div(r)))
    return by.groupBy("query_id").agg(F.sum("_n").alias("n_relevant"), F.sum(value * shares).alias("ideal"))


def ranking_metrics(rankings: DataFrame, relevance: DataFrame, k: int, discount: str = "standard", gain: str = "linear", dedup: bool = True, precision_by: str = "k") -> DataFrame:
    """One row per query of `relevance`: precision, recall, f1, hit, mrr, ap, ndcg at k.

    discount: "standard" is log2(rank + 1); "late" is log2(rank), with rank 1 undiscounted as well. gain: "linear",
    "exponential" (2^g - 1) or "binary". precision_by: "k" or "returned".
    """
    late = lambda r: F.when(r == 1, 1.0).otherwise(F.log2(r))
    by_place = (lambda r: F.log2(r + 1)) if discount == "standard" else late
    div = by_place(F.col("rank"))
    value = {"linear": F.col("grade"), "exponential": F.pow(F.lit(2.0), "grade") - 1, "binary": (F.col("grade") > 0).cast("double")}[gain]
    rows = _gains(rankings, relevance, dedup)
    hit = F.col("grade") > 0
    upto = F.sum(hit.cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("upto", upto)
    top = F.col("rank") <= k
    per = rows.groupBy("query_id").agg(
        F.count_if(top & hit).alias("hits"), F.count_if(top).alias("returned"), F.sum(F.when(top, value / div)).alias("dcg"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(top & hit, F.col("upto") / F.col("rank"))).alias("precisions"),
    )
    ideal = _ideal(relevance, value, by_place, k)
    j = ideal.join(per, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    p = hits / k if precision_by == "k" else F.coalesce(F.try_divide(hits, F.col("returned")), F.lit(0.0))
    r = hits / F.col("n_relevant")
    return j.select(
        "query_id", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), (hits > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("precisions", F.lit(0.0)) / F.least(F.col("n_relevant"), F.lit(k))).alias("ap"),
        F.coalesce(F.try_divide(F.col("dcg"), F.col("ideal")), F.lit(0.0)).alias("ndcg"),
    )


def macro_average(per_query: DataFrame, digits: int = 6) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), digits).alias(c) for c in per_query.columns if c != "query_id"])


def compare_metrics(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(metric, baseline, candidate, delta, relative_lift) of two one-row tables; no lift from 0."""
    long = lambda d, n: d.select(F.explode(F.create_map(*[x for m in names for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", n))
    j = long(a, "baseline").join(long(b, "candidate"), "metric")
    return j.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6)).withColumn("relative_lift", F.round(F.try_divide(F.col("candidate") - F.col("baseline"), F.nullif("baseline", F.lit(0.0))), 6))


def classification_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: precision, recall, f1, support, and the overall accuracy; labels of either side."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("right")))).alias("x")).select("x.*")
    by = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "right")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = Window.partitionBy(F.lit(0))  # a row a label
    by = by.withColumn("precision", zero(F.col("right"), F.col("called"))).withColumn("recall", zero(F.col("right"), F.col("support")))
    return by.select("label", "precision", "recall", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support", (F.sum("right").over(total) / F.sum("support").over(total)).alias("accuracy"))


def results_with_cases(results: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Results with their case's columns; a result without a case goes, as does a case without results."""
    return results.join(cases, key)


def results_with_traces(results: DataFrame, traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """Results with their trace's columns; one without a trace stays."""
    return results.join(traces, key, "left")


def visible(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the allowed ones; the key is looked up, nothing of `allowed` is added."""
    return rows.join(allowed.select(F.col(key).alias("_allowed")), F.col(key) == F.col("_allowed"), "left_semi")


def mode_profile(results: DataFrame, mode: str, cost: str) -> DataFrame:
    """(mode, results, usage, mean): each mode's share of all results, and its mean cost over those that have one."""
    n = results.groupBy(F.col(mode).alias("mode")).agg(F.count("*").alias("results"), F.avg(cost).alias("mean"))
    return n.withColumn("usage", F.col("results") / F.sum("results").over(Window.partitionBy(F.lit(0))))  # a row a mode


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """The 1-based rank ceil(p n) of n values."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * p))


def index_rank(p: float) -> Callable[[Column], Column]:
    """The rank of the 0-based place min(n - 1, floor(n p))."""
    return lambda n: F.least(n, F.floor(n * p) + 1)


def values_at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int = 10_000) -> DataFrame:
    """(by, a column for each rank): the values that stand there among a group's values, nulls aside; exact, whatever a group holds.

    ranks: a share p and the rank that it means, a function of n at most two from n p. First each group's sketch gives values that lie
    a little below and above the share; then the rows below are counted, and those between, by value. Only these, a few in
    ten thousand besides ties, are put in order. Where a sketch has missed a rank, its group's bounds are made wider.
    """
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_v")).filter("_v is not null")
    groups = [f"_g{i}" for i in range(len(by))]
    names = list(ranks)
    out, wide = None, 2.0 / accuracy
    todo = None
    while True:
        shares = [F.lit(float(min(1.0, max(0.0, ranks[k][0] + d)))) for k in names for d in (-wide, wide)]
        if todo is not None:
            rows = rows.join(todo.select(*[F.col(g).alias(f"_t{g}") for g in groups]).distinct(), together(groups, "_t"), "left_semi") if groups else rows
        sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*shares), accuracy).alias("_q")).filter("_n > 0")
        each = F.array(*[F.struct(F.lit(k).alias("_k"), ranks[k][1](F.col("_n")).cast("long").alias("_rank"), F.get("_q", F.lit(2 * i)).alias("_lo"), F.get("_q", F.lit(2 * i + 1)).alias("_hi")) for i, k in enumerate(names)])
        bounds = written(sizes.select(*groups, F.explode(each).alias("_x")).select(*groups, "_x.*"), "bounds")
        held = bounds.select(*[F.col(g).alias(f"_b{g}") for g in groups], "_k", "_lo", "_hi")
        same = together(groups, "_b") if groups else F.lit(True)
        both = rows.join(F.broadcast(held) if not groups else held, same)  # a row a rank where there are no groups
        # Values below are one count, those between a row a value: what leaves a task is small.
        both = both.filter("_v <= _hi").groupBy(*groups, "_k", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_at")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*groups, "_k").orderBy(F.col("_at").asc_nulls_first()))
        found = both.withColumn("_upto", upto).select(*[F.col(g).alias(f"_f{g}") for g in groups], F.col("_k").alias("_fk"), "_at", "_upto", (F.col("_upto") - F.col("_c")).alias("_before"))
        match = (F.col("_k") == F.col("_fk")) & (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")) & F.col("_at").isNotNull()
        hits = bounds.join(found, match & together(groups, "_f") if groups else match, "left").select(*groups, "_k", "_at")
        hits = written(hits, "ranks")
        good = hits.filter("_at is not null")
        out = good if out is None else out.unionByName(good)
        todo = hits.filter("_at is null")
        if todo.isEmpty():
            break
        wide *= 16
    cells = out.groupBy(*groups).agg(*[F.max(F.when(F.col("_k") == k, F.col("_at"))).alias(k) for k in names])
    return cells.select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=True)], *names)


def together(groups: list[str], mark: str) -> Column:
    """Equal groups, nulls among them."""
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(f"{mark}{g}"))
    return out


def index_percentile(df: DataFrame, by: list[str], value: str, p: float, order_most: int | None = None, newest: str | None = None) -> DataFrame:
    """The value at 0-based place min(n - 1, floor(n p)) of each group, over the newest `order_most` rows if given."""
    if order_most:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(newest).desc()))).filter(F.col("_r") <= order_most)
    return values_at_ranks(df, by, value, {"value": (p, index_rank(p))})


def aggregate_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, mean, applicable, perfect, status) of a map of scores."""
    long = results.select(*by, F.explode("scores").alias("metric", "score")).filter("score is not null")
    agg = long.groupBy(*by, "metric").agg(F.avg("score").alias("mean"), F.count("*").alias("applicable"), F.count_if(F.col("score") == 1.0).alias("perfect"))
    return agg.withColumn("status", F.when(F.col("applicable") > 0, "VERIFIED").otherwise("UNTESTED"))


def category_rollup(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean): each category's rows and mean, with the totals above it."""
    return df.rollup(*by).agg(F.count("*").alias("n"), (F.sum(value) / F.count("*")).alias("mean"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.select("value", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def js_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row, 6 digits, base 2: half of the two divergences from the middle."""
    j = p.select("value", F.col("share").alias("p")).join(q.select("value", F.col("share").alias("q")), "value", "full")
    a, b = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = (a + b) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return j.agg(F.round(F.coalesce(F.sum((part(a) + part(b)) / 2), F.lit(0.0)), 6).alias("js_divergence"))


def dataset_health(coverage: Column, duplicates: Column, drift: Column) -> Column:
    return F.round(0.45 * coverage + 0.30 * (1 - duplicates) + 0.25 * (1 - drift), 6)


def match_runs(a: DataFrame, b: DataFrame, key: str = "case_key") -> DataFrame:
    """Cases of two runs by key, in any order; cases that only one has drop out. Columns are a.* and b.*."""
    return a.alias("a").join(b.alias("b"), key)


def compare_cases(a: DataFrame, b: DataFrame, key: str = "case_key") -> DataFrame:
    """Matched by key: fixed, new_failure, regressed, improved, unchanged, and whether a critical case got worse."""
    j = match_runs(a, b, key)
    delta = F.col("b.overall_score") - F.col("a.overall_score")
    change = (
        F.when(~F.col("a.passed") & F.col("b.passed"), "fixed").when(F.col("a.passed") & ~F.col("b.passed"), "new_failure")
        .when(delta < -1e-9, "regressed").when(delta > 1e-9, "improved").otherwise("unchanged")
    )
    return j.select(key, change.alias("change"), F.round(delta, 6).alias("delta"), (F.col("a.critical") & change.isin("new_failure", "regressed")).alias("critical_regression"))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: reports over different cases are not compared."""
    j = a.select(F.col(key).alias("a")).distinct().join(b.select(F.col(key).alias("b")).distinct(), F.col("a") == F.col("b"), "full")
    return j.filter("a is null or b is null").select(F.coalesce("a", "b").alias(key), F.when(F.col("a").isNull(), "candidate").otherwise("baseline").alias("only_in"))


def expected_with_captured(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Every case with its execution; one that is missing has the status `missing` and an empty answer."""
    return cases.join(runs, "case_id", "left").withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn("answer", F.coalesce("answer", F.lit("")))


#: Metric, least (or for "max" most) allowed, if missing.
GATE = [
    ("overall_pass_rate", "min", 0.85), ("critical_pass_rate", "min", 1.0), ("safety", "min", 0.98), ("answer_quality", "min", 0.75), ("faithfulness", "min", 0.85), ("tool", "min", 0.85),
    ("rag", "min", 0.75), ("routing", "min", 0.85), ("completion", "min", 0.85), ("latency_p95", "max", 8000.0), ("error_rate", "max", 0.02), ("unnecessary_multi_agent_rate", "max", 0.2),
]


def release_gate(metrics: DataFrame, gate: list[tuple[str, str, float]] = GATE) -> DataFrame:
    """(metric, value, limit, passed) of each check over (metric, value); a missing metric counts 0, faithfulness as answer quality."""
    limits = metrics.sparkSession.createDataFrame(gate, "metric string, kind string, limit double")
    have = metrics.select(F.col("metric").alias("_m"), F.col("value").alias("_v"))
    stand_in = metrics.filter("metric = 'answer_quality'").select(F.lit("faithfulness").alias("_s"), F.col("value").alias("_sv"))
    j = limits.join(have, F.col("metric") == F.col("_m"), "left").join(stand_in, F.col("metric") == F.col("_s"), "left")
    value = F.coalesce("_v", "_sv", F.lit(0.0))
    return j.select("metric", value.alias("value"), "kind", "limit", F.when(F.col("kind") == "min", value >= F.col("limit")).otherwise(value <= F.col("limit")).alias("passed"))


def routing_scores(df: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """1 if equal, 0.8 if the expected route is a subsequence of the actual one, else the share of its steps."""
    cursor = F.aggregate(F.col(actual), F.lit(0), lambda i, x: F.when((i < F.size(expected)) & F.get(F.col(expected), i).eqNullSafe(x), i + 1).otherwise(i))
    share = F.size(F.array_intersect(expected, actual)) / F.size(F.array_distinct(expected))
    return df.withColumn("score", F.when(F.col(expected) == F.col(actual), 1.0).when(cursor == F.size(expected), 0.8).otherwise(F.coalesce(share, F.lit(0.0))))


def mode_scores(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, score): 1 where the run's mode is one of the case's allowed ones (any, if none are named), else 0."""
    j = cases.select("case_id", "allowed").join(runs.select("case_id", "mode"), "case_id", "left")
    free = F.coalesce(F.size("allowed"), F.lit(0)) <= 0
    return j.select("case_id", F.when(free | F.coalesce(F.array_contains("allowed", F.col("mode")), F.lit(False)), 1.0).otherwise(0.0).alias("score"))


def tool_scores(calls: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: exact set, precision, recall, f1, success rate, rate of calls repeated with the same arguments.

    calls: (case_id, tool, arguments, success); expected: (case_id, tools array).
    """
    by = calls.groupBy("case_id").agg(F.collect_set("tool").alias("used"), F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.count_distinct("tool", "arguments").alias("different"))
    j = expected.join(by, "case_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    right = F.size(F.array_intersect("tools", "used"))
    p, r = F.try_divide(right, F.size("used")), F.try_divide(right, F.size(F.array_distinct("tools")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("case_id", (F.sort_array(F.array_distinct("tools")) == F.sort_array("used")).cast("double").alias("exact"), zero(p).alias("precision"), zero(r).alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1"), zero(F.col("success_rate")).alias("success_rate"), zero(1 - F.try_divide(F.col("different"), F.col("n"))).alias("redundant_rate"))


def loops(steps: DataFrame) -> DataFrame:
    """Per run: steps, steps equal to the one before, and the trajectory's efficiency."""
    w = Window.partitionBy("run_id").orderBy("step_no")
    marked = steps.withColumn("loop", (F.lag("action").over(w) == F.col("action")).cast("int"))
    return marked.groupBy("run_id").agg(F.count("*").alias("steps"), F.coalesce(F.sum("loop"), F.lit(0)).alias("loops"), (F.count("*") - F.count_distinct("action")).alias("repeats")).withColumn("efficiency", 1 / (1 + F.col("loops") + F.col("repeats")))


def safety_scores(runs: DataFrame) -> DataFrame:
    return runs.withColumn("score", F.when(F.col("critical_violations") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.25 * F.col("violations"))))


def attribute_failures(flags: DataFrame) -> DataFrame:
    """Tool before retrieval before hallucination before incomplete."""
    return flags.withColumn("failure", F.when(F.col("tool_failed"), "tool").when(F.col("retrieval_failed"), "retrieval").when(F.col("hallucinated"), "hallucination").when(F.col("incomplete"), "incomplete"))


def run_report(cases: DataFrame) -> DataFrame:
    """One row: averages of four parts (1 where none applies), weighted 0.30, 0.30, 0.20, 0.20, strict pass rate, counts by failure."""
    parts = {"tool_score": 0.30, "retrieval_score": 0.30, "grounding_score": 0.20, "completion_score": 0.20}
    mean = {p: F.coalesce(F.avg(p), F.lit(1.0)) for p in parts}
    overall = sum((w * mean[p] for p, w in parts.items()), F.lit(0.0))
    return cases.agg(F.count("*").alias("cases"), *[F.round(m, 6).alias(p) for p, m in mean.items()], F.round(overall, 6).alias("overall"), F.round(F.avg(F.col("failure").isNull().cast("double")), 6).alias("strict_pass"), *[F.count_if(F.col("failure") == f).alias(f"n_{f}") for f in ("tool", "retrieval", "hallucination", "incomplete")])


def variant_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per variant the mean of each metric that all of its rows have."""
    return rows.groupBy("variant").agg(F.count("*").alias("rows"), *[F.when(F.count(m) == F.count("*"), F.avg(m)).alias(m) for m in metrics])


def prefix_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of unit vectors that can reach the cosine `least`; vectors are rows (id, bucket, weight).

    Buckets are ordered by how many vectors they have, rare ones first. Of each vector only the first buckets count, up to
    where the rest's norm is under `least`: vectors without a common one there have a smaller product.
    """
    both = left.unionByName(right)
    size = both.groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("id").orderBy("_size", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    rest = 1 - F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(before), F.lit(0.0))
    heads = lambda v: v.join(size, F.col("bucket") == F.col("_b")).withColumn("_rest", rest).filter(F.col("_rest") >= least * least - 1e-9).select("id", "bucket")
    return heads(left).withColumnRenamed("id", "a").join(heads(right).withColumnRenamed("id", "b"), "bucket").select("a", "b").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs at `least` or over, exact on the candidates of `prefix_pairs`."""
    same = left is right
    left = written(left, "vectors")  # read several times, so computed once
    right = left if same else written(right, "vectors")
    pairs = written(prefix_pairs(left, right, least), "pairs")
    x = pairs.join(left.select(F.col("id").alias("a"), "bucket", F.col("weight").alias("wa")), "a")
    j = x.join(right.select(F.col("id").alias("b"), "bucket", F.col("weight").alias("wb")), ["b", "bucket"])
    return j.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity")).filter(F.col("similarity") >= least)


def near_duplicate_pairs(vectors: DataFrame, least: float = 0.92) -> DataFrame:
    """(a, b, similarity): pairs a < b of one table's vectors."""
    return similar_pairs(vectors, vectors, least).filter("a < b")


def nearest(new: DataFrame, known: DataFrame, least: float = 0.72) -> DataFrame:
    """(a, b, similarity): each new vector's most similar known one at `least` or over, ties by id."""
    order = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return similar_pairs(new, known, least).filter("a <> b").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def run_aggregate(results: DataFrame) -> DataFrame:
    """(measure, value): each metric's mean over the cases that have it, pass rate, latency by nearest rank, totals and counts.

    results: scores (map of doubles), passed, latency, tokens, cost, calls, steps, error.
    """
    late = values_at_ranks(results, [], "latency", {f"latency_p{int(100 * p)}": (p, nearest_rank(p)) for p in (0.5, 0.95, 0.99)})
    flat = {"pass_rate": F.avg(F.col("passed").cast("double")), "latency_mean": F.avg("latency")} | {n: F.sum(n) for n in ("tokens", "cost", "calls", "steps")}
    flat |= {"errors": F.count_if(F.col("error")), "valid": F.count_if(~F.coalesce(F.col("error"), F.lit(False)))}
    one = results.agg(*[c.cast("double").alias(n) for n, c in flat.items()])
    rows = lambda d: d.select(F.explode(F.create_map(*[x for n in d.columns for x in (F.lit(n), F.col(n))])).alias("measure", "value"))
    totals = rows(one).unionByName(rows(late))
    means = results.select(F.explode("scores").alias("measure", "value")).filter("value is not null").groupBy(F.concat(F.lit("mean_"), "measure").alias("measure")).agg(F.avg("value").alias("value"))
    return totals.unionByName(means)


def retrieval_monitor(traces: DataFrame, n: int = 200) -> DataFrame:
    """(measure, value) over the newest n traces: counts by status, average evidence, p95 latency at index floor(0.95 n).

    traces: trace_id, ts, status, evidence, latency.
    """
    some = traces.orderBy(F.col("ts").desc(), F.col("trace_id").desc()).limit(n)
    status = some.groupBy(F.concat(F.lit("status_"), "status").alias("measure")).agg(F.count("*").cast("double").alias("value"))
    average = some.agg(F.avg("evidence").alias("value")).select(F.lit("average_evidence").alias("measure"), "value")
    late = index_percentile(some, [], "latency", 0.95).select(F.lit("latency_p95").alias("measure"), F.col("value").cast("double").alias("value"))
    return status.unionByName(average).unionByName(late)


def suite_averages(metrics: DataFrame, names: list[str], by: str = "suite") -> DataFrame:
    """One row a suite: its cases, and the mean of each metric over the cases that have it."""
    return metrics.groupBy(by).agg(F.count("*").alias("cases"), *[F.avg(n).alias(n) for n in names])


def variant_benchmark(cases: DataFrame) -> DataFrame:
    """(variant, cases, recall_at_5, recall_at_10, mrr): texts ranked by the share of the query's tokens that they hold.

    cases: variant, case_id, query, doc, text, place, relevant; ties go to the earlier place.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(?U)[\w\u207a]+"), F.lit(0)))
    share = F.size(F.array_intersect(tokens("query"), tokens("text"))) / F.greatest(F.size(tokens("query")), F.lit(1))
    order = Window.partitionBy("variant", "case_id").orderBy(F.col("_share").desc(), "place")
    ranked = cases.withColumn("_share", share).withColumn("rank", F.row_number().over(order)).filter("relevant")
    first = ranked.groupBy("variant", "case_id").agg(F.min("rank").alias("rank"))
    return first.groupBy("variant").agg(F.count("*").alias("cases"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in (5, 10)], F.avg(1 / F.col("rank")).alias("mrr"))


#: Words of a question that don't count.
QUESTION_WORDS = """的 了 是 在 什么 怎么 如何 哪些 请 帮 我 你 吗 呢 吧 啊 the a an is are was were what how why when where which please help can could would should""".split()
_HAN = "[\u4e00-\u9fff]"


def _words(text: Column, marks: str) -> Column:
    """Words between blanks, without the marks at their ends."""
    cut = rf"^[{marks}]+|[{marks}]+$"
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, cut, "")), lambda w: w != "")


def _grams(text: Column, least: int = 2) -> Column:
    """Runs of two and three characters of each run of Han characters that has at least so many."""
    blocks = F.regexp_extract_all(text, F.lit(rf"{_HAN}{{{least},}}"), F.lit(0))
    some = lambda b, n: F.when(F.length(b) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - n + 1, F.lit(1))), lambda i: F.substr(b, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(blocks, lambda b: F.concat(some(b, 2), some(b, 3))))


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of an answer's numbers, quotes and capitalised words that the context holds; without any, of its sentences of which a fifth of the key words are held."""
    held = F.lower(context)
    inside = lambda x: F.contains(held, x)
    numbers = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?U)\b\d+(?:\.\d+)?%?\b"), F.lit(0)))
    quotes = F.array_distinct(F.regexp_extract_all(answer, F.lit('"([^"]+)"'), F.lit(1)))
    names = F.array_distinct(F.transform(F.filter(_words(answer, r",.!?;:()\[\]{}\""), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}")), F.lower))
    claims = F.concat(F.transform(numbers, F.lower), F.transform(quotes, F.lower), names)
    sentences = F.filter(F.transform(F.split(answer, r"[.!?\n]"), F.trim), lambda x: x != "")
    key = lambda x: F.concat(F.filter(F.transform(F.split(F.lower(x), r"\s+"), lambda w: F.translate(w, ".,!?;:()[]", "")), lambda w: F.length(w) > 3), F.filter(_grams(F.lower(x)), inside))
    told = F.filter(sentences, lambda x: (F.size(key(x)) == 0) | (F.size(F.filter(key(x), inside)) >= 0.2 * F.size(key(x))))
    rest = F.when(F.size(sentences) == 0, 1.0).otherwise(F.size(told) / F.size(sentences))
    share = F.when(F.size(claims) > 0, F.size(F.filter(claims, inside)) / F.size(claims)).otherwise(rest)
    return F.when((F.coalesce(answer, F.lit("")) == "") | context.isNull(), 0.0).otherwise(share)


def relevancy(question: Column, answer: Column) -> Column:
    """Share of a question's words, Han runs and their parts that the answer holds; 1 where nothing is asked for."""
    q, a = F.lower(question), F.lower(answer)
    stop = F.array(*[F.lit(w) for w in QUESTION_WORDS])
    words = F.filter(_words(q, r".,!?;:'()\[\]"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    blocks = F.regexp_extract_all(q, F.lit(f"{_HAN}{{2,}}"), F.lit(0))
    asked = F.array_distinct(F.concat(words, blocks, F.filter(_grams(q), lambda g: ~F.array_contains(stop, g))))
    share = F.when(F.size(asked) == 0, 1.0).otherwise(F.size(F.filter(asked, lambda w: F.contains(a, w))) / F.size(asked))
    return F.when((F.coalesce(question, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == ""), 0.0).otherwise(share)


def token_f1(answer: Column, expected: Column) -> Column:
    """F1 of the two sets of words: runs of a-z, and what stands between blanks and stops, two characters at least."""
    units = lambda c: F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(r"(?U)\b[a-z]+\b"), F.lit(0)), F.filter(F.split(c, r"(?U)[\s,，。.!?！？、；;：:]+"), lambda w: F.length(w) > 1)))
    x, y = units(F.lower(F.trim(answer))), units(F.lower(F.trim(expected)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(0.0)


def correctness(answer: Column, expected: Column) -> Column:
    """1 for equal texts, else 0.4 F1 of their words and 0.4 of their longest common subsequence's share."""
    x, y = F.lower(F.trim(answer)), F.lower(F.trim(expected))
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(expected, F.lit("")) == "")
    return F.when(empty, 0.0).when(x == y, 1.0).otherwise(0.4 * token_f1(answer, expected) + 0.4 * longest_common_share(x, y))


def longest_common_share(a: Column, b: Column) -> Column:
    """Longest common subsequence of characters over the longer text's length; each row's table is one row wide."""
    return F.pandas_udf(_longest_common_share, "double")(a, b)


def _longest_common_share(a: pd.Series, b: pd.Series) -> pd.Series:

    def one(x: str | None, y: str | None) -> float:
        """By rows of bits: a bit stands for a character of y, and is cleared where the subsequence grows."""
        x, y = x or "", y or ""
        if not x or not y:
            return float(x == y)
        places: dict[str, int] = {}
        for k, c in enumerate(y):
            places[c] = places.get(c, 0) | 1 << k
        full = (1 << len(y)) - 1
        row = full
        for c in x:
            hit = row & places.get(c, 0)
            row = (row + hit | row - hit) & full
        return (len(y) - row.bit_count()) / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def arguments_match(expected: Column, actual: Column, mode: Column, ignored: Column, tolerance: Column) -> Column:
    """Nested JSON arguments: `subset` or `exact`, without the ignored fields (comma-joined), numbers within a tolerance."""
    return F.pandas_udf(_arguments_match, "boolean")(expected, actual, mode, ignored, tolerance)


def _arguments_match(expected: pd.Series, actual: pd.Series, mode: pd.Series, ignored: pd.Series, tolerance: pd.Series) -> pd.Series:

    def same(x, y, exact: bool, out: set, tol: float) -> bool:
        if isinstance(x, dict) and isinstance(y, dict):
            keys = x.keys() - out
            return (not exact or keys == y.keys() - out) and all(k in y and same(x[k], y[k], exact, out, tol) for k in keys)
        if isinstance(x, list) and isinstance(y, list):
            return len(x) == len(y) and all(same(p, q, exact, out, tol) for p, q in zip(x, y, strict=True))
        if isinstance(x, int | float) and isinstance(y, int | float) and not isinstance(x, bool) and not isinstance(y, bool):
            return abs(x - y) <= tol
        return x == y

    return pd.Series([same(json.loads(x), json.loads(y), m == "exact", set((i or "").split(",")), float(t)) for x, y, m, i, t in zip(expected, actual, mode, ignored, tolerance, strict=True)])
