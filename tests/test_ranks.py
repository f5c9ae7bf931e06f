"""Values at ranks against sorting; bounds that a rough sketch gives are made wider until they hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as ev


@pytest.mark.parametrize("accuracy", [10_000, 50, 2])
def test_values_at_ranks(spark, accuracy):
    r = random.Random(accuracy)
    rows = [(k % 5 or None, r.choice([r.random() * 10, float(r.randrange(4)), -1e300, None])) for k in range(4000)] + [(9, 7.0)] * 500 + [(8, 1.5), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    ranks = {f"n{i}": (p, ev.nearest_rank(p)) for i, p in enumerate(shares)} | {f"i{i}": (p, ev.index_rank(p)) for i, p in enumerate(shares)}
    got = {x.g: x for x in ev.values_at_ranks(df, ["g"], "v", ranks, accuracy).collect()}
    held = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    assert set(got) == set(held)
    for g, vs in held.items():
        vs.sort()
        for i, p in enumerate(shares):
            assert got[g][f"n{i}"] == vs[max(1, math.ceil(len(vs) * p)) - 1] and got[g][f"i{i}"] == vs[min(len(vs) - 1, math.floor(len(vs) * p))]
    one = ev.values_at_ranks(df, [], "v", {"m": (0.5, ev.nearest_rank(0.5))}, accuracy).collect()
    every = sorted(v for _, v in rows if v is not None)
    assert [x.m for x in one] == [every[math.ceil(len(every) / 2) - 1]]
    assert ev.values_at_ranks(df.limit(0), ["g"], "v", ranks).collect() == []
    assert [x.m for x in ev.values_at_ranks(df.limit(0), [], "v", {"m": (0.5, ev.nearest_rank(0.5))}).collect()] == [None]


def test_no_window_holds_a_group(spark):
    """What is put in order is a small part of the rows, ties aside."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    q = ev.values_at_ranks(df, ["g"], "v", {"p": (0.95, ev.nearest_rank(0.95))})
    assert abs(q.first().p - 0.95) < 0.01
    lo, hi = df.agg(F.percentile_approx("v", F.array(F.lit(0.9498), F.lit(0.9502)), 10_000).alias("q")).first().q
    assert df.filter(F.col("v").between(lo, hi)).count() < 400


def test_ideal_gain_by_counts_of_grades(spark):
    """Grades that begin, end and lie across place k, against sorted grades; items of one grade leave the tasks as a count."""
    import math

    from corpusmill.operators import evaluation as ev

    grades = {1: [3] * 2 + [2] * 4 + [1] * 9 + [0] * 3, 2: [1], 3: [2] * 12, 4: [0]}
    rel = spark.createDataFrame([(q, i, g) for q, gs in grades.items() for i, g in enumerate(gs)], "query_id long, item long, grade int").repartition(3)
    ranked = spark.createDataFrame([(q, 1, 0) for q in grades], "query_id long, rank int, item long")
    for k, gain, discount in ((5, "linear", "standard"), (3, "exponential", "late"), (20, "binary", "late")):
        div = (lambda r: math.log2(r + 1)) if discount == "standard" else (lambda r: math.log2(r) if r > 1 else 1.0)
        value = {"linear": float, "exponential": lambda g: 2.0**g - 1, "binary": lambda g: float(g > 0)}[gain]
        got = {r.query_id: r for r in ev.ranking_metrics(ranked, rel, k, discount=discount, gain=gain).collect()}
        assert got.keys() == {1, 2, 3}
        for q in got:
            best = sorted((g for g in grades[q] if g), reverse=True)[:k]
            want = value(grades[q][0]) / div(1) / sum(value(g) / div(r) for r, g in enumerate(best, 1))
            assert abs(got[q].ndcg - want) < 1e-12 and abs(got[q].recall - 1 / sum(g > 0 for g in grades[q])) < 1e-12
    plan = ev.ranking_metrics(ranked, rel, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "grade" in plan and plan.count("row_number") == 1  # the ranked items' own; relevance is not numbered
