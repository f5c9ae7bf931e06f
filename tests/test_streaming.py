"""Keyed state across batches: a stream stopped and started again gives what the batch operator gives for all changes."""

import random

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.operators import facts
from corpusmill.streaming import jobs

CHANGES = "tenant_id long, user_id long, subject string, predicate string, value string, source_type string, confidence double, importance double, ts timestamp"


def some_changes():
    """In order of time; four days of quiet in the middle, and a late user that moves the watermark."""
    r = random.Random(5)
    out = []
    for k in range(240):
        at = pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=11 * k) + pd.Timedelta(days=4 if k >= 160 else 0)
        out.append((1, r.randrange(8 if k < 100 else 6), "self", r.choice("pq"), r.choice("xyz"), r.choice(["user_explicit", "web", "clinician", "import"]), r.choice([None, 0.5, 0.9]), r.random(), at.to_pydatetime()))
    return out


def test_facts_over_batches_and_a_restart(spark, tmp_path):
    rows = some_changes()
    cuts = [0, 50, 90, 160, 200, 240]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], CHANGES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        # each turn is a new query from the checkpoint of the one before
        stream = jobs.facts_stream(spark.readStream.schema(CHANGES).parquet(f"file://{tmp_path}/in"), days=2)
        got = jobs.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    moves = got.collect()
    now = pd.Timestamp(max(r[-1] for r in rows)) - pd.Timedelta(minutes=10)
    batch = facts.merge_changes(spark.createDataFrame(rows, CHANGES), 2)
    names = [*facts.KEY, "version", "value", "status", "sources", "valid_from", "confidence", "importance", "expires_at"]
    want = batch.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") <= F.lit(now.to_pydatetime())), "expired").otherwise(F.col("status")))
    mine = jobs.current_facts(got)
    assert sorted(map(str, mine.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    ends = lambda df: {(*[r[c] for c in facts.KEY], r.version): r.valid_to for r in df.filter("status = 'superseded'").collect()}
    assert ends(mine) == ends(want) and len(ends(mine)) > 20
    assert any(r.status == "expired" for r in moves) and any(r.change == "added" for r in moves)


def test_expiry_over_a_restart(spark, tmp_path):
    schema = "fact_id long, updated_at timestamp"
    ts = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    for rows in ([(1, ts(0)), (2, ts(5))], [(1, ts(50)), (3, ts(60))], [(4, ts(200))], [(5, ts(201))]):
        spark.createDataFrame([(k, t.to_pydatetime()) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = jobs.expire_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        got = jobs.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    said = {(r.key, r.last_ms) for r in got.filter("status = 'expired'").collect()}
    ms = lambda m: int(ts(m).timestamp() * 1000)
    assert said == {(1, ms(50)), (2, ms(5)), (3, ms(60))} and got.filter("status = 'active'").count() == 6


def test_health_percentile_is_exact(spark, tmp_path):
    """More distinct latencies than an approximate percentile holds; a null one counts as a call."""
    from corpusmill.plans import catalog

    rows = spark.range(120_000).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(1_704_067_200 + F.col("id") % 80_000)).alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_type"), F.when(F.col("id") % 1000 != 7, F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("value"),
    )
    late = spark.range(1).selectExpr("-1L as event_id", "timestamp_seconds(1704067200 + 200000) as ts", "1L as user_id", "'view' as event_type", "0D as value")
    rows.unionByName(late).coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = {(x.tool): (x.calls, x.p95, x.state) for x in catalog.QUERIES["st3_health_stream"](spark, str(tmp_path)).collect()}
    for tool, state in (("error", "degraded"), ("view", "healthy")):
        values = [x.value for x in rows.filter(F.col("event_type") == tool).collect()]
        held = sorted(v for v in values if v is not None)
        assert got[tool] == (len(values), held[-(-len(held) * 95 // 100) - 1], state)
