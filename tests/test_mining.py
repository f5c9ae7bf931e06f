"""Candidate mining and connected components against plain versions."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import mining


def test_components_are_those_of_a_walk(spark):
    """Random links, a long chain and a star of three thousand."""
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(3000, 0, -1)] + [(7, 7), (9000, 400), (400, 9000)]
    got = {x.id: x.root for x in mining.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        stack = [] if v in want else [v]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = v
                stack += near[x]
    assert got == want
    assert mining.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_best_earlier_in_blocks(spark):
    """Blocks of queries give what one block gives, and ties go to the earliest."""
    r = random.Random(3)
    rows = [(k, k % 5, [float(r.randrange(3)) for _ in range(6)]) for k in range(200)] + [(300, 1, None)]
    df = spark.createDataFrame(rows, "id long, seq long, vector array<double>").repartition(3)
    want = {}
    for i, t, v in rows[:200]:
        earlier = [(-sum(a * b for a, b in zip(v, w, strict=True)), u, j) for j, u, w in rows[:200] if (u, j) < (t, i)]
        if earlier:
            s, _, j = min(earlier)
            want[i] = (j, -s)
    for most in (4096, 50):
        assert {x.id: (x.match, x.similarity) for x in mining.best_earlier(df, df, most).collect()} == want
    assert mining.best_earlier(df.limit(0), df).collect() == []


def test_candidates(spark):
    schema = "id long, created_at timestamp, query string, failure double, status string, total_tokens long"
    texts = ["how do I store this medicine safely", "How do I store this medicine safely?", "how do I store this medicine safely please", "how do I store this medicine safely please now", "zq xw kj", None, "", "rejected text", "ZQ xw kj!"]
    rows = [(k, None, t, 7.0 if k == 0 else None, "error", 60_000) for k, t in enumerate(texts)]
    requests = spark.createDataFrame(rows, schema)
    got = {x.id: x for x in mining.mine_candidates(requests).collect()}
    assert [got[k].outcome for k in range(9)] == ["novel", "existing", "duplicate", "duplicate", "novel", "novel", "existing", "novel", "existing"]
    assert got[1].match == 0 and got[8].match == 4 and got[6].match == 5 and len({got[k].cluster_key for k in range(4)}) == 1 and got[4].cluster_key == got[8].cluster_key != got[0].cluster_key
    assert got[0].breakdown.failure == 1.0 == got[0].breakdown.cost and got[0].breakdown.novelty == 1.0 and got[2].score is None
    assert got[0].score == round(0.3 + 0.15 * 0.5 + 0.15 + 0.1 * 0.5 + 0.15 * 0.3 + 0.15, 4)
    known = spark.createDataFrame([(100, None, texts[0], "old-key", "pending"), (101, None, "rejected text", "gone", "rejected"), (102, None, "rejected texts", "gone", "rejected")], "id long, created_at timestamp, query string, cluster_key string, status string")
    got = {x.id: x for x in mining.mine_candidates(requests.drop("failure"), known).collect()}
    assert got[0].outcome == "existing" and got[0].match == 100 and got[2].match == 100 and got[3].cluster_key == "old-key" and got[7].outcome == "existing" and got[7].match == 101
    assert mining.mine_candidates(requests.limit(0)).collect() == []
    assert mining.mine_candidates(requests.filter(F.col("id") == 4)).first().outcome == "novel"
