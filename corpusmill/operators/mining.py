"""Candidate mining: repeated requests by their hash, the most similar earlier one by blocks, a score, and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators.tables import written

#: What the parts of a candidate's score weigh, and what a part counts that a request does not give.
WEIGHTS = {"failure": 0.30, "business_value": 0.15, "novelty": 0.15, "difficulty": 0.10, "safety": 0.15, "cost": 0.15}
GIVEN = {"failure": "failure", "business_value": "business_value", "difficulty": "difficulty_score", "safety": "safety_score", "cost": "cost_score"}
ABSENT = {"business_value": 0.5, "difficulty": 0.5, "safety": 0.3}
FAILED, NOT_FAILED, TOKENS = ("failed", "error"), 0.4, 6000
SAME, NEAR = 0.92, 0.72


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root): the least id that links (a, b) lead to, for all ids in links. No vertex's neighbours meet in one task.

    Rounds of two steps: each vertex sends its larger neighbours, then its smaller ones, to the least among them, until nothing moves; each
    round is a written table, and takes joins on minima, which Spark can split where a vertex has many neighbours.
    """
    told = [F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))]  # of a table of distinct links
    state, edges = None, written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_v")).agg(F.min("b").alias("_m")).select("_v", F.least("_v", "_m").alias("_m"))
        large = both.join(least, F.col("a") == F.col("_v")).filter("b > a and b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("_v")).agg(F.min("b").alias("_m"))
        small = large.join(least, F.col("a") == F.col("_v")).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        after = written(small.unionByName(least.select(F.col("_v").alias("a"), F.col("_m").alias("b"))).distinct(), "links")
        before, state, edges = state, after.agg(*told).first(), after
        if state == before:
            roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def dense_vectors(texts: DataFrame, size: int = 128) -> DataFrame:
    """texts' columns and `vector`, the hashed units of `normalized` as an array; a text without units has none."""
    units = texts.select("id", F.explode(tx.hashed_units(F.col("normalized"))).alias("unit"))
    counts = units.groupBy(F.col("id").alias("_i"), tx.hash_bucket(F.col("unit"), size).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    rows = counts.groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))  # at most `size` buckets
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, v: s + v * v))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0.0)) / norm)
    return texts.join(rows.select("_i", vector.alias("vector")), F.col("id") == F.col("_i"), "left").drop("_i")


def best_earlier(asked: DataFrame, pool: DataFrame, most_queries: int = 4096) -> DataFrame:
    """(id, match, similarity): for each row of `asked` the most similar earlier row of `pool`, ties to the earliest.

    Both have id, seq (when, as a number) and vector; earlier is by (seq, id). Blocks of queries go to the tasks, each task multiplies
    them with its rows and hands on a row a query, so no pair leaves a task.
    """
    a = asked.select("id", "seq", "vector").filter("vector is not null")
    n = a.count()
    parts = max(1, -(-n // most_queries))

    def job_of(block: pd.DataFrame):
        ids, seqs = block["id"].to_numpy(), block["seq"].to_numpy()
        m = np.array(block["vector"].tolist())

        def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, where, when = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                b = b.sort_values(["seq", "id"])
                i, t, v = b["id"].to_numpy(), b["seq"].to_numpy(), np.array(b["vector"].tolist())
                for x in range(0, len(ids), 256):
                    y = slice(x, x + 256)
                    s = np.round(m[y] @ v.T, 6)
                    s[~((t[None] < seqs[y, None]) | (t[None] == seqs[y, None]) & (i[None] < ids[y, None]))] = -1
                    at = s.argmax(1)
                    top = s[np.arange(len(s)), at]
                    better = (top > best[y]) | (top == best[y]) & ((t[at] < when[y]) | (t[at] == when[y]) & (i[at] < where[y]))
                    rows = np.arange(len(ids))[y][better]
                    best[rows], where[rows], when[rows] = top[better], i[at[better]], t[at[better]]
            got = best >= 0
            yield pd.DataFrame({"id": ids[got], "match": where[got], "similarity": best[got], "seq": when[got]})

        return job

    found = None
    for part in range(parts):
        block = (a if parts == 1 else a.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).toPandas()
        rows = pool.select("id", "seq", "vector").filter("vector is not null").mapInPandas(job_of(block), "id long, match long, similarity double, seq long")
        found = rows if found is None else found.unionAll(rows)
    best = F.max(F.struct("similarity", (-F.col("seq")).alias("_s"), (-F.col("match")).alias("_m")))
    return found.groupBy("id").agg(best.alias("x")).select("id", (-F.col("x._m")).alias("match"), F.col("x.similarity").alias("similarity"))


def candidate_score(similarity: Column, has: set[str]) -> tuple[Column, Column]:
    """The weighted score, 4 digits, and its parts within 0 and 1; `has`: the columns that the requests give."""
    given = {k: F.col(c).cast("double") if c in has else F.lit(None).cast("double") for k, c in GIVEN.items()}
    failed = F.when(F.col("status").isin(*FAILED), 1.0).otherwise(NOT_FAILED) if "status" in has else F.lit(NOT_FAILED)
    tokens = F.least(F.lit(1.0), F.coalesce(F.col("total_tokens").cast("double"), F.lit(0.0)) / TOKENS) if "total_tokens" in has else F.lit(0.0)
    value = {k: F.coalesce(given[k], F.lit(v)) for k, v in ABSENT.items()} | {"failure": F.coalesce(given["failure"], failed), "cost": F.coalesce(given["cost"], tokens), "novelty": 1 - similarity}
    parts = {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), value[k])) for k in WEIGHTS}
    total = F.round(sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), 9)  # a half in the fifth digit stays one
    return F.round(total, 4), F.struct(*[p.alias(k) for k, p in parts.items()])


def mine_candidates(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, outcome, match, similarity, cluster_key, score, breakdown of each request.

    In the order of (created_at, id): a request whose normalized text came before is `existing`, its match the first one. The others are
    compared with all earlier distinct texts: from a similarity of 0.92 on a `duplicate`, from 0.72 on `clustered`, else `novel`; links of
    0.72 or more, of duplicates too, make clusters, named by the known candidate's key or the hash of the earliest text. Only clustered and
    novel requests get a score. A text without any unit has nothing near it.

    requests: id (long, once), created_at, query, and what they have of failure, status, business_value, difficulty_score, safety_score,
    cost_score, total_tokens. known: id, created_at, query, cluster_key, status of candidates there are, before all requests; rejected
    ones only count for their hash.
    """
    spark = requests.sparkSession
    when = F.coalesce(F.col("created_at").cast("timestamp").cast("double") * 1_000_000, F.lit(-(2.0**62))).cast("long") if dict(requests.dtypes)["created_at"] not in ("int", "bigint") else F.coalesce(F.col("created_at").cast("long"), F.lit(-(2**62)))
    mine = requests.select("id", when.alias("seq"), tx.normalize_query(F.coalesce("query", F.lit(""))).alias("normalized"), F.lit(True).alias("new"), F.lit(None).cast("string").alias("cluster_key"), F.lit(True).alias("open"))
    pool = mine
    if known is not None:
        there = known.select("id", F.lit(-(2**63) + 1).alias("seq"), tx.normalize_query(F.coalesce("query", F.lit(""))).alias("normalized"), F.lit(False).alias("new"), "cluster_key", (F.coalesce("status", F.lit("")) != "rejected").alias("open"))
        pool = pool.unionByName(there)
    pool = written(pool.withColumn("hash", F.sha2("normalized", 256)), "requests")
    firsts = pool.groupBy("hash").agg(F.min(F.struct("seq", "id"))["id"].alias("owner"))
    owned = written(pool.join(firsts, "hash"), "owned")
    own = written(dense_vectors(owned.filter("id = owner")), "distinct")
    links = written(best_earlier(own.filter("new"), own.filter("open")), "nearest")
    near = links.filter(F.col("similarity") >= NEAR).select(F.col("id").alias("a"), F.col("match").alias("b"))
    groups = connected_components(near)
    lead = own.join(groups.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).groupBy("root").agg(F.min(F.struct("seq", "id", "hash", "cluster_key")).alias("x"))
    named = groups.join(lead.select("root", F.coalesce("x.cluster_key", F.substring("x.hash", 1, 16)).alias("_key")), "root").select(F.col("id").alias("_g"), "_key")
    detail = requests.select(F.col("id").alias("_d"), *[c for c in {*GIVEN.values(), "status", "total_tokens"} if c in requests.columns])
    rows = owned.filter("new").join(links.select(F.col("id").alias("_l"), "match", "similarity"), F.col("id") == F.col("_l"), "left").join(named, F.col("owner") == F.col("_g"), "left").join(detail, F.col("id") == F.col("_d"))
    existing, similarity = F.col("id") != F.col("owner"), F.coalesce("similarity", F.lit(0.0))
    rows = rows.join(owned.select(F.col("id").alias("_o"), F.col("cluster_key").alias("_theirs"), F.col("hash").alias("_hash")), F.col("owner") == F.col("_o"))
    score, parts = candidate_score(similarity, set(requests.columns))
    outcome = F.when(existing, "existing").when(similarity >= SAME, "duplicate").when(similarity >= NEAR, "clustered").otherwise("novel")
    rows = rows.withColumn("outcome", outcome).withColumn("_made", F.col("outcome").isin("clustered", "novel"))
    return rows.select(
        "id", "outcome", F.when(existing, F.col("owner")).otherwise(F.col("match")).alias("match"), F.when(existing, 1.0).otherwise(similarity).alias("similarity"),
        F.coalesce("_key", "_theirs", F.substring("_hash", 1, 16)).alias("cluster_key"), F.when(F.col("_made"), score).alias("score"), F.when(F.col("_made"), parts).alias("breakdown"),
    )
