"""A stored index for approximate nearest vectors: product quantization, then exact scores of the best candidates.

Vectors are cut into parts of about four dimensions. Each part has a codebook of up to 256 centres, fitted on a bounded hashed sample,
and a chunk is stored as a byte for each part. A query is compared with all codes by its tables of products with the
centres (asymmetric distances): a sum of one table entry a byte, no vector of a chunk is read. Only the full vectors of a
query's best candidates are joined and scored exactly.

The index is three Parquet tables below a folder: codebooks (a row a centre), codes and vectors (a row a chunk). A null vector, or one of
another size than the first of the sample, is not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import retrieval as rt

CENTRES = 256


def parts_of(size: int, width: int) -> list[tuple[int, int]]:
    """Ranges of dimensions, about `width` each."""
    edges = np.linspace(0, size, max(1, -(-size // width)) + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def centres_of(rows: np.ndarray, most: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means; a centre that loses its rows stays where it is."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:most]].copy()
    for _ in range(rounds):
        near = closest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def build_index(chunks: DataFrame, top: str, width: int = 4, sample: int = 20_000) -> None:
    """Writes the index of chunks (chunk_id, embedding) below `top`. Codebooks are fitted on about `sample` rows; every row is indexed."""
    spark, held = chunks.sparkSession, chunks.select("chunk_id", "embedding").filter("embedding is not null")
    some = rt.hashed_sample(held, "chunk_id", sample, held.count()).toPandas()["embedding"].tolist()
    size = len(some[0]) if some else 0
    unit = rt.unit_rows([v for v in some if len(v) == size])
    books = [(p, a, b, c, centre.tolist()) for p, (a, b) in enumerate(parts_of(size, width)) if size for c, centre in enumerate(centres_of(unit[:, a:b], CENTRES))]
    spark.createDataFrame(books, "part int, first int, last int, code int, centre array<double>").coalesce(1).write.parquet(f"{top}/codebooks")
    held.filter(F.size("embedding") == size).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).write.option("compression", "zstd").parquet(f"{top}/vectors")
    shape = [((a, b), np.array([c for p, _, _, _, c in books if p == q])) for q, (a, b) in enumerate(parts_of(size, width)) if size]

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = rt.unit_rows(b["embedding"].tolist())
            codes = np.stack([closest(m[:, x:y], c) for (x, y), c in shape], 1).astype(np.uint8) if len(b) else np.zeros((0, len(shape)), np.uint8)
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "codes": [r.tobytes() for r in codes]})

    spark.read.parquet(f"{top}/vectors").mapInPandas(job, "chunk_id long, codes binary").write.option("compression", "zstd").parquet(f"{top}/codes")


def read_codebooks(spark: SparkSession, top: str) -> list[tuple[int, int, np.ndarray]]:
    """(first, last, centres) of each part: at most 256 rows a part."""
    books = spark.read.parquet(f"{top}/codebooks").orderBy("part", "code").toPandas()
    return [(int(g["first"].iloc[0]), int(g["last"].iloc[0]), np.array(g["centre"].tolist())) for _, g in books.groupby("part")]


def code_scores(ids: np.ndarray, unit: np.ndarray, codes: DataFrame, books: list, most: int) -> DataFrame:
    """(query_id, chunk_id, score): each batch's best `most` chunks of a block of queries by sums of table entries."""
    tables = [(unit[:, a:b] @ c.T).astype(np.float32) for a, b, c in books]

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            key, rows = b["chunk_id"].to_numpy(), np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1)
            order = np.argsort(key, kind="stable")
            key, rows = key[order], rows[order]
            for q in range(0, len(ids), 64):
                s = np.zeros((min(64, len(ids) - q), len(key)), np.float32)
                for p, table in enumerate(tables):
                    s += table[q : q + 64, rows[:, p]]
                best = rt.best_columns(s, most)
                yield pd.DataFrame({"query_id": np.repeat(ids[q : q + 64], best.shape[1]), "chunk_id": key[best.ravel()], "score": np.take_along_axis(s, best, 1).ravel().astype(float)})

    return codes.mapInPandas(job, "query_id long, chunk_id long, score double")


def candidates(queries: DataFrame, top: str, most: int, most_queries: int = 1024) -> DataFrame | None:
    """(query_id, chunk_id): each query's best `most` chunks by their codes; None where the index or the queries are empty."""
    spark = queries.sparkSession
    books = read_codebooks(spark, top)
    if not books:
        return None
    size = books[-1][1]
    codes = spark.read.parquet(f"{top}/codes")
    blocks = (code_scores(ids, unit, codes, books, most) for ids, unit in rt.query_blocks(queries.filter(F.size("embedding") == size), most_queries))
    ranked = rt.best_of_blocks(blocks, most)
    return None if ranked is None else ranked.select("query_id", "chunk_id")


def search_index(queries: DataFrame, top: str, k: int = 10, most: int = 40, most_queries: int = 1024) -> DataFrame:
    """(query_id, route, rank, chunk_id, score): top k by the exact cosine among the best `most` candidates of each query."""
    found = candidates(queries, top, most, most_queries)
    vectors = queries.sparkSession.read.parquet(f"{top}/vectors")
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id long, chunk_id long")
    both = found.join(vectors, "chunk_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    return rt.rank_routes(both.select("query_id", F.lit("dense").alias("route"), "chunk_id", F.round(rt.cosine(F.col("embedding"), F.col("_q")), 9).alias("score")), k)


def dense_topk_ann(queries: DataFrame, chunks: DataFrame, top: str, k: int = 10, most: int = 40) -> DataFrame:
    """Top k through an index made below `top` for this once."""
    build_index(chunks, top)
    return search_index(queries, top, k, most)
