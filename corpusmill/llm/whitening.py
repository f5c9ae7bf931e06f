"""Embedding whitening by shifted CholeskyQR: Gram passes over the rows, triangular factors on the driver, one small SVD.

The vectors are taken on a grid, as whole numbers x, and centred at their exact mean. A pass sums Q'Q of the centred rows
Q = A inv(R) over tasks, in which each batch is solved against the triangular R so far; the d x d sum's Cholesky factor is
put before R. The first factor has its Gram matrix shifted by a multiple of the rounding error, so it exists at any
condition; the second is shifted only where it has to be; the third takes what is left, by its symmetric root where the
rows don't span all dimensions. Then A'A = R'R to rounding, and the SVD of R gives the components and their spread.
Nothing that grows with the rows leaves the tasks: a pass gives d (d + 1) / 2 cells a task, summed by cell in a shuffle.

Defined cases: a null vector, or one with a null or non-finite entry, is dropped, as is one shorter than the longest (its missing
entries count as null); rows repeated with one id, or without one, stay rows each; whole numbers beyond 2^62 are cut there; a
deviation beyond 64 bits is null; a direction without spread (relative 1e-10) is no component, so equal vectors, one vector or an
empty table give an empty result; only the key and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

CELLS = "i int, j int, v double"
#: Rows that a task works on at once.
ROWS = 8192


@dataclass
class Grid:
    """Sums of the whole numbers: rows, and each dimension's sum."""

    n: int
    sums: list[int]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Each dimension's mean as a whole number and a rest."""
        floor = [s // self.n for s in self.sums]
        return np.array(floor, np.int64), np.array([float(Fraction(s - f * self.n, self.n)) for s, f in zip(self.sums, floor, strict=True)])


def on_grid(rows: DataFrame, key: str, vector: str, steps: int, shift: int) -> DataFrame:
    """vec_id, x (whole numbers) of the rows whose vectors are whole, as a written table."""
    kind = rows.schema[key].dataType.simpleString()
    least, most = -(2.0**62), 2.0**62

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.list_value_length(lists)
            flat = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
            good = lists.is_valid().to_numpy(zero_copy_only=False).copy()
            good[row[~np.isfinite(flat)]] = False
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(steps * flat[good[row]]), least, most).astype(np.int64) + shift
            kept = pc.fill_null(size, 0).filter(pa.array(good)).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(at), pa.array(x))], ["vec_id", "x"])

    table = written(rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(job, f"vec_id {kind}, x array<bigint>"), "whitening-rows")
    longest = table.agg(F.max(F.size("x"))).first()[0] or 0
    return table.filter(F.size("x") == longest) if longest else table.limit(0)


def matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            b = batch.slice(a, ROWS)
            yield b, b.column(column).flatten().to_numpy().reshape(len(b), -1)


def sums_of(table: DataFrame) -> Grid:
    """Exact sums of the rows, dimension by dimension."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in matrices(batches):
            low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)  # no overflow in a batch
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, x.shape[1]), pa.int32()), pa.array([len(x), *low]), pa.array([0, *high])], ["i", "low", "high"])

    cells = table.select("x").mapInArrow(job, "i int, low long, high long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "high")])
    found = {r["i"]: int(r["low"]) + (int(r["high"]) << 32) for r in cells.collect()}  # a row a dimension
    n = found.pop(-1, 0)
    return Grid(n, [found[i] for i in sorted(found)])


def gram(table: DataFrame, grid: Grid, solve: np.ndarray | None, project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Q'Q and the columns' sums of Q: the centred rows, solved against the upper triangular `solve`, or times `project`."""
    floor, rest = grid.centre()
    d = project.shape[1] if project is not None else len(floor)
    upper = np.triu_indices(d)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((d, d)), np.zeros(d)
        for _, x in matrices(batches):
            q = (x - floor) - rest
            if solve is not None:
                q = solved(q, solve)
            elif project is not None:
                q = q @ project
            total += q.T @ q
            sums += q.sum(0)
        i, j = np.concatenate([upper[0], np.full(d, -1)]), np.concatenate([upper[1], np.arange(d)])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([total[upper], sums]))], ["i", "j", "v"])

    out, sums = np.zeros((d, d)), np.zeros(d)
    for r in table.select("x").mapInArrow(job, CELLS).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row a cell
        if r["i"] < 0:
            sums[r["j"]] = r["v"]
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out, sums


def solved(a: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """a inv(upper), by substitution, a column after the other."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix; shifted by a multiple of its rounding error if asked for, or where it needs to be."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(float(np.linalg.norm(g, 2)), np.finfo(float).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def last_factor(g: np.ndarray) -> np.ndarray:
    """Of the rows that two passes have made orthogonal: Cholesky, or the symmetric root where they don't span all dimensions."""
    values, vectors = np.linalg.eigh(g)
    if values[0] > 0.5:
        return np.linalg.cholesky(g).T
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


@dataclass
class Whitening:
    """Components as columns, in falling order of their eigenvalues, with what all eigenvalues sum to."""

    grid: Grid
    components: np.ndarray
    values: np.ndarray
    trace: float

    def map(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit(table: DataFrame, components: int) -> Whitening | None:
    """The whitening of a table of x; None where it has no rows."""
    grid = sums_of(table)
    if not grid.n:
        return None
    r = np.eye(len(grid.sums))
    for k in range(3):
        g, _ = gram(table, grid, r if k else None)
        r = (factor(g, grid.n, k == 0) if k < 2 else last_factor(g)) @ r
    _, spread, rows = np.linalg.svd(r)
    keep = min(components, int((spread > spread[0] * 1e-10).sum())) if spread[0] > 1e-6 else 0
    return Whitening(grid, np.ascontiguousarray(rows[:keep].T), spread[:keep] ** 2 / grid.n, float((spread**2).sum() / grid.n))


def identity_error(table: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by one more pass."""
    g, sums = gram(table, w.grid, None, w.map())
    mean = sums / w.grid.n
    return float(np.abs(g / w.grid.n - np.outer(mean, mean) - np.eye(len(g))).max())


def deviations(x: np.ndarray, grid: Grid) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    sums = np.array(grid.sums, object)
    most = int(np.abs(x).max(initial=0)) * grid.n + int(np.abs(sums).max(initial=0))
    if most < 2**62:
        t = x * grid.n - sums.astype(np.int64)
        widest = int(np.abs(t).max(initial=0))
        if widest * widest * max(1, x.shape[1]) < 2**63:
            return (t * t).sum(1).tolist()
    found = ((x.astype(object) * grid.n - sums) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in found]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", steps: int = 64, shift: int = 1_000_000, components: int = 32) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    table = on_grid(rows, key, vector, steps, shift)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    w = fit(table, components)
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(table, w)
    (floor, rest), turn, k = w.grid.centre(), w.map(), len(w.values)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches, 1):
            y = ((x - floor) - rest) @ turn
            each = np.repeat(np.arange(len(b)), k)
            many = lambda v: np.tile(v, len(b))
            cols = [b.column(0).take(pa.array(each)), pa.array(many(np.arange(1, k + 1)), pa.int32()), pa.array(np.full(len(each), w.grid.n)), pa.array(deviations(x, w.grid), pa.int64()).take(pa.array(each)), pa.array(y.ravel())]
            cols += [pa.array(many(w.values / w.trace)), pa.array(np.full(len(each), error)), pa.array(many(w.values))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return table.mapInArrow(job, schema)
