"""Small-world questions over a graph of two tables: vertices (id, type, name) and edges (source, target, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.tables import numbered, written


def build_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last row of each vertex; distinct edges whose ends both exist."""
    v = vertices.dropDuplicates(["id"])
    ids = v.select(F.col("id").alias("_v"))
    e = edges.select("source", "relation", "target").distinct()
    e = e.join(ids, F.col("source") == F.col("_v"), "left_semi").join(ids, F.col("target") == F.col("_v"), "left_semi")
    return v, e


def find_vertices(vertices: DataFrame, names: DataFrame, inside: bool = False) -> DataFrame:
    """Vertices by name, letter case and outer blanks aside; or those whose name holds one of a few given names."""
    n = names.select(F.lower(F.trim("name")).alias("_n")).filter("_n <> ''").distinct()
    own = F.lower(F.trim("name"))
    return vertices.join(n, own.contains(F.col("_n")) if inside else own == F.col("_n"), "left_semi")


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids: two semi-joins, then distinct, instead of a join on OR."""
    i = ids.select(F.col("id").alias("_v")).distinct()
    return edges.join(i, F.col("source") == F.col("_v"), "left_semi").unionByName(edges.join(i, F.col("target") == F.col("_v"), "left_semi")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, by: list[str] = ()) -> DataFrame:
    """(by, id, depth) of all vertices within `depth` steps of the seeds, in both directions; `by` tells seed sets apart, all go at once.

    Each round joins the frontier with the edges and drops what its seed set has met; rounds are written tables, so the plan stays short.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    seen = seeds.select(*by, "id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        new = front.select(*by, F.col("id").alias("a")).join(both, "a").select(*by, F.col("b").alias("id")).distinct()
        front = written(new.join(seen.select(*by, "id"), [*by, "id"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(front)
    return seen


def relations(edges: DataFrame, reached: DataFrame, depth: int, by: list[str] = ()) -> DataFrame:
    """Every incident edge of each vertex that was expanded; one between two of them shows twice (outgoing, incoming)."""
    inner = reached.filter(F.col("depth") < depth).select(*by, F.col("id").alias("_v"))
    out = edges.join(inner, F.col("source") == F.col("_v")).select(*by, "source", "relation", "target", F.lit("outgoing").alias("direction"))
    return out.unionByName(edges.join(inner, F.col("target") == F.col("_v")).select(*by, "source", "relation", "target", F.lit("incoming").alias("direction")))


def graph_context(found: DataFrame, vertices: DataFrame, labels: dict[str, str] | None = None, by: list[str] = ()) -> DataFrame:
    """(by, line, line_no): one line for each distinct (name, relation, name) of an answer, in order; without `by` all is one answer's."""
    v = vertices.select(F.col("id").alias("_i"), F.col("name").alias("_name"))
    j = found.select(*by, "source", "relation", "target").distinct().join(v, F.col("source") == F.col("_i")).withColumnRenamed("_name", "a").drop("_i").join(v, F.col("target") == F.col("_i")).withColumnRenamed("_name", "b")
    said = F.col("relation")
    if labels:
        said = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("relation")], said)
    lines = j.select(*by, F.concat(F.lit("- "), "a", F.lit(" --["), said, F.lit("]--> "), "b").alias("line")).distinct()
    return numbered(lines, list(by), "line", "line_no")  # an answer may have all suppliers' lines


def collection_graph(vertices: DataFrame, edges: DataFrame, kb_id: int) -> tuple[DataFrame, DataFrame]:
    v = vertices.filter(F.col("kb_id") == kb_id)
    return v, incident_edges(edges, v)
