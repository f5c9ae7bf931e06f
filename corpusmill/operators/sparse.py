"""Word search: web-style queries, a stored positional index, and cover density over the minimal covers of a query's words.

Queries: words must all be there; "quoted words" must follow each other; -word or -"quoted words" must not be there; `or`
parts alternatives, of which the best counts. An alternative of negated words alone finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corpusmill.operators.tables import unsent, written

#: What a word is; and a query's parts.
BETWEEN, PART = r"[^\p{L}\p{N}_]+", r'-?"[^"]*"|[^\s"]+'
#: Fixed value: a cover's weight.
WEIGHT = 0.1
BUCKETS = 64
#: Words or places that a task's arrays hold at once, about; a longer text is taken alone.
READ = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, alternative, negated, words): a row for each distinct item; words that must follow each other, most often one."""
    parts = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("query"), F.lit(PART), F.lit(0))).alias("_i", "_t"))
    cut = F.sum((F.col("_t") == "or").cast("int")).over(Window.partitionBy("query_id").orderBy("_i"))
    parts = parts.withColumn("alternative", cut).filter("_t <> 'or'").withColumn("negated", F.startswith("_t", F.lit("-")))
    together = F.col("negated") | F.contains("_t", F.lit('"'))
    items = F.when(together, F.array(words_of(F.col("_t")))).otherwise(F.transform(words_of(F.col("_t")), lambda w: F.array(w)))
    return parts.select("query_id", "alternative", "negated", F.explode(items).alias("words")).filter(F.size("words") > 0).distinct()


def row_ranges(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about READ items, by the offsets of the rows' lists."""
    a = 0
    while a < len(ends) - 1:
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + READ, "right")) - 1)
        yield a, z
        a = z


def text_postings(texts: DataFrame) -> DataFrame:
    """(term, chunk_id, positions) from (chunk_id, words): each word's places in each row, ordered within its task, so no place is shuffled."""
    schema = f"term string, chunk_id {texts.schema['chunk_id'].dataType.simpleString()}, positions array<int>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = b.columns
            ends = np.asarray(words.offsets)
            for a, z in row_ranges(ends):
                own = ends[a : z + 1]
                coded = words.values[own[0] : own[-1]].dictionary_encode()
                if not len(coded):
                    continue
                code, rows = np.asarray(coded.indices), np.repeat(np.arange(a, z), np.diff(own))
                key = rows * len(coded.dictionary) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                pos = (np.arange(len(key)) - (own[:-1] - own[0])[rows - a])[order].astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos), type=arrow.field(2).type)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order[first]])), ids.take(pa.array(rows[order[first]])), places], schema=arrow)

    return texts.mapInArrow(job, schema)


def postings(chunks: DataFrame, col: str = "content", only: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, positions): each word's places in each text; with `only` (term), of those words. `ids` (chunk_id): chunks, or what they
    were chosen from; where an id stands in several rows their places are put together."""
    placed = text_postings(chunks.select("chunk_id", words_of(F.col(col)).alias("words")))
    if only is not None:
        placed = placed.join(only.select("term").distinct(), "term", "left_semi")
    if (chunks if ids is None else ids).groupBy("chunk_id").agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        return placed
    return placed.groupBy("term", "chunk_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def build_term_index(chunks: DataFrame, top: str, col: str = "content") -> None:
    """Writes all postings below `top`, by a hash of the word, sorted by words in the files."""
    p = postings(chunks, col).withColumn("_bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    p.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "term").write.option("compression", "zstd").partitionBy("_bucket").parquet(top)


def read_postings(spark: SparkSession, top: str, terms: DataFrame) -> DataFrame:
    """The postings of `terms` (term): only the folders that may hold them are read, and only their words leave the scan's tasks."""
    wanted = terms.select("term").distinct()
    buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most 64
    return spark.read.parquet(top).filter(F.col("_bucket").isin(buckets)).drop("_bucket").join(wanted, "term", "left_semi")


def asked_terms(items: DataFrame) -> DataFrame:
    return items.select(F.explode("words").alias("term")).distinct()


def item_places(items: DataFrame, found: DataFrame) -> DataFrame:
    """(words, chunk_id, starts): where each distinct item begins in each text, by the postings `found`."""
    found = unsent(found)
    one, many = items.filter(F.size("words") == 1), items.filter(F.size("words") > 1)
    alone = one.select("words", F.get("words", F.lit(0)).alias("term")).distinct().join(found, "term").select("words", "chunk_id", F.col("positions").alias("starts"))
    steps = many.select("words").distinct().select("words", F.posexplode("words").alias("_step", "term"))
    shifted = F.transform("positions", lambda p: p - F.col("_step")).alias("_s")
    rows = steps.join(found, "term").select("words", "chunk_id", shifted).groupBy("words", "chunk_id").agg(F.collect_list("_s").alias("_all"))
    both = F.aggregate("_all", F.get("_all", F.lit(0)), lambda x, y: F.array_intersect(x, y))
    begins = rows.filter(F.size("_all") == F.size("words")).select("words", "chunk_id", F.sort_array(both).alias("starts")).filter(F.size("starts") > 0)
    return alone.unionByName(begins)


def minimal_covers(full: DataFrame) -> DataFrame:
    """(query_id, chunk_id, density) from (query_id, chunk_id, places): the sum over the minimal covers of WEIGHT / (1 + words between).

    places: (size, starts) for each item. A row's places are taken in the order of their ends. For each end the latest start of each item so
    far is kept; the least of them begins the cover. A cover counts if no cover before began as late. Places that end together count as one.
    """
    schema = f"query_id {full.schema['query_id'].dataType.simpleString()}, chunk_id {full.schema['chunk_id'].dataType.simpleString()}, density double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def densities(need: np.ndarray, size: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Of each row, by the rows' numbers of items, the items' sizes and numbers of places, and the places' starts."""
        rows = np.repeat(np.arange(len(need)), need)  # of items
        place = np.repeat(np.arange(len(rows)), n)  # items of places
        row, e = rows[place], s + size[place] - 1
        wide = int(s.max(initial=0)) + 2
        order = np.lexsort((e, row))
        row, e, s, rank = row[order], e[order], s[order], (np.arange(len(rows)) - (np.cumsum(need) - need)[rows])[place[order]]
        least, asked, on = np.full(len(row), wide), need[row], np.arange(len(row))
        for j in range(int(need.max(initial=0))):
            on = on[asked[on] > j]
            base = row[on] * wide
            latest = np.maximum.accumulate(np.where(rank[on] == j, base + s[on] + 1, 0)) - base - 1
            least[on] = np.minimum(least[on], np.maximum(latest, -1))
        last = np.flatnonzero((np.diff(row, append=-1) != 0) | (np.diff(e, append=-1) != 0))  # where all places with an end are known
        row, e, s = row[last], e[last], least[last]
        new = s > np.where(np.diff(row, prepend=-1) != 0, -1, np.concatenate([[-1], s[:-1]]))
        row, between = row[new], e[new] - s[new] + 1 - np.bincount(rows, size, len(need)).astype(np.int64)[row[new]]
        return np.bincount(row, WEIGHT / (1 + np.maximum(between, 0)), len(need))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query, chunk, places = b.columns
            starts = places.values.field("starts")
            items, ends = np.asarray(places.offsets), np.asarray(starts.offsets)
            for a, z in row_ranges(ends[items]):
                i = slice(items[a], items[z])
                size, n = np.asarray(places.values.field("size"))[i].astype(np.int64), np.diff(ends[items[a] : items[z] + 1])
                d = densities(np.diff(items[a : z + 1]), size, n, np.asarray(starts.values)[ends[items[a]] : ends[items[z]]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([query.slice(a, z - a), chunk.slice(a, z - a), pa.array(d)], schema=arrow)

    return full.select("query_id", "chunk_id", "places").mapInArrow(job, schema)


def matching(chunks: DataFrame, items: DataFrame, col: str = "content") -> DataFrame:
    """The chunks that hold all wanted words of an alternative, wherever they stand: only their places have to be known.

    A word counts once a text; each alternative begins with its rarest word, so common ones are only looked up in those texts.
    """
    asked = items.filter("not negated").select("query_id", "alternative", F.explode("words").alias("term")).distinct()
    held = chunks.select("chunk_id", F.explode(F.array_distinct(words_of(F.col(col)))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    held = unsent(written(held, "words"))
    texts = held.groupBy("term").agg(F.count("*").alias("_texts"))
    first = asked.join(texts, "term", "left").groupBy("query_id", "alternative").agg(F.count("*").alias("need"), F.min(F.struct(F.coalesce("_texts", F.lit(0)), "term"))["term"].alias("term"))
    some = first.join(held, "term").drop("term").join(asked, ["query_id", "alternative"])
    full = some.join(held, ["term", "chunk_id"]).groupBy("query_id", "alternative", "need", "chunk_id").agg(F.count("*").alias("_n")).filter("_n = need")
    return chunks.join(full.select(F.col("chunk_id").alias("_full")).distinct(), F.col("chunk_id") == F.col("_full"), "left_semi")


def cover_density(items: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, chunk_id, density): texts that an alternative matches, with the best alternative's density.

    Each alternative's candidates are the texts of its rarest item, so common words are only looked up in those.
    """
    places = item_places(items, found)
    wide = items.withColumn("_key", F.concat_ws(" ", "words"))
    places = unsent(written(places.select(F.concat_ws(" ", "words").alias("_k"), F.size("words").alias("size"), "chunk_id", "starts"), "places"))
    held = places.groupBy("_k").agg(F.count("*").alias("_texts"))
    asked = wide.filter("not negated").join(held, F.col("_key") == F.col("_k"), "left").groupBy("query_id", "alternative").agg(F.count("*").alias("need"), F.min(F.struct(F.coalesce("_texts", F.lit(0)), F.col("_key").alias("key")))["key"].alias("_rarest"))
    some = asked.join(places.select(F.col("_k").alias("_rarest"), "chunk_id"), "_rarest").select("query_id", "alternative", "need", "chunk_id")
    each = some.join(wide.select("query_id", "alternative", "negated", "_key"), ["query_id", "alternative"])
    near = places.select(F.col("_k").alias("_key"), "chunk_id", "size", "starts")
    each = each.join(near, ["_key", "chunk_id"])
    own = F.when(~F.col("negated"), F.struct("size", "starts"))
    full = each.groupBy("query_id", "alternative", "need", "chunk_id").agg(F.collect_list(own).alias("places"), F.bool_or("negated").alias("_no")).filter((F.size("places") == F.col("need")) & ~F.col("_no"))
    return minimal_covers(full).groupBy("query_id", "chunk_id").agg(F.max("density").alias("density"))
