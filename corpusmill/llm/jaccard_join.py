"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles (lower-cased words parted by white space; fewer than five words make one
shingle). Documents with equal sets form a class; the join runs over one representative a class.

Chosen paths: in every run, each node of a recursion samples tokens by a hash that all sets share: a set x of a node
takes token t if h(node, t) < 1 / (threshold * |x|), and goes to the child of each token taken. Similar sets keep at
least one expected common child a level, dissimilar ones part. A node with at most `leaf` sets is a leaf; larger ones
recurse, down to `depth`. Runs are repeated until a pair at the threshold is missed with a probability below `miss`
(computed from the branching process, see `runs_needed`). Leaves with the same members are searched once.

Leaves are searched by brute force, pairs compared on their whole sets of 32-bit shingle hashes (two sets of a thousand
share a hash by chance once in some thousand pairs, a thousandth of what could move a pair over the threshold). A leaf that is still larger
than `leaf` at the last level (thousands of near copies) is cut into blocks, and pairs of blocks are searched as tasks
of their own. A pair that shares several leaves belongs to the least of them, so its link counts once. Tasks return
links counted by document, and a spanning forest of what they find, never all pairs: results are linear in the input.

Classes are named by the row number of one of their rows, so any ids do: null, repeated with other texts, or near the
ends of 64 bits.

Defined cases: null and empty texts, and texts of white space, have no shingles: each is a class and group of its own
without links; repeated rows of one text are a class; a class of rows without ids has a null class_id, and a group of
such classes a null group_id; an id that several texts share does not join their classes or groups; only the key and the
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import broadcast_small, mix, row_slices, span_hashes, utf8, word_spans, written

SETS = "uid long, doc_id long, text_hash long, sig1 long, sig2 long, n int, tokens binary"
#: Shingles that weigh as much as one set in a leaf's size, and bytes of sets that a searching task reads, about.
SHINGLES_A_SET, TASK_BYTES = 4_096, 64 << 20
NODES = "rep long, node long, parent long"
FOUND = "a long, b long, links long"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(threshold: float, depth: int, miss: float) -> int:
    """Runs until a pair at the threshold is missed with a probability below `miss`.

    A pair with Jaccard similarity J shares at least J of the larger set's tokens (as much where one set holds the other),
    and both sets take a token where the larger one does. So a node has at least J / threshold = 1 common child in the
    mean, about Poisson; a run misses the pair if that process dies within `depth`.
    """
    mean, dies = 1.0, 0.0
    for _ in range(depth):
        dies = math.exp(-mean * (1 - dies))
    return math.ceil(math.log(miss) / math.log(dies))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles, and the row of each."""
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(len(row))
    out = np.zeros(len(row), np.uint64)
    end = np.repeat(at[1:], count)
    for k in range(words):
        here = first + k
        inside = here < end
        out = np.where(inside, mix(out * GOLD + h[np.minimum(here, max(len(h) - 1, 0))] + np.uint64(1)), out) if len(h) else out
    return out, row


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """uid (the row's number), doc_id, a hash of the text, a 128-bit signature of the set, its size, its sorted 32-bit hashes; a written table."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in row_slices(offsets):
                h, row = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                h >>= np.uint64(32)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                n = np.bincount(row, minlength=b - a)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(h ^ GOLD), mix(h + GOLD))]
                s1, s2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(h.astype("<u4"))]).cast(pa.binary())
                uid, first = uid + b - a, uid
                ids, marks = (batch.column(k).slice(a, b - a) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(range(first, uid), pa.int64()), ids, marks, pa.array(s1), pa.array(s2), pa.array(n, pa.int32()), raw], [x.split()[0] for x in SETS.split(", ")])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(job, SETS), "shingle-sets")


def paths(tokens: np.ndarray, runs: int, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their parents of one set, over all runs and levels; the first level's parent is 0."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    nodes, found, parents = mix(np.arange(1, runs + 1, dtype=np.uint64) * GOLD), [], []
    for level in range(depth):
        hashed = mix(nodes[:, None] ^ tokens[None, :])
        at, token = np.nonzero(hashed < limit) if len(tokens) > 1 else np.nonzero(np.ones((len(nodes), 1), bool))
        children = mix(nodes[at] * GOLD + tokens[token] + np.uint64(level + 1))
        found.append(children)
        parents.append(nodes[at] if level else np.zeros(len(at), np.uint64))
        nodes = children
    return np.concatenate(found), np.concatenate(parents)


def choose_paths(sets: DataFrame, runs: int, depth: int, threshold: float) -> DataFrame:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                ids, nodes, parents = [], [], []
                for rep, raw in zip(batch.column(0)[a : a + 1000].to_pylist(), batch.column(1)[a : a + 1000], strict=True):
                    n, p = paths(np.frombuffer(raw.as_buffer(), "<u4").astype(np.uint64), runs, depth, threshold)
                    ids.append(np.full(len(n), rep, np.int64))
                    nodes.append(n)
                    parents.append(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.concatenate(parents).view(np.int64))], ["rep", "node", "parent"])

    return sets.filter("n > 0").select("sig1", "tokens").mapInArrow(job, NODES).distinct()


def choose_leaves(nodes: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, size) of the leaves, one for each set of members; and (rep, leaf) of their members."""
    sizes = nodes.groupBy("node", "parent").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("members"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("members2")).filter("size > 1")
    sizes = written(sizes, "path-sizes")
    big = sizes.filter(F.col("size") > leaf).select(F.col("node").alias("_big"))
    top = sizes.filter((F.col("parent") == 0) & (F.col("size") <= leaf))
    inner = sizes.filter(F.col("parent") != 0)
    below = inner.join(big, F.col("parent") == F.col("_big"), "left_semi")
    # The last level's nodes are leaves at any size; a large node in between has passed its sets on.
    parents = big.join(inner.select(F.col("parent").alias("_p")).distinct(), F.col("_big") == F.col("_p"), "left_anti")  # large, without children
    lone = sizes.join(parents, F.col("node") == F.col("_big"), "left_semi").filter(F.col("parent") == 0)
    leaves = top.unionByName(below).unionByName(lone)
    leaves = written(leaves.groupBy("size", "members", "members2").agg(F.min("node").alias("leaf")).select("leaf", "size"), "path-leaves")
    members = nodes.join(leaves, F.col("node") == F.col("leaf")).select("rep", "leaf").distinct()
    return leaves, members


def plan_blocks(leaves: DataFrame, members: DataFrame, classes: DataFrame, leaf: int) -> DataFrame:
    """(rep, own, task, side): in which searches a set takes part.

    A leaf within the limit is one search; sets weigh one, and more where they have thousands of shingles. In a larger
    leaf, let `first` be a set's least large leaf. Pairs with the same first leaf belong to that one, so in another leaf
    the sets of its most common first leaf ("covered") are only compared with the rest ("open"), block by block.
    """
    lists = members.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("own"))  # bounded by the paths of a set
    weights = classes.groupBy(F.col("sig1").alias("_rep")).agg(F.sum(1 + F.col("n") / SHINGLES_A_SET).alias("w"))
    rows = members.join(lists.join(weights, F.col("rep") == F.col("_rep")).drop("_rep"), "rep")
    heavy = members.join(weights, F.col("rep") == F.col("_rep")).groupBy(F.col("leaf").alias("_large")).agg(F.sum("w").alias("_w")).filter(F.col("_w") > 2 * leaf)
    heavy = written(heavy.select("_large"), "path-large")
    large = broadcast_small(heavy)
    small = rows.join(large, F.col("leaf") == F.col("_large"), "left_anti").select("rep", "own", F.struct("leaf", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("task"), F.lit(0).alias("side"))
    wide = rows.join(large, F.col("leaf") == F.col("_large"), "left_semi")
    first = wide.groupBy("rep").agg(F.min("leaf").alias("first"))
    wide = written(wide.join(first, "rep"), "path-wide")
    kinds = wide.groupBy("leaf", "first").agg(F.sum("w").alias("w"))
    best = kinds.groupBy("leaf").agg(F.max(F.struct("w", "first")).alias("m"), F.sum("w").alias("all"))
    best = best.select(F.col("leaf").alias("_leaf"), F.when(F.col("m.first") != F.col("leaf"), F.col("m.first")).alias("covered_first"), F.when(F.col("m.first") != F.col("leaf"), F.col("m.w")).otherwise(0.0).alias("w_covered"), "all")
    wide = wide.join(broadcast_small(written(best, "path-kinds")), F.col("leaf") == F.col("_leaf"))  # a row a large leaf
    covered = F.coalesce(F.col("first") == F.col("covered_first"), F.lit(False))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / leaf)).cast("int")
    wide = wide.withColumn("covered", covered).withColumn("n_open", blocks(F.col("all") - F.col("w_covered"))).withColumn("n_cov", F.when(F.col("w_covered") > 0, blocks(F.col("w_covered"))).otherwise(0))
    wide = wide.withColumn("k", F.pmod(F.xxhash64("rep", "leaf"), F.when(F.col("covered"), F.col("n_cov")).otherwise(F.col("n_open"))).cast("int"))
    # Searches are (i, j): open block i with open block j >= i, or with covered block j, numbered after the open ones.
    as_covered = F.transform(F.sequence(F.lit(0), F.col("n_open") - 1), lambda i: F.struct(i.alias("i"), (F.col("n_open") + F.col("k")).alias("j"), F.lit(1).alias("side")))
    as_open = F.transform(F.sequence(F.lit(0), F.col("n_open") + F.col("n_cov") - 1), lambda j: F.struct(F.least(F.col("k"), j).alias("i"), F.greatest(F.col("k"), j).alias("j"), F.when(j >= F.col("k"), 0).otherwise(1).alias("side")))
    wide = wide.select("rep", "own", "leaf", F.explode(F.when(F.col("covered"), as_covered).otherwise(as_open)).alias("t"))
    return small.unionByName(wide.select("rep", "own", F.struct("leaf", F.col("t.i").alias("i"), F.col("t.j").alias("j")).alias("task"), F.col("t.side").alias("side")))


#: Frequent tokens that are multiplied at once: two matrices of a search's sets by so many columns.
COLUMNS = 1024


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols]: frequent tokens by a matrix product, rare ones by lists."""
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(token)
    out = np.zeros((len(rows), len(cols)), np.float32)
    row_at, col_at = np.full(len(sets), -1), np.full(len(sets), -1)
    row_at[rows], col_at[cols] = np.arange(len(rows)), np.arange(len(cols))
    heavy = np.flatnonzero(df >= 32)
    number = np.full(len(df), -1)
    number[heavy] = np.arange(len(heavy))
    held = number[token]
    for a in range(0, len(heavy), COLUMNS):
        some = np.flatnonzero((held >= a) & (held < a + COLUMNS))
        d, t = doc[some], held[some] - a
        width = min(COLUMNS, len(heavy) - a)
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        m = row_at[d] >= 0
        left[row_at[d[m]], t[m]] = 1
        m = col_at[d] >= 0
        right[col_at[d[m]], t[m]] = 1
        out += left @ right.T
    light = (df[token] < 32) & (df[token] > 1)
    d, t = doc[light], token[light]
    order = np.argsort(t, kind="stable")
    d, t = d[order], t[order]
    for shift in range(1, 32):  # the k-th next holder of the same token
        if len(d) <= shift:
            break
        same = t[shift:] == t[:-shift]
        if not same.any():
            break
        x, y = d[:-shift][same], d[shift:][same]
        for p, q in ((x, y), (y, x)):
            m = (row_at[p] >= 0) & (col_at[q] >= 0)
            np.add.at(out, (row_at[p[m]], col_at[q[m]]), 1)
    return out


def search(task: tuple, reps: np.ndarray, side: np.ndarray, own: list, sets: list[np.ndarray], threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links by document, and a forest of linked pairs, that this search owns."""
    leaf, i, j = task
    index = np.arange(len(reps))
    keep = np.ones(len(reps), bool)
    sizes = np.array([len(s) for s in sets])
    # A pair at the threshold shares at least that part of the larger set, so of each set; others in turn can't pair.
    every = np.concatenate(sets)
    _, token = np.unique(every, return_inverse=True)
    doc = np.repeat(index, sizes)
    for _ in range(8):
        df = np.bincount(token[keep[doc]], minlength=int(token.max()) + 1 if len(token) else 1)
        shared = np.bincount(doc[df[token] > 1], minlength=len(reps))
        now = keep & (shared >= threshold * sizes - 1e-9)
        if now.sum() == keep.sum():
            break
        keep = now
    left = np.flatnonzero(keep & ((side == 0) | (i == j)))
    right = left if i == j else np.flatnonzero(keep & (side == 1))
    if len(left) == 0 or len(right) == 0 or i == j and len(left) < 2:
        return {}, []
    used = np.unique(np.concatenate([left, right]))
    place = np.full(len(reps), -1)
    place[used] = np.arange(len(used))
    both = overlaps([sets[k] for k in used], place[left], place[right])
    total = sizes[left][:, None] + sizes[right][None, :]
    linked = both >= (threshold / (1 + threshold)) * total - 1e-6
    if i == j:
        linked = np.triu(linked, 1)
    # A pair belongs to its least common leaf: drop those that share a lesser one.
    lesser: dict[int, list[int]] = {}
    for k in used:
        for x in own[k]:
            if x < leaf:
                lesser.setdefault(x, []).append(k)
    row_at, col_at = np.full(len(reps), -1), np.full(len(reps), -1)
    row_at[left], col_at[right] = np.arange(len(left)), np.arange(len(right))
    for ks in lesser.values():
        r, c = row_at[ks], col_at[ks]
        r, c = r[r >= 0], c[c >= 0]
        if len(r) and len(c):
            linked[np.ix_(r, c)] = False
    links: dict[int, int] = {}
    for ks, counts in ((left, linked.sum(1)), (right, linked.sum(0))):
        for k, n in zip(ks, counts, strict=True):
            if n:
                links[k] = links.get(k, 0) + int(n)
    # A forest: each document of the right side with the first it is linked to, and lefts that share a right.
    parent = {k: k for k in links}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    for r, k in enumerate(left):
        for c in np.flatnonzero(linked[r]):
            a, b = root(k), root(right[c])
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(reps[k]), int(reps[right[c]])))
    return {int(reps[k]): n for k, n in links.items()}, edges


def search_leaves(plan: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): a forest edge (links null), or the links of class a (b null) found in one search; classes by their row numbers.

    The representatives' sets move twice: to their searches' list, and from there to the searches. Classes that share the
    half signature by which paths name them both come along.
    """
    lists = plan.groupBy("rep").agg(F.first("own").alias("own"), F.collect_list(F.struct("task", "side")).alias("tasks"))
    named = classes.select(F.col("sig1").alias("_sig"), F.col("class_uid"), F.col("n").alias("_n"))
    lists = written(lists.join(named, F.col("rep") == F.col("_sig")).select("class_uid", "own", "tasks", "_n"), "path-tasks")
    size = lists.agg(F.sum((4 * F.col("_n").cast("long") + 8 * F.size("own")) * F.size("tasks"))).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = sets.select("uid", "tokens").join(lists, F.col("uid") == F.col("class_uid"))
    rows = rows.select("uid", "own", F.explode("tasks").alias("t"), "tokens").select(F.col("uid").alias("rep"), "own", "t.task", "t.side", "tokens")
    rows = rows.repartition(parts, "task").sortWithinPartitions("task", "rep", "side")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task: tuple | None = None

        def done() -> list[tuple]:
            if task is None or len(held) < 2:
                return []
            links, edges = search(task, np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], [h[3] for h in held], threshold)
            return [(k, None, n) for k, n in links.items()] + [(a, b, None) for a, b in edges]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

        for batch in batches:
            out: list[tuple] = []
            keys = zip(*[batch.column(2).field(k).to_pylist() for k in range(3)], strict=True)
            for rep, own, key, side, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != task:
                    out += done()
                    held, task = [], key
                held.append((rep, side, own, np.frombuffer(raw.as_buffer().to_pybytes(), "<u4")))
            yield batch_of(out)
        yield batch_of(done())

    return rows.mapInArrow(job, FOUND)


def connected(edges: DataFrame, name: str = "groups") -> DataFrame:
    """(id, group): the least id of each document's connected component, for documents with an edge.

    Rounds of large-star and small-star, each written to the shared folder, until none changes an edge.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    seen = [F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))]  # tell a table of distinct edges from another
    state = now.agg(*seen).first()
    while True:
        least = both(now).groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both(now).join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(small.filter("a <> b").distinct(), name)
        last, state = state, now.agg(*seen).first()
        if state == last:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("group"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = 5, leaf: int = 1024, depth: int = 2, miss: float = 1e-4) -> DataFrame:
    """One row per document row: doc_id, class_id, class_size, group_id, n_links, n_shingles, keeps, text_hash.

    class_id: least id with the same shingle set. group_id: least id of the connected component of similar documents.
    n_links: other classes, so other texts, with similarity of at least the threshold; equal texts are class_size - 1 more.
    keeps: true for one row of each group, that with the least id (null last). text_hash: xxhash64 of the text, which with
    the id tells rows apart.
    """
    sets = shingle_sets(docs, key, text, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = sets.filter("n > 0").groupBy("sig1", "sig2", "n").agg(first, F.count("*").alias("class_size"))
    classes = written(classes.withColumn("class_uid", F.col("first.uid")), "classes")
    nodes = written(choose_paths(sets, runs_needed(threshold, depth, miss), depth, threshold), "paths")
    leaves, members = choose_leaves(nodes, leaf)
    plan = plan_blocks(leaves, written(members, "path-members"), classes, leaf)
    found = written(search_leaves(plan, sets, classes, threshold), "links")
    degree = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    groups = connected(found.filter("b is not null").select("a", "b"))
    by_class = classes.join(degree, F.col("class_uid") == F.col("a"), "left").join(groups, F.col("class_uid") == F.col("id"), "left")
    by_class = written(by_class.select("sig1", "sig2", "n", "first", "class_size", F.coalesce("links", F.lit(0)).alias("class_links"), F.coalesce("group", "class_uid").alias("_group")), "class-results")
    leads = by_class.groupBy(F.col("_group").alias("_g")).agg(F.min("first").alias("lead"))
    named = by_class.join(leads, F.col("_group") == F.col("_g"))
    named = named.select(*[F.col(c).alias(f"_{c}") for c in ("sig1", "sig2", "n")], F.col("first.doc_id").alias("class_id"), "class_size", F.col("lead.doc_id").alias("group_id"), F.col("lead.uid").alias("_lead"), "class_links")
    same = [F.col(c) == F.col(f"_{c}") for c in ("sig1", "sig2", "n")]
    rows = sets.select("uid", "doc_id", "text_hash", "sig1", "sig2", "n").join(named, (F.col("n") > 0) & same[0] & same[1] & same[2], "left")
    alone = F.col("_lead").isNull()  # no shingles
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("class_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"),
        (alone | (F.col("uid") == F.col("_lead"))).alias("keeps"), "text_hash",
    )
