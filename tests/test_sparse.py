"""Word search against brute force over all intervals; queries' forms; what is read of the index."""

import itertools
import random
import re

import pytest

from corpusmill.operators import sparse

DOCS = ["a b c", "b a", "c", "a x x b x c", "the b, a! B", None, "", "a b b a c a b", "x y a b", "or a", "b-c a", "é ß a"]
ASKED = ["a b", '"a b"', '"a b" c', "a -c", "a or c", 'x or "b a"', "-c", "or", "a or", '"" a', 'a "x', "a a b", '"a b" b', "b-c", "-b-c a", "A, B", "é", None, '-"b a" c or b a c']


def plain_items(q):
    alts = [[]]
    for t in re.findall(sparse.PART, (q or "").lower()):
        if t == "or":
            alts.append([])
            continue
        words = re.findall(r"\w+", t)
        neg = t.startswith("-")
        alts[-1] += [(neg, tuple(words))] if neg or '"' in t else [(False, (w,)) for w in words]
    return [{x for x in a if x[1]} for a in alts]


def plain_density(q, text):
    words, best = re.findall(r"\w+", (text or "").lower()), None
    at = lambda u: [k for k in range(len(words) - len(u) + 1) if tuple(words[k : k + len(u)]) == u]
    for items in plain_items(q):
        want = [u for neg, u in items if not neg]
        if not want or any(at(u) for neg, u in items if neg) or not all(at(u) for u in want):
            continue
        covers = [(s, e) for s, e in itertools.combinations_with_replacement(range(len(words)), 2) if all(any(s <= k and k + len(u) - 1 <= e for k in at(u)) for u in want)]
        least = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        n = sum(map(len, want))
        best = max(best or 0, sum(0.1 / (1 + max(e - s + 1 - n, 0)) for s, e in least))
    return best


@pytest.mark.parametrize("stored", [False, True])
def test_density_is_brute_force_over_intervals(spark, tmp_path, stored):
    r = random.Random(7)
    docs = DOCS + [" ".join(r.choices("abcxyz", k=r.randrange(1, 25))) for _ in range(60)]
    asked = ASKED + [" ".join(r.choice(["a", "b", "x", '"a b"', '"b x a"', "-z", "or", "y", '-"x x"']) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, content string")
    items = sparse.parse_queries(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    if stored:
        sparse.build_term_index(chunks, f"file://{tmp_path}/index")
        found = sparse.read_postings(spark, f"file://{tmp_path}/index", sparse.asked_terms(items))
    else:
        found = sparse.postings(sparse.matching(chunks, items), "content", sparse.asked_terms(items))
    got = {(x.query_id, x.chunk_id): round(x.density, 9) for x in sparse.cover_density(items, found).collect()}
    want = {(q, d): round(v, 9) for q, qt in enumerate(asked) for d, t in enumerate(docs) if (v := plain_density(qt, t)) is not None}
    assert got == want and len(want) > 500


def test_only_asked_postings_are_read(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"word{k} common w{k % 7}") for k in range(300)], "chunk_id long, content string")
    sparse.build_term_index(chunks, f"file://{tmp_path}/index")
    terms = spark.createDataFrame([("word5",), ("common",)], "term string")
    got = sparse.read_postings(spark, f"file://{tmp_path}/index", terms)
    assert got.count() == 301 and {x.term for x in got.collect()} == {"word5", "common"}
    assert len(got.inputFiles()) >= 60  # the whole table's files ...
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ (IN|INSET|=)", plan)  # ... of which at most two folders are read


def test_empty_tables(spark):
    chunks, none = spark.createDataFrame([(1, "a")], "chunk_id long, content string"), spark.createDataFrame([], "query_id long, query string")
    items = sparse.parse_queries(none)
    assert sparse.cover_density(items, sparse.postings(chunks, "content", sparse.asked_terms(items))).collect() == []


def test_places_leave_their_task_in_order(spark, monkeypatch):
    """A word's places in a text need no shuffle, in slices as well; rows with one id are put together."""
    monkeypatch.setattr(sparse, "READ", 3)
    texts = [(k, t) for k, t in enumerate(DOCS)]
    want = {(w, k): [i for i, x in enumerate(re.findall(r"\w+", (t or "").lower())) if x == w] for k, t in texts for w in re.findall(r"\w+", (t or "").lower())}
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    got = sparse.postings(chunks)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(x.term, x.chunk_id): x.positions for x in got.collect()} == want
    twice = sparse.postings(spark.createDataFrame([(1, "a b"), (1, "b b"), (2, "a")], "chunk_id int, content string"))
    assert sorted((x.term, x.chunk_id, x.positions) for x in twice.collect()) == [("a", 1, [0]), ("a", 2, [0]), ("b", 1, [0, 1, 1])]


def test_covers_in_slices_are_the_same(spark, monkeypatch):
    chunks = spark.createDataFrame(list(enumerate(DOCS)), "chunk_id long, content string")
    items = sparse.parse_queries(spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")).cache()
    monkeypatch.setattr(sparse, "READ", 3)
    got = {(x.query_id, x.chunk_id): round(x.density, 9) for x in sparse.cover_density(items, sparse.postings(chunks)).collect()}
    want = {(q, k): round(plain_density(t, d), 9) for q, t in enumerate(ASKED) for k, d in enumerate(DOCS) if plain_density(t, d) is not None}
    assert got == want
