"""Best-fit packing, whitening and conversation repair against brute-force versions, and on edge inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import best_fit, conversation_repair as repair, tokens, whitening
from corpusmill.llm.queries import tokenizer_path

BYTES = tokenizer_path("byte_bpe_50k.json", "BYTE_TOKENIZER_FILE")


# Best-fit packing


def one_by_one(sizes, full, rule, weights):
    """Vector best fit, piece after piece: the sequences' contents."""
    left, held = [], []
    full, w = np.array(full, float), np.array(weights)
    for size in sorted(sizes, reverse=True):
        need = np.array([size, 1, size * size], float)
        best, score = None, None
        for k, r in enumerate(left):
            if (r >= need).all():
                s = (w * ((r - need) / full) ** 2).sum() if rule == "norm" else -(w * need / full * r / full).sum()
                if score is None or s < score:
                    best, score = k, s
        if best is None:
            left.append(full.copy())
            held.append([])
            best = len(left) - 1
        left[best] = left[best] - need
        held[best].append(size)
    return sorted(map(tuple, held))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("full", [(64, 64, 64 * 64), (64, 5, 64 * 64), (64, 64, 1600), (64, 4, 2000)])
def test_plan_is_best_fit_piece_after_piece(rule, full):
    """Under each capacity: the same sequences as one piece after the other gives, places without gaps, every rank once."""
    r = random.Random(sum(full))
    for _ in range(12):
        sizes = [min(int(r.expovariate(1 / 12)) + 1, int(full[2] ** 0.5), 64) for _ in range(r.randrange(1, 150))]
        plan = best_fit.Plan(dict(Counter(sizes)), *full, rule)
        ranks, seen = Counter(), []
        for s in sizes:
            seen.append((s, ranks[s]))
            ranks[s] += 1
        seq, offset = plan.lookup(np.array([s for s, _ in seen]), np.array([k for _, k in seen]))
        held = defaultdict(list)
        for (s, _), q, o in zip(seen, seq.tolist(), offset.tolist(), strict=True):
            held[q].append((o, s))
        for items in held.values():
            at = 0
            for o, s in sorted(items):
                assert o == at
                at += s
            assert at <= full[0] and len(items) <= full[1] and sum(s * s for _, s in items) <= full[2]
        assert sorted(held) == list(range(plan.sequences))
        if rule == "norm":
            assert sorted(tuple(s for _, s in sorted(v)) for v in held.values()) == one_by_one(sizes, full, rule, best_fit.WEIGHTS)
        else:  # ties of equal products fall differently
            assert abs(len(held) - len(one_by_one(sizes, full, rule, best_fit.WEIGHTS))) <= max(1, len(held) // 20)


def test_plan_does_not_grow_with_the_pieces():
    r = random.Random(3)
    counts = {s: r.randrange(1, 1000) for s in range(1, 1025)}
    few, many = (best_fit.Plan({s: n * k for s, n in counts.items()}, 1024, 1024, 1024**2) for k in (1, 10**6))
    assert len(many.ranges) < 2 * len(few.ranges) + 2000
    assert many.sequences <= few.sequences * 10**6


ODD = ["", None, " ", "  \n\t ", "one", "a  b\n\n c  d   e　　 f  g", "it's 'tis don 't 've", "<|endoftext|> x <|endoftext|>y", "é" * 50 + " 日本語 ok 1234567", "tail  ", "\u0085 \u0085x", "x" * 5000, "word " * 4000, " a  b   c\x1c d\x00 e"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé1. 　 \u0085\x1c<|endoftx>", max_size=40), min_size=1, max_size=6))
def test_byte_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    t = tokens.encoder(BYTES, tokens.ByteEncoder).tokenizer
    for some in (texts, ODD):
        flat, sizes = [], []
        for _, _, ids, n in tokens.encoded(pa.array(some, pa.string()), BYTES, 2, tokens.ByteEncoder):
            flat += ids.tolist()
            sizes += n.tolist()
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in some]
        assert sizes == list(map(len, want)) and flat == sum(want, [])


@pytest.mark.parametrize("limits", [{}, {"documents": 3, "attention": 3000}])
def test_best_fit(spark, limits):
    r = random.Random(1)
    texts = ODD + [" ".join(r.choices(["stone", "river", "a", "under", "née"], k=r.randrange(0, 90))) for _ in range(300)] + ["same"] * 40
    rows = [(None if k == 3 else k % 200, x, k, 1.0) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rank long, length double").repartition(5)
    length = 1024 if not limits else 50
    got = best_fit.best_fit(docs, BYTES, length=length, ids=True, **limits).collect()
    t = tokens.encoder(BYTES, tokens.ByteEncoder).tokenizer
    want = Counter()
    for i, x, *_ in rows:
        ids, start = [*t.encode(x or "", add_special_tokens=False).ids, 2], 0
        cuts = [len(ids)] if len(ids) <= length else [len(ids) % length] * (len(ids) % length > 0) + [length] * (len(ids) // length)
        for piece, n in enumerate(cuts):
            own = ids[start : start + n]
            want[i, piece, start, n, zlib.crc32(np.array(own, "<u4")), tuple(own)] += 1
            start += n
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids)) for x in got) == want
    held = defaultdict(list)
    for x in got:
        held[x.sequence_id].append((x.offset, x.length))
    for items in held.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= length and len(items) <= limits.get("documents", length) and sum(n * n for _, n in items) <= limits.get("attention", length**2)
    if not limits:
        assert len(held) <= -(-sum(x.length for x in got) // 1024) + 2
    assert best_fit.best_fit(docs.limit(0), BYTES).collect() == []


# Whitening


def brute_whitening(vectors, most):
    x = np.floor(64 * np.array(vectors, float)) + 1e6
    a = x - x.mean(0)
    _, e, w = np.linalg.svd(a, full_matrices=False)
    e, w = e**2 / len(x), w.T
    keep = min(most, int((e > e[0] * 1e-18).sum()))
    return x, a @ w[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum()


SCHEMA = "vec_id long, embedding array<float>, x long, n long, component int"


@pytest.mark.parametrize("kind", ["plain", "stretched", "flat"])
def test_whitening(spark, kind):
    """Against the eigenvectors of the covariance; `stretched` has dimensions of very unequal spread, `flat` spans fewer than it has."""
    r = np.random.default_rng(4)
    v = r.normal(size=(400, 12)) * np.linspace(1, 3, 12)
    if kind == "stretched":
        v = v * 10.0 ** np.arange(0, 6, 0.5)
    if kind == "flat":
        v = np.round(v[:, :5]) @ r.integers(-3, 4, (5, 12))
    v = v.astype(np.float32)
    bad = [None, [None] * 12, [float("nan")] * 12, [1.0] * 11 + [float("inf")], [1.0] * 11 + [None], [], [1.0] * 5]
    rows = [(k, x.tolist(), 1, 2, 3) for k, x in enumerate(v)] + [(1000 + k, x, 1, 2, 3) for k, x in enumerate(bad)] + [(None, v[0].tolist(), 1, 2, 3), (7, v[7].tolist(), 1, 2, 3)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components=8).collect()
    x, y, part = brute_whitening([*v, v[0], v[7]], 8)
    n, k = len(x), y.shape[1]
    assert len(got) == n * k and {g.n for g in got} == {n} and k == (5 if kind == "flat" else 8)
    ids = [*range(400), None, 7]
    want, whole = defaultdict(list), x.astype(np.int64).astype(object)
    for i, row, d in zip(ids, y, ((whole * n - whole.sum(0)) ** 2).sum(1), strict=True):
        want[i].append((row, d))
    mine = defaultdict(dict)
    for g in sorted(got, key=lambda g: g.component):
        mine[g.vec_id].setdefault(g.component, []).append(g)
        assert abs(g.explained - part[g.component - 1]) < 1e-9 * part[g.component - 1] + 1e-15 and g.identity_error < 1e-9
        assert g.deviation == want[g.vec_id][0][1] or g.deviation is None and want[g.vec_id][0][1] >= 2**63
    signs = [np.sign(sum(mine[i][c + 1][0].whitened * want[i][0][0][c] for i in range(400))) for c in range(k)]
    for i in {*ids}:
        for c in range(k):
            assert len(mine[i][c + 1]) == len(want[i])
            assert all(abs(g.whitened * signs[c] - want[i][0][0][c]) < 1e-8 for g in mine[i][c + 1])


def test_whitening_without_spread(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0)] * 5, SCHEMA)
    huge = spark.createDataFrame([(1, [1e30, 2.0], 0, 0, 0), (2, [3.0, 1.0], 0, 0, 0)], SCHEMA)
    assert whitening.whiten(none).collect() == [] and whitening.whiten(one).collect() == []
    assert [r.deviation for r in whitening.whiten(huge).collect()] == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 30), st.integers(1, 9), st.integers(0, 10**6))
def test_factors(n, d, seed):
    """R'R is A'A to rounding, also where the rows span fewer dimensions."""
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, d)) * 10.0 ** r.integers(-4, 5, d)
    total, q = np.eye(d), a
    for k in range(3):
        g = q.T @ q
        f = whitening.factor(g, n, k == 0) if k < 2 else whitening.last_factor(g)
        total = f @ total
        q = whitening.solved(a, total) if k < 2 else q
    want = a.T @ a
    assert np.abs(total.T @ total - want).max() <= 1e-11 * np.abs(want).max()


# Conversation repair


def cheapest(rows, entry, goal):
    """(cost, audit) by trying everything from the end, the least text of the least cost."""
    n = len(rows)
    best = {}
    for i in range(n, -1, -1):
        for inserts in range(3):  # rounds, as insertions stay at a row
            for q in range(4):
                found = [(0, "")] if i == n and (q in (0, 3) if goal == repair.ACCEPT else q == goal) else []
                nxt = 3 if q == 2 else 2
                if (i < n or goal == repair.ACCEPT) and (i, nxt) in best:
                    c, s = best[i, nxt]
                    found.append((c + 2, "I" + s))
                if i < n:
                    initial, bad = rows[i]
                    options = [("D", 3, q)]
                    if bad < repair.BLANK:
                        if (q, initial) in repair.STEP:
                            options.append(("K", bad, repair.STEP[q, initial]))
                        if initial != ("a" if q == 2 else "u"):
                            options.append(("R", 2 + bad, nxt))
                    found += [(best[i + 1, r][0] + c, letter + best[i + 1, r][1]) for letter, c, r in options if (i + 1, r) in best]
                if found:
                    best[i, q] = min(found)
    return best.get((0, entry))


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "u", "a", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), min_size=1, max_size=14)


@settings(max_examples=250, deadline=None)
@given(ROWS, st.sampled_from([3, 64]))
def test_search_is_the_cheapest_repair(rows, segment):
    """From each state to each, whole and in segments; and no estimate is too high."""
    before, repair.SEGMENT = repair.SEGMENT, segment
    try:
        got = repair.run_paths(rows, range(4), range(5))
    finally:
        repair.SEGMENT = before
    for entry in range(4):
        for goal in range(5):
            want = cheapest(rows, entry, goal)
            assert got.get((entry, goal)) == want
            if want:
                assert repair.Search(rows, goal).estimate(0, entry) <= want[0]


def damage(rows):
    """Of (conv, turn, role, text): the rows after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(conv, rows):
    rows = damage([r for r in rows if r[0] == conv])
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [r[1] for r in rows if r[1] is not None]
    plain, seen, counts = [], set(), [0] * 4
    for _, _, role, text in rows:
        bad = repair.fault(text, (role, text) in seen)
        seen.add((role, text))
        counts[bad] += 1
        plain.append((role[:1], bad))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
    cost, audit = cheapest(plain, 0, repair.ACCEPT)
    lines, at, last = [], 0, ""
    for letter in audit:
        role = "assistant" if last == "u" else "user"
        if letter == "I":
            lines.append(f"{role}:")
        else:
            _, _, own, text = rows[at]
            at += 1
            if letter == "D":
                continue
            role = role if letter == "R" else own
            lines.append(f"{role}:{text}")
        last = lines[-1][:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines)) and at == len(rows)
    gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
    return (gaps, counts[repair.BLANK], counts[repair.DUPLICATE], counts[repair.TRUNCATED], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some_conversations():
    r = random.Random(8)
    rows = []
    for conv in range(60):
        for turn in range(r.choice([1, 2, 3, 5, 8, 9])):
            rows.append((conv, turn * r.choice([1, 1, 1, 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice(["Yes.", "No", "Why?", " \n", f"text {turn}!", f"é {conv}. "])))
    roles = ["user", "assistant"]
    rows += [(70, t, roles[t % 2], f"turn {t}." if t % 9 else f"turn {t}") for t in range(300)]
    rows += [(71, t, "user", "same.") for t in range(40)] + [(72, 1, "user", "again.")] * 30 + [(None, None, "assistant", f"x{k}.") for k in range(20)]
    rows += [(73, None, None, None), (74, 5, "user", None), (75, 0, None, "A."), (76, 1, "", "B."), (77, 2, "assistant", "y" * 100_000 + "."), (2**62, 2**40, "user", "C.")]
    return rows


@pytest.mark.parametrize("bits", [2, 10])
def test_repair_conversations(spark, bits, monkeypatch):
    """Also with chunks of four rows, so that most conversations go over chunks' edges."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = some_conversations()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, _at long, audit string, n long").repartition(3)
    got = repair.repair_conversations(df).collect()
    assert len(got) == len({r[0] for r in rows})
    for g in got:
        assert tuple(g)[1:] == expected(g.conv_id, rows), g.conv_id
    assert repair.repair_conversations(df.limit(0)).collect() == []


def test_every_window_is_read(monkeypatch):
    """A text without a digit, an at sign or a worded dot is read as whole as any other."""
    from corpusmill.llm import pii

    r, seen = random.Random(2), []
    tagger = pii.Tagger()
    was = tagger.emissions
    monkeypatch.setattr(tagger, "emissions", lambda x: seen.append(len(x)) or was(x))
    text = "".join(r.choice("abcdefghijklmnop .") for _ in range(4000))
    pii.added_spans([text, text[:40], ""], tagger)
    assert sum(seen) == 4000 // pii.STEP - 1 + 1


def test_parted_texts_have_the_path_of_the_whole(monkeypatch):
    """The Viterbi pass over what is undecided gives the spans of the pass over every character, in parts as well."""
    from corpusmill.llm import pii

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwzABéи日") for _ in range(r.randrange(1, 10)))
    plain = [" ".join(word() for _ in range(r.randrange(1, 120))) + " at. " for _ in range(500)]
    tagger = pii.Tagger().fit(*pii.examples(plain))
    texts = ["".join(pii.planted(t, r.randrange(-1, 5), r)[0] + t for _ in range(r.randrange(3))) + t for t in plain[:60]]
    marked, was = [], tagger.undecided
    monkeypatch.setattr(tagger, "undecided", lambda *a: marked.append(was(*a)) or marked[-1])
    parted = pii.added_spans(texts, tagger)
    assert 0 < sum(m.sum() for m in marked) < 0.5 * sum(map(len, texts))
    for held in (pii.HELD, 3):
        monkeypatch.setattr(pii, "HELD", held)
        assert pii.added_spans(texts, tagger) == parted
    monkeypatch.setattr(tagger, "undecided", lambda lead, begins, stops: np.ones(len(lead), bool))
    whole = pii.added_spans(texts, tagger)
    assert whole == parted and sum(map(len, whole)) > 30


def test_windows_that_begin_alike_share_their_first_steps(monkeypatch):
    """Emissions are those of the plain network, with fewer steps than every window's own; stretches wait for one Viterbi pass."""
    from corpusmill.llm import pii

    r, steps, passes = random.Random(8), [], []
    tagger = pii.Tagger()
    text = " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "a1", "é"]) for _ in range(30_000))
    x = np.lib.stride_tricks.sliding_window_view(pii.classes(np.array([ord(c) for c in text])).astype(np.uint8), pii.WINDOW)[:: pii.STEP]
    read, decode = tagger.read, tagger.decode
    monkeypatch.setattr(tagger, "read", lambda x, *a: steps.append(x.size) or read(x, *a))
    monkeypatch.setattr(tagger, "decode", lambda runs: passes.append(len(runs)) or decode(runs))
    got = tagger.emissions(x)
    both = np.concatenate([tagger.run(x, way)[0][pii.CUT : pii.CUT + pii.STEP] for way in "fb"], 2)
    assert np.allclose(got, (both @ tagger.p["o"] + tagger.p["ob"]).transpose(2, 0, 1), atol=1e-4)
    assert sum(steps) < 0.9 * len(x) * 2 * (pii.CUT + pii.STEP)
    for size in (0, pii.CUT), (pii.CUT + pii.STEP, pii.WINDOW):
        part = np.concatenate([tagger.run(x[:50], way)[0][slice(*size)] for way in "fb"], 2) @ tagger.p["o"] + tagger.p["ob"]
        assert np.allclose(tagger.between(x[:50], *size), part.transpose(2, 0, 1), atol=1e-4)
    monkeypatch.setattr(pii, "HELD", 64)
    pii.added_spans([text[a : a + 900] for a in range(0, 90_000, 900)], tagger)
    assert len(passes) == 1


def test_undecided_against_every_path():
    """Random emissions and transitions: where a best path is inside a span is always undecided, and what is surely outside is."""
    from corpusmill.llm import pii

    r, closed = np.random.default_rng(6), 0
    for n in range(60):
        tagger = pii.Tagger(hidden=2)
        tagger.p["t"] = r.normal(0, 0.5, (pii.N_TAGS, pii.N_TAGS)).astype(np.float32)
        e = r.normal(0, 1, (5, pii.N_TAGS)).astype(np.float32)
        e[:, 0] += r.choice([0, 2, 4, 6], 5)
        begins, stops = bool(n & 1), bool(n & 2)
        rows = np.concatenate([e[:0] if begins else np.eye(1, pii.N_TAGS, dtype=np.float32) * 1e6, e, e[:0] if stops else np.eye(1, pii.N_TAGS, dtype=np.float32) * 1e6])
        path = tagger.decode([rows])[0][0 if begins else 1 :][:5]
        flags = tagger.undecided(e[:, 1:].max(1) - e[:, 0], begins, stops)
        assert not (path[~flags] > 0).any() and not (path[tagger.outside(e.T)] > 0).any()
        closed += int((~flags).sum())
    assert closed > 20
