"""Chunks: worked examples, the cut against a plain version, time in proportion to the text, structure kept."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import chunking
from corpusmill.operators.docprep import TOKEN


def size(text):
    return len(TOKEN.findall(text))


def test_cut_falls_where_the_topic_changes():
    text = (
        "Hypertension management includes blood pressure monitoring. Blood pressure targets depend on cardiovascular risk. Antihypertensive therapy requires follow-up.\n\n"
        "Dermatology care includes sunscreen and skin examination. Skin lesions should be assessed for changes. Dermatology follow-up depends on pathology."
    )
    got = [c for c, _, _ in chunking.pack_text(text, 24, 0)]
    assert len(got) >= 2 and "Antihypertensive therapy" in got[0] and "Dermatology care" not in got[0] and got[1].startswith("Dermatology care")


def test_tables_repeat_their_header():
    text = "指标 | 数值\n--- | ---\n血压 | 120\n血糖 | 5.6\n心率 | 70"
    got = [c for c, _, _ in chunking.pack_table(text, 8)]
    assert len(got) == 3 and all(c.startswith("指标 | 数值\n--- | ---\n") for c in got)
    assert chunking.pack_table("a\nb", 1) == [("a\nb", 0, 3)] and chunking.pack_table(" \n", 1) == []
    assert [c for c, _, _ in chunking.pack_table("a b\nc d\ne f", 4)] == ["a b\nc d", "e f"]


def plain_segments(text, limit, overlap):
    """The rule as it reads: two sets rebuilt at each place."""
    rows = chunking.sentences_of(text, limit, overlap)
    least = max(1, int(limit * 0.42))
    best, out, a = max(least, int(limit * 0.78)), [], 0
    words = lambda some: chunking.terms(" ".join(r[0] for r in some))
    while a < len(rows):
        if sum(r[3] for r in rows[a:]) <= limit:
            out.append((a, len(rows)))
            break
        end = a + 1
        while sum(r[3] for r in rows[a : end + 1]) <= limit:
            end += 1
        scored = []
        for b in range(a + 1, end + 1):
            running = sum(r[3] for r in rows[a:b])
            if running >= least:
                left, right = words(rows[max(0, b - 2) : b]), words(rows[b : b + 2])
                near = len(left & right) / len(left | right) if left | right else 0.0
                scored.append((near + 0.12 * (abs(running - best) / max(best, 1)) - 0.35 * rows[b][4], -b))
        b = -min(scored)[1] if scored else end
        out.append((a, b))
        a = b
    return rows, out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta.", "beta!", "x-y", "。", "血压", "高", "\n\n", "\n", "5.6", "Alpha.", "-"]), max_size=80), st.integers(1, 20), st.integers(0, 6))
def test_cuts_are_those_of_the_plain_rule(words, limit, overlap):
    text = " ".join(words)
    rows, want = plain_segments(text, limit, overlap)
    import numpy as np

    got = chunking.segments(np.array([r[3] for r in rows], int), chunking.cohesions([r[0] for r in rows]), np.array([r[4] for r in rows] + [False]), limit) if rows else []
    assert got == want
    pieces = chunking.pack_text(text, limit, overlap)
    assert all(size(c) <= limit or len([x for x in c.split("\n") if x]) == 1 for c, _, _ in pieces)
    assert {r[0] for r in rows} <= {line for c, _, _ in pieces for line in c.split("\n")}


def test_long_texts_take_time_in_proportion():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = " ".join(r.choice(words) + r.choice(["", "", "", ".", ".\n\n"]) for _ in range(300_000))
    assert len(text) > 2_000_000
    took = []
    for part in (text[: len(text) // 4], text):
        start = time.process_time()
        chunking.pack_text(part, 900, 0)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_chunks_of_documents(spark):
    table = "| Drug | Dose |\n| --- | --- |\n" + "\n".join(f"| d{k} | {k} mg |" for k in range(60))
    text = "intro words here.\n# One\n" + "alpha beta gamma delta. " * 300 + "\n\nmore of it\n\n" + table + "\n\n- item one\n- item two\n## 1.1 Deep\nlast."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "#  \n")], "doc_id long, text string")
    got = sorted(chunking.chunk_documents(docs, child=50, parent=120, overlap=5).collect(), key=lambda r: (r.doc_id, r.chunk_index))
    assert {r.doc_id for r in got} <= {1, 4} and [r.chunk_index for r in got if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in got)))
    mine = [r for r in got if r.doc_id == 1]
    for r in mine:
        assert size(r.content) <= (120 if r.chunk_type == "parent" else 50)
        above = mine[r.parent_index] if r.parent_index is not None else None
        assert (r.chunk_type == "child") == (above is not None and above.chunk_type == "parent" and above.section == r.section)
        if r.block_type == "table":
            assert r.content.startswith("| Drug | Dose |\n| --- | --- |\n| d")
        if r.block_type == "paragraph":
            assert set(r.content.split("\n")) <= {x for s in re.split(r"\n", text) for x in [*re.split(r"(?<=\.)\s+", s.strip()), s.strip()]}
    assert {r.block_type for r in mine} == {"paragraph", "table", "list"} and mine[0].section_path == "" and mine[-1].content == "last." and mine[-1].section_path.endswith("1.1 Deep")
    assert sum(r.content.count("| d") for r in mine if r.block_type == "table" and r.chunk_type == "parent") == 60
    assert len({r.chunk_id for r in chunking.chunk_ids(chunking.chunk_documents(docs)).collect()}) == chunking.chunk_documents(docs).count()
