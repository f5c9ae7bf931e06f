"""Conversation structure repair: the cheapest edits that give every conversation the roles (system)? (user assistant)+.

Each conversation is searched by iterative-deepening A*. Edits are tried in ASCII order (D delete, I insert, K keep, R rerole)
under a cost bound that starts at an admissible estimate and rises to the least cost that went beyond it. A place in the
search is (row, what has been put out last); a transposition table holds for each failed place the cost that it needs at
least, for this and all later bounds. The first accepting path under the least bound is the answer, ASCII-least among the cheapest.

Rows are put in order by ranges of (conversation, turn, role, text), so no conversation meets in one task. A chunk is
1,024 rows that follow each other; conversations inside a chunk are searched there, whole (in segments of 64 rows, where
they are longer). Those that touch a chunk's edge may go on: their part is searched from each possible state to each, and
the parts' costs are joined twice, by range and by conversation, so that what meets in a task is a row for 1,024 rows, then one
for each range. An audit ends its rows' letters with D, K or R, so audits of a part are prefix-free and the ASCII-least whole is
made of ASCII-least parts. A digest over a whole conversation has to read it in order: it reads the parts' texts as a stream.

Defined cases: a null role or text is one space, as is a null id or turn in the damage's key; a null id is a conversation of its own; null
turns come first; rows of one turn stand by role and text (code points), a repeated row behind its original; a conversation without rows
after damage has zeros, an empty audit and the empty string's digest; an empty table gives an empty result; only the
four columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

#: States by what was put out last: nothing, system, user, assistant; ACCEPT is the end of a conversation.
START, SYSTEM, USER, ASSISTANT, ACCEPT = range(5)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or changed row gets in each state.
ROLE = ["user", "user", "assistant", "user"]
LEGAL = {"su", "ua", "au"}
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
CHUNK_BITS, SEGMENT = 10, 64
INF = 1 << 40
WORDLESS = re.compile(r"[\x20\x09-\x0D]*")
SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string"
PATHS = "entry int, exit int, cost long, rank int"


def fault(text: str, seen: bool) -> int:
    """A row's first fault: no word, seen before, no end."""
    if WORDLESS.fullmatch(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else TRUNCATED


class Search:
    """Searches rows (initial, fault) to one goal: a state after the last row, or ACCEPT, with insertions behind it.

    The estimate counts what faults cost at least (a deletion 3, a truncated row 1) and the neighbours among the other rows that
    can't stand together, the edges among them: an edit of cost 2 or more mends two at most.
    """

    def __init__(self, rows: list[tuple[str, int]], goal: int) -> None:
        self.rows, self.goal, self.n = rows, goal, len(rows)
        self.need: dict[tuple[int, int], int] = {}
        self.following: list[str | None] = [None] * (self.n + 1)
        self.least = [0] * (self.n + 1)
        self.systems = [0] * (self.n + 1)
        wanted = "u" if goal == USER else "a"
        for i in range(self.n - 1, -1, -1):
            (initial, bad), after = rows[i], self.following[i + 1]
            self.systems[i] = self.systems[i + 1] + (initial == "s" and bad < BLANK)
            self.following[i], self.least[i] = after, self.least[i + 1]
            if bad >= BLANK:
                self.least[i] += 3
                continue
            odd = initial != wanted if after is None else initial + after not in LEGAL
            self.following[i], self.least[i] = initial, self.least[i] + odd + (bad == TRUNCATED)

    def estimate(self, i: int, q: int) -> int:
        """What the rows from i on cost at least after state q."""
        left = self.n - i
        if self.goal == ACCEPT and not left:
            return (0, 4, 2, 0)[q]
        if not left:
            return 0 if q == self.goal else INF
        if self.goal == START:
            return 3 * left if q == START else INF
        if self.goal == SYSTEM:
            return 3 * left if q == SYSTEM else 3 * (left - 1) if q == START and self.systems[i] else INF
        after = self.following[i]
        if after is not None:
            odd = (q, after) not in STEP
        else:
            odd = q not in (START, ASSISTANT) if self.goal == ACCEPT else q != self.goal
        return self.least[i] + odd

    def bound(self, i: int, q: int) -> int:
        known = self.need.get((i, q))
        return self.estimate(i, q) if known is None else known

    def edits(self, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row, state) in ASCII order."""
        inserted = ASSISTANT if q == USER else USER
        if i == self.n:
            if self.goal == ACCEPT:
                yield "I", 2, i, inserted
            return
        initial, bad = self.rows[i]
        yield "D", 3, i + 1, q
        yield "I", 2, i, inserted
        if bad >= BLANK:
            return
        if (q, initial) in STEP:
            yield "K", int(bad == TRUNCATED), i + 1, STEP[q, initial]
        if initial != ROLE[q][0]:
            yield "R", 2 + (bad == TRUNCATED), i + 1, inserted

    def run(self, entry: int) -> tuple[int, str] | None:
        """The least cost and the ASCII-least audit of that cost; None where the goal can't be reached."""
        bound = self.bound(0, entry)
        while bound < INF:
            found = self.within(entry, bound)
            if found is not None:
                return bound, found
            bound = self.need[0, entry]
        return None

    def within(self, entry: int, bound: int) -> str | None:
        """The first accepting path that costs at most `bound`; depth first, on a stack of its own."""
        letters: list[str] = []
        # row, state, what is left of the bound, edits to try, least need of those that failed, cost of the edit that led here
        stack = [[0, entry, bound, self.edits(0, entry), INF, 0]]
        while stack:
            i, q, left, edits, _, _ = top = stack[-1]
            if i == self.n and (q in (START, ASSISTANT) if self.goal == ACCEPT else q == self.goal):
                return "".join(letters)
            for letter, cost, ni, nq in edits:
                need = cost + self.bound(ni, nq)
                if need <= left:
                    letters.append(letter)
                    stack.append([ni, nq, left - cost, self.edits(ni, nq), INF, cost])
                    break
                top[4] = min(top[4], need)
            else:
                self.need[i, q] = max(top[4], self.bound(i, q))
                stack.pop()
                if stack:
                    letters.pop()
                    stack[-1][4] = min(stack[-1][4], top[5] + self.need[i, q])
        return None


def joined(parts: list[dict[tuple[int, int], tuple]], entries, exits) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Of parts that follow each other, as {(entry, exit): (cost, order)}: for each entry and exit of the whole the least
    cost and the exits of its parts, of least order among the cheapest."""
    out = {}
    for goal in exits:
        costs = [{goal: 0}]
        for part in reversed(parts):
            here: dict[int, int] = {}
            for (p, r), (cost, _) in part.items():
                if r in costs[-1]:
                    here[p] = min(here.get(p, INF), cost + costs[-1][r])
            costs.append(here)
        costs.reverse()
        for entry in entries:
            if entry not in costs[0]:
                continue
            q, way = entry, []
            for part, here, after in zip(parts, costs, costs[1:], strict=False):
                _, q = min((order, r) for (p, r), (cost, order) in part.items() if p == q and r in after and cost + after[r] == here[q])
                way.append(q)
            out[entry, goal] = costs[0][entry], way
    return out


def run_paths(rows: list[tuple[str, int]], entries, exits) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of rows that follow each other, for each entry and exit that can be."""
    cuts = range(0, len(rows), SEGMENT)
    parts = []
    for k in cuts:
        ends = exits if k == cuts[-1] else range(4)
        found = {}
        for goal in ends:
            search = Search(rows[k : k + SEGMENT], goal)
            found |= {(entry, goal): x for entry in (entries if k == 0 else range(4)) if (x := search.run(entry)) is not None}
        parts.append(found)
    if len(parts) == 1:
        return parts[0]
    out = {}
    for (entry, goal), (cost, way) in joined(parts, entries, exits).items():
        out[entry, goal] = cost, "".join(part[p, r][1] for part, p, r in zip(parts, [entry, *way], way, strict=False))
    return out


def row_edits(audit: str, entry: int, initials: str) -> list[tuple[list[str], str, str | None, list[str]]]:
    """(roles put in before, letter, new role, roles put in behind) for each row."""
    out, before, q = [], [], entry
    for letter in audit:
        role = ROLE[q]
        if letter == "I":
            before.append(role)
        else:
            out.append((before, letter, role if letter == "R" else None, []))
            before = []
        if letter == "K":
            q = STEP[q, initials[len(out) - 1]]
        elif letter != "D":
            q = ASSISTANT if role == "assistant" else USER
    if before:
        out[-1][3].extend(before)
    return out


def repaired(rows: list[tuple[str, str]], edits: list[tuple]) -> Iterator[str]:
    """The lines of the repaired rows."""
    for (role, text), (before, letter, new, behind) in zip(rows, edits, strict=True):
        yield from (f"{r}:" for r in before)
        if letter != "D":
            yield f"{new or role}:{text}"
        yield from (f"{r}:" for r in behind)


def summary(rows: list[tuple[str, str, int]]) -> tuple:
    """Counts of faults and of neighbours that can't stand together, and the edges' initials."""
    initials = [r[:1] for r, _, _ in rows]
    faults = [f for _, _, f in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return len(rows), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, initials[0], initials[-1]


def damaged(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text after the damage; nulls of role and text are one space."""
    space: Callable[[Column], Column] = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = rows.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(F.col(role)).alias("role"), space(F.col(text)).alias("text"))
    kind = F.pmod(F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")), F.lit(20))
    rows = rows.withColumn("_kind", kind).filter("_kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind")


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and _at, which counts in the order of conversations and their rows: ranges, sorted, written."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # else rows repeated many times would be one range
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_at")), "repair-rows")


def repeats(rows: DataFrame) -> DataFrame:
    """_at of the rows whose role and text an earlier row of the conversation has."""
    light = rows.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "role", F.sha2("text", 256).alias("_digest"), "_at")
    firsts = light.groupBy("conv_id", "role", "_digest").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_digest").alias("_d"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    return light.join(firsts, same).filter("_at > _first").select("_at")


def search_runs(rows: DataFrame) -> DataFrame:
    """A row for each conversation inside a chunk (whole), and for each (entry, exit) of a part of one at a chunk's edge.

    initials and the edges' states are kept for parts; sha256 is the repaired text's of a whole one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, _seg long, whole boolean, {PATHS}, audit string, sha256 string, initials string, {SUMMARY}"
    marks = repeats(rows).select(F.lit(None).cast(kind).alias("conv_id"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "_at", F.lit(1).alias("_mark"))
    both = rows.select("conv_id", "role", "text", "_at", F.lit(0).alias("_mark")).unionByName(marks)
    both = both.withColumn("_chunk", F.shiftright("_at", CHUNK_BITS)).repartition("_chunk").sortWithinPartitions("_at", F.desc("_mark"))

    def results(conv, rows: list[tuple], begins: bool, ends: bool) -> Iterator[tuple]:
        told = [(role, text, fault(text, seen)) for role, text, _, seen in rows]
        plain, entries, exits = [(r[:1], f) for r, _, f in told], (range(1) if begins else range(4)), ((ACCEPT,) if ends else range(5))
        whole, at = begins and ends, rows[0][2]
        initials = "".join(i or " " for i, _ in plain)
        found = run_paths(plain, entries, exits)
        for entry in entries:
            ranked = sorted((audit, cost, goal) for (p, goal), (cost, audit) in found.items() if p == entry)
            for rank, (audit, cost, goal) in enumerate(ranked):
                sha = hashlib.sha256("\n".join(repaired([r[:2] for r in told], row_edits(audit, entry, initials))).encode()).hexdigest() if whole else None
                yield (conv, at, whole, entry, goal, cost, rank, audit, sha, None if whole else initials, *summary(told))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        run: list[tuple] = []
        conv = chunk = None
        begins = marked = False
        for batch in batches:
            for c, role, text, at, mark, k in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if mark:
                    marked = True
                    continue
                if run and (k != chunk or c != conv):
                    out += results(conv, run, begins, k == chunk)
                    run = []
                if not run:
                    begins = k == chunk  # not the chunk's first row, so the conversation's
                conv, chunk = c, k
                run.append((role, text, at, marked))
                marked = False
            if len(out) > 2000:
                yield batch_of(out, schema)
                out = []
        if run:
            out += results(conv, run, begins, False)
        yield batch_of(out, schema)

    return written(both.mapInArrow(job, schema), "repair-runs")


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    way = pa.list_(pa.struct([("seg", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(c, way if n == "way" else kinds.get(k)) for c, (n, k) in zip(cols, names, strict=True)], [n for n, _ in names])


def join_parts(parts: DataFrame, by: list, whole: bool) -> DataFrame:
    """Parts of each group, in the order of _seg, as one part; `way` has the parts' entries and exits. whole: from START to ACCEPT only.

    A group is a range's parts of a conversation, or a conversation's ranges: a row for each 1,024 rows, or for each range.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, _seg long, {PATHS}, way array<struct<seg:bigint,entry:int,exit:int>>, {SUMMARY}"

    def group(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_seg"])
        segs: dict[int, dict] = {}
        for r in rows:
            segs.setdefault(r["_seg"], {})[r["entry"], r["exit"]] = r["cost"], r["rank"]
        heads = list({r["_seg"]: r for r in rows}.values())
        illegal = sum(h["illegal"] for h in heads) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(heads, heads[1:], strict=False))
        told = [*(sum(h[k] for h in heads) for k in ("n", "blank", "duplicate", "truncated")), illegal, heads[0]["first"], heads[-1]["last"]]
        names, lists = list(segs), list(segs.values())
        found = joined(lists, (START,) if whole else range(4), (ACCEPT,) if whole else range(5))
        out = []
        for entry in range(4):
            ranked = []
            for (p, goal), (cost, way) in found.items():
                if p == entry:
                    steps = list(zip([entry, *way], way, strict=False))
                    ranked.append(([part[s][1] for part, s in zip(lists, steps, strict=True)], goal, cost, steps))
            for rank, (_, goal, cost, steps) in enumerate(sorted(ranked)):
                out.append((heads[0]["conv_id"], names[0], entry, goal, cost, rank, [{"seg": n, "entry": p, "exit": r} for n, (p, r) in zip(names, steps, strict=True)], *told))
        return pa.Table.from_batches([batch_of(out, schema.replace("array<struct<seg:bigint,entry:int,exit:int>>", "way"))])

    return parts.groupBy(*by).applyInArrow(group, schema)


def chosen(parts: DataFrame, above: DataFrame) -> DataFrame:
    """The rows of `parts` that the ways of `above` take."""
    steps = above.select(F.col("conv_id").alias("_c"), F.explode("way").alias("_w")).select("_c", "_w.*")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_seg") == F.col("seg"))
    return parts.withColumnsRenamed({"entry": "_entry", "exit": "_exit"}).join(steps, same & (F.col("_entry") == F.col("entry")) & (F.col("_exit") == F.col("exit"))).drop("_c", "seg", "_entry", "_exit")


def digests(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """_c, sha256 of the repaired text of the conversations whose parts' audits are `taken`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    edit = "_a long, before array<string>, letter string, new string, behind array<string>"

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seg, entry, audit, initials in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out += [(seg + k, *e) for k, e in enumerate(row_edits(audit, entry, initials))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], [x.split()[0] for x in edit.split(", ")])

    each = taken.select("_seg", "entry", "audit", "initials").mapInArrow(edits, edit)
    put = lambda c: F.transform(c, lambda r: F.concat(r, F.lit(":")))
    own = F.when(F.col("letter") != "D", F.array(F.concat(F.coalesce("new", "role"), F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    lines = rows.join(each, F.col("_at") == F.col("_a")).select("conv_id", "_at", F.concat(put("before"), own, put("behind")).alias("_lines")).filter(F.size("_lines") > 0)
    lines = lines.groupBy("conv_id", F.shiftright("_at", CHUNK_BITS).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_at", "_lines"))).alias("_all"))
    pieces = lines.select("conv_id", "_chunk", F.array_join(F.flatten("_all._lines"), "\n").alias("_text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        out = []
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if sha is not None and c == conv:
                    sha.update(b"\n")
                else:
                    out += [(conv, sha.hexdigest())] if sha is not None else []
                    conv, sha = c, hashlib.sha256()
                sha.update(text.as_buffer())
        out += [(conv, sha.hexdigest())] if sha is not None else []
        yield batch_of(out, f"_c {kind}, sha256 string")

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "_chunk").mapInArrow(stream, f"_c {kind}, sha256 string")


def repair_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ordered = in_order(damaged(rows, key, turn, role, text))
    runs = search_runs(ordered)
    parts = runs.filter("not whole").drop("whole", "sha256")
    ranges = written(join_parts(parts, ["conv_id", F.shiftright("_seg", 33).alias("_range")], False), "repair-ranges")
    tops = written(join_parts(ranges, ["conv_id"], True), "repair-conversations")
    taken = written(chosen(parts, chosen(ranges, tops)), "repair-taken")
    audits = taken.groupBy(F.col("conv_id").alias("_c")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_seg", "audit")))["audit"], "").alias("audit"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    long = tops.select("conv_id", *counts).join(audits, same("_c")).drop("_c").join(digests(ordered, taken), same("_c"), "left").drop("_c")
    turns = ordered.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = runs.filter("whole").select("conv_id", *counts, "audit", "sha256").unionByName(long)
    found = found.withColumnRenamed("conv_id", "_f").join(turns.withColumnRenamed("conv_id", "_t"), F.col("_f").eqNullSafe(F.col("_t")), "left")
    every = rows.select(F.col(key).alias("conv_id")).distinct().join(found, same("_f"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *counts]]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
