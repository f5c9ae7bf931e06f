"""Parent and child chunks of documents: structure first, then cuts where the topic changes.

Sections come from `docprep.structural_sections`, natively; each is cut in its task. Tables keep their header in every
piece, lists and captions are cut at lines, running text between sentences. Where a sentence ends, the terms of the two sentences
before and after are compared as sets of terms, which the limits bound, so a text takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import docprep
from corpusmill.operators.docprep import TOKEN
from corpusmill.operators.tables import flat_map

#: Where sentences end; what terms are; the least share of the limit at which a piece may end, the best one, the weight of the
#: distance from it, and what a paragraph's begin is worth.
#: A sentence's last mark is matched with the blanks behind it, as a pattern that begins with one set of characters is found fastest. Terms are
#: taken from folded texts, of which a dotless i is the one letter that counts as a Latin one besides a to z.
SENTENCE_END = re.compile(r"[。！？!?；;.\n](?:(?<=[。！？!?；;])\s*|(?<=\.)\s+|(?<=\n)\n*)")
LATIN_TERM, HAN_RUN = re.compile(r"[a-z0-9ı]+(?:[-'][a-z0-9ı]+)?"), re.compile(r"[\u3400-\u9fff]+")
LEAST_SHARE, BEST_SHARE, SHARE_WEIGHT, PARAGRAPH = 0.42, 0.78, 0.12, 0.35
BY_LINES = {"list", "figure", "caption", "footnote", "reference"}
#: Sentences whose tokens and terms a task remembers: a parent's stand in its children again.
KNOWN = 4_096
PARAGRAPHS = re.compile(r"\n\s*\n")


#: ASCII bytes by what they are to TOKEN: parts of words, joints of words, white space, other signs.
KINDS = bytes.maketrans(bytes(range(128)), b"".join(b"a" if c.isalnum() else b"-" if c in "-'/" else b" " if c.isspace() else b"." for c in map(chr, range(128))))


@lru_cache(KNOWN)
def n_tokens(sentence: str) -> int:
    """How often TOKEN matches; in ASCII texts counted from neighbouring kinds: a joint between two runs of letters makes one token of three."""
    if not sentence.isascii():
        return len(TOKEN.findall(sentence))
    t = sentence.encode().translate(KINDS)
    runs = t.count(b" a") + t.count(b".a") + t.count(b"-a") + t.startswith(b"a")
    u = t.replace(b"-a", b"+")
    joints = u.count(b"+") - u.count(b"-+") - u.count(b".+") - u.count(b" +") - u.startswith(b"+")
    return runs + t.count(b"-") + t.count(b".") - 2 * joints


@lru_cache(KNOWN)
def terms(text: str) -> frozenset[str]:
    """Latin words, and pairs of neighbouring Han characters (a single one where it stands alone)."""
    low = text.casefold()
    if low.isascii():
        return frozenset(LATIN_TERM.findall(low))
    out = set(LATIN_TERM.findall(low))
    for run in HAN_RUN.findall(low):
        out.update([run] if len(run) == 1 else (run[k : k + 2] for k in range(len(run) - 1)))
    return frozenset(out)


class Cohesions:
    """At each place before a sentence (and at the end): the share of terms that the two sentences on either side have in common. Worked out
    for the places that are asked for, as a cut looks only at those near the limit."""

    def __init__(self, sentences: list[str], outer: Cohesions | None = None, at: int = 0):
        """outer: those of a text in which these sentences stand from `at`."""
        self.sentences, self.outer, self.start = sentences, outer, at
        self.pairs: list[frozenset[str] | None] = [None] * len(sentences)
        self.values: list[float | None] = [None] * (len(sentences) + 1)

    def pair(self, k: int) -> frozenset[str]:
        """The terms of a sentence and the next."""
        one = terms(self.sentences[k])
        self.pairs[k] = out = one | terms(self.sentences[k + 1]) if k + 1 < len(self.sentences) else one
        return out

    def at(self, k: int) -> float:
        if (out := self.values[k]) is not None:
            return out
        if self.outer and 1 < k < len(self.sentences) - 1:
            out = self.outer.at(self.start + k)
        elif 0 < k < len(self.sentences):
            left = (self.pairs[k - 2] or self.pair(k - 2)) if k > 1 else terms(self.sentences[0])
            right = self.pairs[k] or self.pair(k)
            both = len(left & right)
            either = len(left) + len(right) - both
            out = both / either if either else 0.0
        else:
            out = 0.0
        self.values[k] = out
        return out

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return np.array([self.at(k) for k in places.tolist()])


def cohesions(sentences: list[str]) -> np.ndarray:
    """All of them."""
    return Cohesions(sentences)[np.arange(len(sentences) + 1)]


def stripped(text: str, a: int, b: int) -> tuple[int, int]:
    """The range without white space at its ends."""
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip())


def ranges(pattern: re.Pattern, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """What lies between a pattern's matches within [a, b)."""
    for m in pattern.finditer(text, a, b):
        yield a, m.start()
        a = m.end()
    yield a, b


def sentence_ranges(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Stripped sentences within [a, b), each with its last mark."""
    at = a
    for m in SENTENCE_END.finditer(text, a, b):
        d, end = m.span()
        if at <= d and (text[at].isspace() or text[d].isspace()):
            c, d = stripped(text, at, d + 1)
            if c < d:
                yield c, d
        else:
            yield at, d + 1
        at = end
    c, d = stripped(text, at, b)
    if c < d:
        yield c, d


def windows(text: str, a: int, b: int, limit: int, overlap: int) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, tokens) of windows of tokens within [a, b)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
    for k in range(0, len(tokens), max(1, limit - overlap)):
        some = tokens[k : k + limit]
        yield " ".join(text[x:y] for x, y in some), some[0][0], some[-1][1], len(some)


def sentences_of(text: str, limit: int, overlap: int) -> list[tuple[str, int, int, int, bool]]:
    """(text, start, end, tokens, begins a paragraph but the first) of each sentence; longer ones than the limit in windows of tokens."""
    out = []
    for n, (a, b) in enumerate(ranges(PARAGRAPHS, text, 0, len(text))):
        first = n > 0
        for c, d in sentence_ranges(text, a, b):
            size = n_tokens(text[c:d])
            if size <= limit:
                out.append((text[c:d], c, d, size, first))
            else:
                out += [(*w, first and k == 0) for k, w in enumerate(windows(text, c, d, limit, overlap))]
            first = False
    return out


def sentences_within(text: str, rows: list[tuple[str, int, int, int, bool]], content: str, limit: int, overlap: int) -> list[tuple[str, int, int, int, bool]]:
    """`sentences_of` a piece's content, which are the text's sentences that it was put together from, one in a line. A window of tokens may
    hold sentence ends that the text has not, so it is parted anew."""
    out, at = [], 0
    for one, a, b, size, _ in rows:
        end = at + len(one)
        if size <= limit and b - a == len(one) and text.startswith(one, a):
            out.append((one, at, end, size, False))
        else:
            for c, d in sentence_ranges(content, at, end):
                n = n_tokens(content[c:d])
                out += [(content[c:d], c, d, n, False)] if n <= limit else [(*w, False) for w in windows(content, c, d, limit, overlap)]
        at = end + 1
    return out


def segments(sizes: np.ndarray, near: np.ndarray, fresh: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of sentences of at most `limit` tokens: cut between 42 and 100 % of it, where cohesion, distance from 78 % and paragraphs say."""
    total, n = np.concatenate([[0], np.cumsum(sizes)]), len(sizes)
    least = max(1, int(limit * LEAST_SHARE))
    best = max(least, int(limit * BEST_SHARE))
    out, a = [], 0
    while a < n:
        end = int(np.searchsorted(total, total[a] + limit, "right")) - 1
        if end >= n:
            out.append((a, n))
            break
        end = max(end, a + 1)
        some = np.arange(max(a + 1, int(np.searchsorted(total, total[a] + least))), end + 1)
        if len(some):
            score = near[some] + SHARE_WEIGHT * (np.abs(total[some] - total[a] - best) / max(best, 1)) - PARAGRAPH * fresh[some]
            end = int(some[len(some) - 1 - score[::-1].argmin()])  # of equal ones the last
        out.append((a, end))
        a = end
    return out


def pack_sentences(rows: list[tuple[str, int, int, int, bool]], near: Cohesions, limit: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """(content, first, last + 1) of pieces of at most `limit` tokens; each begins with the last sentences of the one before that fit the overlap."""
    if not rows:
        return
    sizes = [r[3] for r in rows]
    fresh = np.array([r[4] for r in rows] + [False])
    seen, before = set(), (0, 0)
    for a, b in segments(np.array(sizes), near, fresh, limit):
        first, used, own = a, 0, sum(sizes[a:b])
        while first > before[0] and used + sizes[first - 1] <= overlap and a == before[1]:
            first -= 1
            used += sizes[first]
        while first < a and used + own > limit:
            used -= sizes[first]
            first += 1
        content = "\n".join(r[0] for r in rows[first:b]).strip()
        if content and content not in seen:
            seen.add(content)
            yield content, first, b
        before = (a, b)


def pack_text(text: str, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    """(content, start, end) of a text's pieces."""
    rows = sentences_of(text, limit, overlap)
    return [(content, rows[a][1], rows[b - 1][2]) for content, a, b in pack_sentences(rows, Cohesions([r[0] for r in rows]), limit, overlap)]


def pack_twice(text: str, parent: int, child: int, overlap: int) -> Iterator[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """(content, start, end, its pieces by `child`) of pieces by `parent`: `pack_text` of a text and of each piece, whose sentences are known by then."""
    rows = sentences_of(text, parent, 0)
    near = Cohesions([r[0] for r in rows])
    for content, a, b in pack_sentences(rows, near, parent, 0):
        inner = sentences_within(text, rows[a:b], content, child, overlap)
        same = [r[0] for r in inner]
        known = Cohesions(same, near, a) if same == near.sentences[a:b] else Cohesions(same)
        yield content, rows[a][1], rows[b - 1][2], [(c, inner[x][1], inner[y - 1][2]) for c, x, y in pack_sentences(inner, known, child, overlap)]


def lines_of(text: str) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        a, b = stripped(text, at, at + len(line))
        if a < b:
            out.append((text[a:b], a, b))
        at += len(line)
    return out


def pack_lines(rows: list[tuple[str, int, int]], limit: int, head: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """Lines put together up to the limit, below the head's lines, which stand in each piece; a longer line is a piece of its own."""
    base = sum(len(TOKEN.findall(x)) for x, _, _ in head)
    out, now, used = [], [], base
    for row in rows:
        size = len(TOKEN.findall(row[0]))
        if now and used + size > limit:
            out.append(now)
            now, used = [], base
        now.append(row)
        used += size
    out += [now] if now or head else []
    return [("\n".join(x for x, _, _ in [*head, *p]), (p or head)[0][1], (p or head)[-1][2]) for p in out]


def pack_table(text: str, limit: int) -> list[tuple[str, int, int]]:
    """A table's rows in pieces; its first two lines, where the second is a rule, stand in each."""
    rows = lines_of(text)
    a, b = stripped(text, 0, len(text))
    if len(rows) <= 2 or len(TOKEN.findall(text)) <= limit:
        return [(text[a:b], a, b)] if a < b else []
    ruled = not rows[1][0].strip("|-: ").replace("|", "").replace("-", "").replace(":", "").replace(" ", "")
    return pack_lines(rows[2:], limit, rows[:2]) if ruled else pack_lines(rows, limit)


def pack(text: str, limit: int, overlap: int, kind: str) -> list[tuple[str, int, int]]:
    if kind == "table":
        return pack_table(text, limit)
    return pack_lines(lines_of(text), limit) if kind in BY_LINES else pack_text(text, limit, overlap)


def cut(text: str, kind: str, child: int, parent: int, overlap: int) -> Iterator[tuple[int, str, int | None, str, int, int]]:
    """(n, chunk_type, parent's n, content, start, end) of a section's parents, each followed by its children."""
    pieces = ((c, a, b, pack(c, child, overlap, kind)) for c, a, b in pack(text, parent, 0, kind)) if kind == "table" or kind in BY_LINES else pack_twice(text, parent, child, overlap)
    n = 0
    for content, a, b, inner in pieces:
        above, n = n, n + 1
        yield above, "parent", None, content, a, b
        for c, x, y in inner:
            yield n, "child", above, c, x, y
            n += 1


CHUNKS = "doc_id long, section long, page int, block_type string, section_path string, n int, chunk_type string, parent_n int, content string, start int, end int"


def chunk_sections(sections: DataFrame, child: int = 320, parent: int = 900, overlap: int = 48) -> DataFrame:
    """doc_id, chunk_index, chunk_type, parent_index, section, page, block_type, section_path, content, start, end.

    Parents of at most `parent` tokens, each followed by its children of at most `child`; indexes count a document's
    chunks; start and end are a parent's place in its section, a child's in its parent. sections: as `structural_sections` gives them.
    """
    if child <= 0 or parent < child or overlap < 0:
        raise ValueError("limits must be positive, and a parent's no less than a child's")
    overlap = min(overlap, child // 2)

    def rows_of(doc, section, page, kind: str, path: str, text: str) -> Iterator[tuple]:
        return ((doc, section, page, kind, path, *r) for r in cut(text, kind, child, parent, overlap))

    given = sections.select(F.col("doc_id").cast("long"), F.col("section").cast("long"), F.col("page").cast("int"), "block_type", F.array_join("heading_path", " > ").alias("path"), "text")
    rows = flat_map(given, rows_of, CHUNKS)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "n")) - 1  # a document's chunks
    rows = rows.withColumn("chunk_index", index).withColumn("parent_index", F.col("chunk_index") - F.col("n") + F.col("parent_n"))
    return rows.select("doc_id", "chunk_index", "chunk_type", "parent_index", "section", "page", "block_type", "section_path", "content", "start", "end")


def paragraph_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs and `#` lines as blocks, tables and lists told by their lines' begin."""
    parted = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?m)^(#{1,6}[ \t]+[^\n]*)$", "\n\n$1\n\n")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(parted, r"\n\s*\n")).alias("block_order", "text")).filter(F.trim("text") != "")
    kind = F.when(F.col("text").rlike(r"^\s*#{1,6}[ \t]"), "heading").when(F.col("text").rlike(r"^\s*\|[^\n]*\n\s*\|?[-:| ]*-[-:| ]*(\n|$)"), "table").when(F.col("text").rlike(r"^\s*([-*•]|\d+[.)])\s"), "list").otherwise("text")
    return rows.withColumn("page", F.lit(1)).withColumn("kind", kind)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", child: int = 320, parent: int = 900, overlap: int = 48) -> DataFrame:
    """Chunks of plain or Markdown texts, by their headings, tables, lists and paragraphs; a document without text has none."""
    return chunk_sections(docprep.structural_sections(paragraph_blocks(docs, key, text), "\n\n"), child, parent, overlap)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Stable ids over the fields that make a chunk, and its content's hash."""
    fields = ["doc_id", "chunk_index", "chunk_type", "section_path", "start", "end", "content"]
    return chunks.withColumn("content_sha256", F.sha2("content", 256)).withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256))
