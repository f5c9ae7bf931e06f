"""Cleaning, sections, chunks and metadata of one document at a time, for tasks that have its whole text at hand: no row leaves its task.

The rules and patterns are those of `docprep.text_blocks`, `docprep.clean_documents`, `docprep.structural_sections` and `tx.extract_metadata`,
which work on blocks of any source and keep an audit. Java's patterns are read as they stand there: ASCII classes, `$` before a last line end. All
that begin with `^` are matched at a text's begin only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators.chunking import chunk_ids, cut
from corpusmill.operators.tables import flat_map


def java(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern of Java's default mode."""
    read = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern)
    return re.compile(read.replace("$", r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"), flags | re.ASCII)


LINE_END, MARKS, HEADING_MARK, NUMBER = re.compile(r"\r\n|\n|\r"), java(r"^#+\s*"), java(r"^#{1,6}\s+"), java(r"^(\d+(?:\.\d+)*)")
BLANKS, PAGE_NUMBER, WATERMARK, HEADING, LIST_ITEM = map(java, (tx.BLANKS, tx.PAGE_NUMBER, tx.WATERMARK, tx.HEADING, tx.LIST_ITEM))
VISUAL_END, ENDS_SENTENCE = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), re.compile("[。！？!?；;：:]\\Z")
HAN_LAST, HAN_FIRST = re.compile("[\u4e00-\u9fff]\\Z"), re.compile("[\u4e00-\u9fff]")
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class WordCharacters(dict):
    """Letters, digits and low lines, as Java's \\p{L}, \\p{N} and _ have them; other characters go."""

    def __missing__(self, c: int) -> int | None:
        self[c] = out = c if c == 95 or unicodedata.category(chr(c))[0] in "LN" else None
        return out


WORD_CHARACTERS = WordCharacters()


def fold_blanks(text: str) -> str:
    return BLANKS.sub(" ", text) if "\t" in text or "  " in text else text


def merged_lines(text: str) -> str:
    """`tx.merge_lines` of a text without line feeds at its hyphens."""
    if not VISUAL_END.search(text):
        return fold_blanks(text).strip(WHITE)
    out, before = [], None
    for line in VISUAL_END.split(text):
        line = fold_blanks(line).strip(WHITE)
        if not line:
            continue
        if before is not None:
            apart = ENDS_SENTENCE.search(before) or LIST_ITEM.match(line) or HEADING.match(line)
            out.append("\n" if apart else "" if HAN_LAST.search(before) and HAN_FIRST.match(line) else " ")
        out.append(line)
        before = line
    return "".join(out)


def clean_lines(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the lines that cleaning leaves: heading, list or text."""
    said = set()
    for line in LINE_END.split(text):
        if not line.strip(" "):
            continue
        kind = "heading" if line.startswith("#") else "text"
        given = (line[MARKS.match(line).end() :] if kind == "heading" else line).strip(" ")
        if PAGE_NUMBER.match(given) or WATERMARK.match(given):
            continue
        t = fold_blanks(tx.nfkc_symbol_safe_text(given))
        t = (merged_lines(t) if kind == "text" else t).strip(WHITE)
        if not t:
            continue
        if kind == "text":
            kind = "heading" if len(t) <= 160 and HEADING.match(t) else "list" if LIST_ITEM.match(t) else kind
        mark = t.translate(WORD_CHARACTERS).lower()
        if mark:
            if mark in said:
                continue
            said.add(mark)
        yield kind, t


def sections_of(lines: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(block_type, section_path, text) of runs of lines of one type between headings."""
    path: list[str] = []
    kind, held = "", []
    for k, t in lines:
        m = HEADING_MARK.match(t)
        head = k == "heading" or m is not None
        now = "" if head else "list" if k == "list" else "paragraph"
        if held and now != kind:
            yield kind, " > ".join(path), "\n".join(held)
            held = []
        kind = now
        if not head:
            held.append(t)
        elif title := t[m.end() if m else 0 :].strip(" "):
            level = n[1].count(".") + 1 if (n := NUMBER.match(title)) else 1
            path = [*path[: level - 1], title]
    if held:
        yield kind, " > ".join(path), "\n".join(held)


WORD = java(r"[A-Za-z][A-Za-z0-9-]{2,}|[\x{4e00}-\x{9fff}]{2,8}")
CODE, TWO_DIGITS = java(tx.CODE), re.compile("[0-9][0-9]")
DRUG_ENDINGS = tx.DRUG_ENDING.removeprefix("(?i)(?:").removesuffix(")").encode().split(b"|")
DRUG_INSIDE, DRUG_WORD, HAN_DRUG, DISEASE = java(tx.DRUG_ENDING + r"(?![A-Za-z0-9-])"), re.compile(tx.DRUG_ENDING + r"\Z", re.ASCII), java(tx.HAN_DRUG), java(tx.DISEASE)
EDGES = " ,.;:：()[]{}"
STOPWORDS = frozenset(tx.STOPWORDS)


class Masks(dict):
    """Characters outside ASCII as Java's word border sees them: letters and digits as a low line, which no code holds, marks and others as they are."""

    def __missing__(self, c: int) -> int:
        kind = unicodedata.category(chr(c))
        self[c] = out = ord("_") if c > 127 and (kind[0] == "L" or kind == "Nd") else c
        return out


MASKS = Masks()
MARKED = re.compile("(?<=[A-Za-z0-9_])[^\x00-\x7f]+")


def masked(text: str) -> str:
    def one(m: re.Match) -> str:
        """Marks behind a letter or digit belong to it."""
        run = m[0]
        n = next((k for k, c in enumerate(run) if unicodedata.category(c) != "Mn"), len(run))
        return "_" * n + run[n:]

    t = text.translate(MASKS)
    return t if t.isascii() else MARKED.sub(one, t)


def codes_of(text: str) -> list[str]:
    """Every code holds two digits beside each other."""
    if not TWO_DIGITS.search(text):
        return []
    return [text[m.start() : m.end()] for m in CODE.finditer(text if text.isascii() else masked(text))]


def distinct(values: Iterable[str], most: int) -> list[str]:
    """`tx.distinct_ignoring_case`."""
    out: dict[str, str] = {}
    for v in values:
        v = v.strip(EDGES)
        if v and len(out) < most:
            out.setdefault(v.lower(), v)
    return list(out.values())


#: Characters of a text in which keywords are looked for at once, up to the next blank, as no word holds one.
STEP, BLANK = 600, re.compile(r"\s")


def keywords_of(text: str) -> list[str]:
    """At most 40 of the first 80 words, stop words aside; once they are found the rest is not looked at."""
    out, seen, at = {}, set(), 0
    while at < len(text):
        end = m.start() if (m := BLANK.search(text, at + STEP)) else len(text)
        for w in dict.fromkeys(WORD.findall(text, at, end)):
            if w not in seen and (low := w.lower()) not in STOPWORDS:
                seen.add(w)
                out.setdefault(low, w)
                if len(out) == 40 or len(seen) == 80:
                    return list(out.values())
        at = end
    return list(out.values())


def metadata(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(codes, drugs, diseases, keywords)."""
    low, han = text.encode(errors="replace").lower(), not text.isascii()  # of bytes only a to z change
    drugs = [w for w in WORD.findall(text) if DRUG_WORD.search(w)] if any(map(low.__contains__, DRUG_ENDINGS)) and DRUG_INSIDE.search(text) else []
    drugs += HAN_DRUG.findall(text) if han else []
    return distinct(codes_of(text), 20), distinct(drugs, 20), distinct(DISEASE.findall(text), 20) if han else [], keywords_of(text)


ROWS = (
    "doc_id long, section long, page int, block_type string, section_path string, chunk_index int, chunk_type string, parent_index int, content string, start int, end int, "
    "codes array<string>, drugs array<string>, diseases array<string>, keywords array<string>"
)
FIELDS = ["doc_id", "chunk_index", "chunk_type", "parent_index", "section", "page", "block_type", "section_path", "content", "start", "end", "content_sha256", "chunk_id", "codes", "drugs", "diseases", "keywords"]


def chunks_of(docs: DataFrame, key: str = "doc_id", text: str = "text", child: int = 320, parent: int = 900, overlap: int = 48) -> DataFrame:
    """Documents to chunks: lines cleaned, put into sections, chunked, with codes, drugs, diseases and keywords."""

    def rows_of(doc: int | None, t: str | None) -> Iterator[tuple]:
        at = 0
        for section, (kind, path, body) in enumerate(sections_of(clean_lines(t or ""))):
            n = -1
            for n, what, above, content, a, b in cut(body, kind, child, parent, overlap):
                yield doc, section, 1, kind, path, at + n, what, None if above is None else at + above, content, a, b, *metadata(content)
            at += n + 1

    return flat_map(docs.select(F.col(key).cast("long"), F.col(text)), rows_of, ROWS)


def with_ids(chunks: DataFrame) -> DataFrame:
    """Their ids are hashes of what they hold, so they are the same wherever they are made."""
    return chunk_ids(chunks).select(*FIELDS, *[c for c in chunks.columns if c not in FIELDS])


def ingest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return with_ids(chunks_of(docs, key, text))
