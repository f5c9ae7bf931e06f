"""Token ids of whole texts, with each distinct word encoded once.

The word-level tokenizer never joins characters across ASCII white space (its pre-tokenizer has no match with white
space, and it drops what lies between), so a text's ids are its words' ids one after the other. A task keeps the words it
has met with their ids. A word is looked up by a 64-bit hash of its bytes, computed for a whole batch at once, and then
compared byte by byte with the one kept; a word with another's hash is encoded by itself.
Words of Latin letters go straight to the tokenizer's model, in the pieces its pre-tokenizer would make; all others go
through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from corpusmill.llm.shared import BLANK, row_slices, span_hashes, utf8, word_spans

#: A task forgets its words beyond so many, to bound its memory.
KEEP_WORDS, KEEP_BYTES = 1_500_000, 64 << 20
#: The pre-tokenizer's pattern for lower-case Latin text.
LATIN = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0101-\u017f"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")
#: Words that the pattern covers in full; longer ones go the common way.
PLAIN = re.compile(f"[!-~A-Za-z{LATIN}\u00c0-\u00d6\u00d8-\u00de]{{1,64}}")
#: The second and third bytes (or the second) of the characters beyond ASCII that count as white space.
WIDE_BLANKS = {0xC2: [(0x85,), (0xA0,)], 0xE1: [(0x9A, 0x80)], 0xE2: [*((0x80, b) for b in range(0x80, 0x8B)), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)], 0xE3: [(0x80, 0x80)]}
_HELD: dict[str, WordEncoder] = {}


def byte_characters() -> dict[int, str]:
    """Byte-level BPE's character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in same)
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


def appended(kept: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """`more` behind the first `used` of `kept`, which is doubled as often as needed."""
    while used + len(more) > len(kept):
        kept = np.concatenate([kept, np.zeros_like(kept)])
    kept[used : used + len(more)] = more
    return kept, used + len(more)


class WordEncoder:
    """Ids of batches of texts by the tokenizer file at `path`."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.bytes = byte_characters()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

        self.forget()

    def forget(self) -> None:
        """Words are kept as sorted hashes beside the places and lengths of their ids and bytes: some 40 bytes a word."""
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count, self.at, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0
        self.bytes_kept, self.bytes_used = np.zeros(1 << 18, np.uint8), 0

    def word(self, text: str) -> list[int]:
        if not PLAIN.fullmatch(text) or "<|" in text or not unicodedata.is_normalized("NFC", text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for piece in PIECE.findall(text.lower()):
            if not piece.isascii():
                piece = "".join(self.bytes[b] for b in piece.encode())
            out += [t.id for t in self.model.tokenize(piece)]
        return out

    def store(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the words' ids, now kept."""
        found = [self.word(w) for w in words]
        count = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.uint16, int(count.sum()))
        start = self.used + np.cumsum(count) - count
        self.ids, self.used = appended(self.ids, self.used, flat)
        return start, count

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds words; their hashes are sorted and new."""
        start, count = self.store([w.decode("utf-8", "replace") for w in words])
        size = np.array([len(w) for w in words], np.int64)
        at = self.bytes_used + np.cumsum(size) - size
        self.bytes_kept, self.bytes_used = appended(self.bytes_kept, self.bytes_used, np.frombuffer(b"".join(words), np.uint8))
        order = np.argsort(np.concatenate([self.keys, hashes]), kind="stable")
        self.keys, self.start, self.count, self.at, self.size = (np.concatenate([x, y])[order] for x, y in ((self.keys, hashes), (self.start, start), (self.count, count), (self.at, at), (self.size, size)))

    def others(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The words whose bytes are not those kept at their slots."""
        size = ends - starts
        differ = self.size[slot] != size
        size = np.where(differ, 0, size)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()))
        unlike = np.flatnonzero(data[np.repeat(starts - first, size) + place] != self.bytes_kept[np.repeat(self.at[slot] - first, size) + place])
        differ[np.searchsorted(first, unlike, "right") - 1] = True
        return np.flatnonzero(differ)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words, which are encoded one by one."""
        return word_spans(data, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, each with `end` behind it, and how many ids each row has."""
        starts, ends = self.spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KEEP_WORDS or self.bytes_used > KEEP_BYTES:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != distinct)) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            self.learn(distinct[new], [data[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        slot = np.searchsorted(self.keys, distinct)[back]
        counts, sources = self.count[slot], self.start[slot]
        if len(bad := self.others(slot, data, starts, ends)):
            sources[bad], counts[bad] = self.store([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[bad].tolist(), ends[bad].tolist(), strict=True)])
        row_words = np.searchsorted(starts, offsets)  # words before each row
        before = np.concatenate([[0], np.cumsum(counts)])
        row_ids = before[row_words[1:]] - before[row_words[:-1]] + 1
        total = int(row_ids.sum())
        out = np.full(total, end, np.uint16)
        row_of_word = np.repeat(np.arange(len(row_ids)), np.diff(row_words))
        shift = before[:-1] + row_of_word  # an end id for each row before
        place = np.repeat(shift - before[:-1], counts) + np.arange(before[-1])
        out[place] = self.ids[np.repeat(sources - before[:-1], counts) + np.arange(before[-1])]
        return out, row_ids


class ByteEncoder(WordEncoder):
    """For byte-level tokenizers that keep white space: a word is a run of white space and what follows it up to the next one.

    Their pre-tokenizer's pieces never hold white space behind another character, and look ahead only from white space to what
    follows it, so a text may be cut wherever ASCII white space begins behind a character that is none of any kind.
    """

    def word(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = BLANK[data]
        closed = blank.copy()  # the last bytes of white space of any kind
        for lead, tails in WIDE_BLANKS.items():
            at = np.flatnonzero(data == lead)
            for tail in tails:
                here = at[at + len(tail) < len(data)]
                for k, byte in enumerate(tail, 1):
                    here = here[data[here + k] == byte]
                closed[here + len(tail)] = True
        begins = np.zeros(len(data), bool)
        begins[1:] = blank[1:] & ~closed[:-1]
        edge = offsets[:-1]
        begins[edge[(edge < len(data)) & (np.diff(offsets) > 0)]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(data))[: len(starts)]


def encoder(path: str, kind: type[WordEncoder] = WordEncoder) -> WordEncoder:
    if path not in _HELD:
        _HELD[path] = kind(path)
    return _HELD[path]


def encoded(column: pa.Array, path: str, end: int, kind: type[WordEncoder] = WordEncoder):
    """(first row, last row, ids, ids of each row) for slices of a text column."""
    data, offsets = utf8(column)
    for a, b in row_slices(offsets):
        yield a, b, *encoder(path, kind).encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end)
